"""The driver entry without the optional part or its libraries."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("hidden", ["acvlens.llm", "corpus_pipeline", "tiktoken", "xxhash", "numpy", "sentencepiece", "tokenizers"])
def test_entry_imports_without(hidden):
    code = f"""
import sys
sys.modules[{hidden!r}] = None
import __spark_entry__ as e
names = set(e.queries())
assert {{"q01_referral_edges", "q40_win_pct_display"}} <= names and set(e.oracle_sql()) <= names
assert "pipeline" not in names
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
