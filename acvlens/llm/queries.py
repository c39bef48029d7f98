"""Registered queries of the operators: ``name -> (spark, sf_dir) -> DataFrame``, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (alignment, bpe, chunk_dedup, decontam, mixing, quality_model, rules, search, secret_scan, sharding,
               simhash, token_counts, tool_calls)
from .common import read
from .oracle import ORACLE_SQL

__all__ = ["MIXTURE", "ORACLE_SQL", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]

# Shares of the languages' tokens in the mixture.
MIXTURE = {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}

QUERIES: dict[str, Query] = {
    "op1_decontamination": lambda s, d: decontam.digest(
        decontam.find_contamination(read(s, d, "documents"), read(s, d, "benchmark"))),
    "op2_secret_scan": lambda s, d: secret_scan.digest(secret_scan.scan(read(s, d, "documents"))),
    "op3_quality_classifier": lambda s, d: quality_model.classify(read(s, d, "documents"), read(s, d, "labels")),
    "op4_token_counts": lambda s, d: token_counts.document_token_counts(read(s, d, "documents")),
    "op5_quality_rules": lambda s, d: rules.judge(read(s, d, "documents"), read(s, d, "labels")),
    "op6_tool_calls": lambda s, d: tool_calls.conversation_calls(read(s, d, "conversations")),
    "op7_simhash": lambda s, d: simhash.digest(simhash.near_duplicates(read(s, d, "documents"))),
    "op8_chunk_dedup": lambda s, d: chunk_dedup.repeated_spans(read(s, d, "documents")),
    "op9_sharding": lambda s, d: sharding.shard_documents(read(s, d, "documents")),
    "op10_mixing": lambda s, d: mixing.mixing_rates(read(s, d, "documents"), read(s, d, "labels"), MIXTURE),
    "op11_alignment": lambda s, d: alignment.aligned_documents(read(s, d, "documents")),
    "op12_ranked_search": lambda s, d: search.rank_documents(read(s, d, "documents"), read(s, d, "benchmark")),
    "op13_bpe": lambda s, d: bpe.digest(bpe.round_trip(read(s, d, "documents"))),
}
