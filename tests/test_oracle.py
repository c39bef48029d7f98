"""Every registered query against its DuckDB oracle SQL (the driver's check).

Runs on sf0.001 by default; set ACVLENS_ORACLE_SF=/root/testdata/sf0.01 for
the driver's scale.
"""

import os

import pytest

from acvlens.plans.oracle import ORACLE_SQL
from acvlens.plans.registry import QUERIES
from oracle_compare import compare, duck_connection

SF = os.environ.get("ACVLENS_ORACLE_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck_connection(SF)


def test_every_query_has_oracle_sql():
    assert set(QUERIES) == {k for k, v in ORACLE_SQL.items() if v}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(QUERIES[name](spark, SF), con, ORACLE_SQL[name])
    assert ok, msg


def test_entry_smoke(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["Name", "R_total_acv", "R_total_tcv", "referral_opp_count",
                          "referral_record_type_count"]
