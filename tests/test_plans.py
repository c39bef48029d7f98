"""Physical-plan properties on landed Parquet inputs."""

import re

import pytest

from acvlens.params import FIXTURE_PARAMS as P
from acvlens.plans import cycles, referral
from acvlens.sources import fixtures as fx
from acvlens.sources import tables

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("landed"))
    fx.opportunity(spark, SF_SMALL).write.parquet(f"{d}/opportunity")
    fx.opp_report(spark, SF_SMALL).write.parquet(f"{d}/opp_report")
    return d


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_edges_one_scan_no_shuffle(spark, landed):
    opp = tables.read_opportunity(spark, f"{landed}/opportunity")
    p = plan(referral.referral_merged(opp, P))
    assert p.count("FileScan parquet") == 1
    assert "Exchange" not in p


def test_year_bound_pushed_to_scan(spark, landed):
    opp = tables.read_opportunity(spark, f"{landed}/opportunity")
    p = plan(referral.win_pct_by_year(opp, P))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(CloseDate,1998-01-01\)", p), p


def test_scan_reads_only_needed_columns(spark, landed):
    opp = tables.read_opportunity(spark, f"{landed}/opportunity")
    p = plan(referral.opp_count_by_year(opp, P))
    schema = re.search(r"ReadSchema: (struct<[^>]*>)", p).group(1)
    assert set(re.findall(r"(\w+):", schema)) == {"StageName", "CloseDate"}


def test_cycles_exchanges(spark, landed):
    rep = spark.read.parquet(f"{landed}/opp_report")
    p = plan(cycles.purchase_cycles(rep, P))
    # keep-first key, (account, line, day) pre-aggregate, (account, line) windows;
    # the two windows and the final aggregate share the last exchange.
    assert p.count("Exchange hashpartitioning") == 3, p
    assert "hashpartitioning(Acct_Id" in p


def test_no_python_udfs(spark, landed):
    from acvlens.plans.registry import QUERIES
    for name, q in QUERIES.items():
        p = plan(q(spark, SF_SMALL))
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, name


def test_yearly_credit_pushes_the_year_bound(spark, landed):
    opp = tables.read_opportunity(spark, f"{landed}/opportunity")
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    p = plan(referral.referral_yearly_credit(opp, P))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(CloseDate,1998-01-01\)", p), p


def test_win_rates_without_expand(spark, landed):
    opp = tables.read_opportunity(spark, f"{landed}/opportunity")
    assert "Expand" not in plan(referral.win_pct_summary(opp, P))


def test_account_figures_use_hash_aggregates_only(spark, landed):
    from acvlens.plans import clients, penetration
    rep = spark.read.parquet(f"{landed}/opp_report")
    opp = tables.read_opportunity(spark, f"{landed}/opportunity")
    for df in (penetration.acct_sales(rep, P, "won"), penetration.acct_sales_both(rep, P),
               penetration.acct_volume_lines(rep, P), referral.referral_summary(opp, P),
               clients.won_totals_by_side(opp, P)):
        p = plan(df)
        assert "HashAggregate" in p and "ObjectHashAggregate" not in p and "SortAggregate" not in p
