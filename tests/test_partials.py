"""Analyses from the partial aggregates of landed batches against a full recompute."""

import pytest

from acvlens.params import FIXTURE_PARAMS as P
from acvlens.plans import cycles, penetration
from acvlens.sources import fixtures as fx
from acvlens.sources import tables
from acvlens.streaming import landing, partials

from conftest import SF_SMALL


def rows_of(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


def same(spark, rep, folder):
    dedup, accounts = partials.current_dedup(spark, folder), partials.current_accounts(spark, folder)
    assert rows_of(dedup) == rows_of(cycles.report_dedup(rep, P))
    assert rows_of(cycles.purchase_gaps(None, P, dedup)) == rows_of(cycles.purchase_gaps(rep, P))
    assert rows_of(cycles.purchase_cycles(None, P, dedup)) == rows_of(cycles.purchase_cycles(rep, P))
    for plan in (penetration.acct_volume_lines, penetration.volume_lines_scatter, penetration.acv_by_service_lines):
        assert rows_of(plan(None, P, accounts)) == rows_of(plan(rep, P))
    assert rows_of(penetration.acct_sales(None, P, "all", accounts)) == rows_of(penetration.acct_sales(rep, P, "all"))


def test_landings_equal_a_full_recompute(spark, tmp_dir, monkeypatch):
    rep = fx.opp_report(spark, SF_SMALL)
    # The second folder holds rows of the first again, with another account: duplicates across batches.
    again = rep.where("CAST(Opp_ID AS BIGINT) % 7 = 0").selectExpr(
        *[f"'0' AS {c}" if c == "Acct_Id" else c for c in rep.columns])
    a, b, table, folder = (f"{tmp_dir}/{x}" for x in ("a", "b", "table", "partials"))
    for k in range(3):
        tables.write_csv(rep.where(f"CAST(Opp_ID AS BIGINT) % 3 = {k}").coalesce(1), f"{a}/part{k}")
    tables.write_csv(again.coalesce(1), f"{b}/part0")
    partials.land_with_partials(spark, f"{a}/*", table, folder, P, max_files_per_trigger=1)
    same(spark, rep, folder)
    real, calls = landing.files.replace_parts, []

    def broken(*args):
        calls.append(1)
        if len(calls) == 1:
            raise OSError("lost before the files are moved")
        return real(*args)

    monkeypatch.setattr(landing.files, "replace_parts", broken)
    with pytest.raises(Exception, match="lost before"):
        partials.land_with_partials(spark, f"{b}/*", table, folder, P)
    partials.land_with_partials(spark, f"{b}/*", table, folder, P)      # the batch is run again
    partials.land_with_partials(spark, f"{b}/*", table, folder, P)      # nothing new
    assert len(calls) == 2
    both = rep.unionByName(again)
    assert spark.read.parquet(table).count() == both.count()
    same(spark, both, folder)
