"""Incremental landing of CSV exports: each file once, across restarts."""

from acvlens.params import FIXTURE_PARAMS as P
from acvlens.plans import cycles
from acvlens.sources import fixtures as fx
from acvlens.sources import tables
from acvlens.streaming.landing import land_report_exports

from conftest import SF_SMALL


def test_land_exports_incrementally(spark, tmp_dir):
    rep = fx.opp_report(spark, SF_SMALL)
    first = rep.filter("CAST(Opp_ID AS BIGINT) % 2 = 0")
    second = rep.filter("CAST(Opp_ID AS BIGINT) % 2 = 1")
    exports, table, ckpt = f"{tmp_dir}/exports", f"{tmp_dir}/landed", f"{tmp_dir}/ckpt"
    tables.write_csv(first, f"{exports}/batch=1")
    land_report_exports(spark, f"{exports}/*", table, checkpoint_location=ckpt)
    assert spark.read.parquet(table).count() == first.count()
    # a new export arrives; a re-run lands only the new file
    tables.write_csv(second, f"{exports}/batch=2")
    land_report_exports(spark, f"{exports}/*", table, checkpoint_location=ckpt)
    land_report_exports(spark, f"{exports}/*", table, checkpoint_location=ckpt)   # nothing new
    landed = spark.read.parquet(table)
    assert landed.count() == rep.count()
    assert landed.exceptAll(rep).count() == 0
    # the analyses run on the landed table unchanged
    assert cycles.report_dedup(landed, P).count() == cycles.report_dedup(rep, P).count()


_LAND = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from acvlens.streaming.landing import land_report_exports
spark = (SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", {shared!r}).getOrCreate())
for table in sys.argv[2:]:
    land_report_exports(spark, sys.argv[1], table)
"""


def test_landing_goes_on_in_a_new_application(spark, tmp_dir):
    """Each application has a checkpoint folder of its own; the landing's log must outlive it."""
    import os
    import subprocess
    import sys
    rep = fx.opp_report(spark, SF_SMALL)
    parts = [rep.filter(f"CAST(Opp_ID AS BIGINT) % 3 = {k}") for k in range(2)]
    code = _LAND.format(root=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), shared=f"{tmp_dir}/shared")
    tables.write_csv(parts[0], f"{tmp_dir}/exports/batch=1")
    land = [sys.executable, "-c", code, f"{tmp_dir}/exports/*", f"{tmp_dir}/one", f"{tmp_dir}/two"]
    subprocess.run(land[:-1], check=True, capture_output=True, timeout=300)
    tables.write_csv(parts[1], f"{tmp_dir}/exports/batch=2")
    subprocess.run(land, check=True, capture_output=True, timeout=300)
    for table in ("one", "two"):                   # the second table has its own log and lands both files
        assert spark.read.parquet(f"{tmp_dir}/{table}").count() == parts[0].count() + parts[1].count()


def _exports(spark, folder, *rows):
    """A folder with one CSV export per list of opportunity ids."""
    header = "Opp_ID,Acct_Id,CPA_Contact_Acct_ID,Record_Type_Name,Close_Date,ACV_for_Quotas,Stage\n"
    import os
    os.makedirs(folder, exist_ok=True)
    for k, ids in enumerate(rows):
        with open(f"{folder}/export-{k}-{ids[0]}.csv", "w") as f:
            f.write(header + "".join(f"{i},a,,LINE,1/5/2020,1,won\n" for i in ids))
    return folder


def _landed(spark, table):
    return sorted(r.Opp_ID for r in spark.read.parquet(table).collect())


def test_two_folders_into_one_table(spark, tmp_dir):
    a, b = _exports(spark, f"{tmp_dir}/a", ["a1", "a2"]), _exports(spark, f"{tmp_dir}/b", ["b1"])
    table = f"{tmp_dir}/table"
    for folder in (a, b, a, b):
        land_report_exports(spark, folder, table)
    assert _landed(spark, table) == ["a1", "a2", "b1"]
    _exports(spark, a, ["a3"])
    _exports(spark, b, ["b2"], ["b3"])
    for folder in (b, a):
        land_report_exports(spark, folder, table, max_files_per_trigger=1)
    assert _landed(spark, table) == ["a1", "a2", "a3", "b1", "b2", "b3"]


def test_spellings_of_a_folder_are_one_source(spark, tmp_dir):
    import os
    a, table = _exports(spark, f"{tmp_dir}/a", ["a1"]), f"{tmp_dir}/table"
    for spelling in (a, f"{a}/", f"file:{a}", f"file://{a}", f"{tmp_dir}//a", os.path.join(tmp_dir, "x", "..", "a")):
        land_report_exports(spark, spelling, table)
    assert _landed(spark, table) == ["a1"]


def test_old_files_are_landed_too(spark, tmp_dir):
    import os
    a, table = _exports(spark, f"{tmp_dir}/a", ["a1"]), f"{tmp_dir}/table"
    land_report_exports(spark, a, table)
    _exports(spark, a, ["a1"], ["late"])
    os.utime(f"{a}/export-1-late.csv", (1_000_000_000, 1_000_000_000))
    land_report_exports(spark, a, table)
    assert _landed(spark, table) == ["a1", "late"]


def test_a_replayed_batch_changes_nothing(spark, tmp_dir, monkeypatch):
    import pytest
    from acvlens.sources import files
    from acvlens.streaming import landing
    a, table = _exports(spark, f"{tmp_dir}/a", ["a1"], ["a2"]), f"{tmp_dir}/table"
    real, calls = files.replace_parts, []

    def broken(*args):
        moved = real(*args)
        calls.append(moved)
        if len(calls) == 1:
            raise OSError("the application is lost after the files are moved")
        return moved

    monkeypatch.setattr(landing.files, "replace_parts", broken)
    with pytest.raises(Exception, match="lost after"):
        land_report_exports(spark, a, table)
    assert _landed(spark, table) == ["a1", "a2"]
    land_report_exports(spark, a, table)              # the batch was not logged as done: it is run again
    assert len(calls) == 2 and _landed(spark, table) == ["a1", "a2"]


def test_what_would_lose_or_double_rows_is_refused(spark, tmp_dir):
    import pytest
    a, table = _exports(spark, f"{tmp_dir}/a", ["a1"]), f"{tmp_dir}/table"
    land_report_exports(spark, a, table)
    with pytest.raises(ValueError, match="second log"):
        land_report_exports(spark, a, table, checkpoint_location=f"{tmp_dir}/other")
    with pytest.raises(ValueError, match="share the file"):
        land_report_exports(spark, f"{a}/*.csv", table)
    sink = f"{tmp_dir}/sink"
    spark.range(1).write.parquet(f"{sink}/_spark_metadata")
    with pytest.raises(ValueError, match="file sink"):
        land_report_exports(spark, a, sink)
    assert _landed(spark, table) == ["a1"]
