"""Opportunities landed by close year: which folders a year bound reads."""

import datetime as dt
import glob
import os
import re

import pytest

from acvlens.params import FIXTURE_PARAMS as P
from acvlens.plans import referral
from acvlens.sources import fixtures as fx
from acvlens.sources import tables

from conftest import SF_SMALL

QUERIES = [referral.win_pct_by_year, referral.opp_count_by_year, referral.win_pct_summary, referral.referral_yearly_unique,
           referral.referral_yearly_credit, referral.referral_share_by_year, referral.referral_share_dual_axis]


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("years")) + "/opportunity"
    tables.write_opportunity(fx.opportunity(spark, SF_SMALL), path)
    return path


def test_one_folder_a_year_and_every_row(spark, landed):
    years = {d.rsplit("=", 1)[1] for d in glob.glob(f"{landed}/close_year=*")}
    opp = fx.opportunity(spark, SF_SMALL)
    want = {str(r[0]) for r in opp.selectExpr("year(CloseDate)").distinct().collect() if r[0]} | {"__HIVE_DEFAULT_PARTITION__"}
    assert years == want
    back = tables.read_opportunity(spark, landed).drop("close_year")
    assert back.exceptAll(opp).count() == 0 and opp.exceptAll(back).count() == 0


@pytest.mark.parametrize("query", QUERIES, ids=lambda q: q.__name__)
def test_year_bounds_prune_folders(spark, landed, query):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    opp = tables.read_opportunity(spark, landed)
    got = query(opp, P)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*\(close_year#\d+ >= 1998\)", plan), plan
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(CloseDate,1998-01-01\)", plan), plan
    plain = query(fx.opportunity(spark, SF_SMALL), P)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)


def test_folders_of_other_years_are_not_read(spark, tmp_dir):
    path = f"{tmp_dir}/opportunity"
    tables.write_opportunity(fx.opportunity(spark, SF_SMALL), path)
    opp = tables.read_opportunity(spark, path)   # its schema comes from some file's footer
    for part in glob.glob(f"{path}/close_year=*/*.parquet"):
        year = re.search("close_year=([^/]+)", part).group(1)
        if not year.isdigit() or int(year) < 1998:
            os.remove(os.path.join(os.path.dirname(part), f".{os.path.basename(part)}.crc"))
            with open(part, "wb") as f:
                f.write(b"not a Parquet file")
    assert referral.referral_share_by_year(opp, P).count() > 0
    with pytest.raises(Exception):
        opp.select("Id").collect()


def test_a_large_year_is_split_over_files(spark, tmp_dir):
    rows = spark.range(60000).selectExpr("string(id) AS Id", "sha2(string(id), 256) AS AccountId", "'won' AS StageName",
                                         "date'2020-03-01' AS CloseDate")
    names = {f.name: f.dataType for f in tables.OPPORTUNITY.fields}
    df = rows.selectExpr("*", *[f"CAST(NULL AS {t.simpleString()}) AS {n}" for n, t in names.items() if n not in rows.columns])
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    try:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "500k")
        tables.write_opportunity(df.repartition(8), f"{tmp_dir}/o")
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert len(glob.glob(f"{tmp_dir}/o/close_year=2020/*.parquet")) > 2
    assert tables.read_opportunity(spark, f"{tmp_dir}/o").where(f"CloseDate = '{dt.date(2020, 3, 1)}'").count() == 60000
