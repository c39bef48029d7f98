"""Distinct counts of groups and unions of groups from one table of bitmaps."""

from acvlens.operators import bitmaps
from acvlens.params import FIXTURE_PARAMS as P
from acvlens.plans import cycles, referral
from acvlens.sources import fixtures as fx

from conftest import SF_SMALL


def test_counts_of_any_union(spark, monkeypatch):
    monkeypatch.setattr(bitmaps, "BUCKETS", 4)
    df = spark.sql("""SELECT CASE WHEN id % 5 = 4 THEN NULL ELSE id % 5 END AS g, IF(id % 50 = 0, NULL, concat('k', pmod(xxhash64(id), 90000))) AS k
                      FROM range(200000)""").repartition(5)
    numbers = bitmaps.numbered_ids(df, "k")
    top = numbers.agg({"number": "max"}).first()[0]
    n = df.select("k").distinct().count()
    assert numbers.select("number").distinct().count() == n == numbers.count() and n <= top < 1.05 * n
    table = bitmaps.distinct_bitmaps(df, ["g"], "k", numbers).persist()
    assert table.select("range_no").distinct().count() > 1       # more than one range of 32,768
    rows = df.distinct().collect()
    ids = {g: {r.k for r in rows if r.g == g} for g in (0, 1, 2, 3, None)}
    assert {r.g: r.n for r in bitmaps.distinct_counts(table, ["g"], "n").collect()} == {g: len(x) for g, x in ids.items()}
    for some in ({0, 1}, {1, 3}, {0, 1, 2, 3}):
        part = table.where(table["g"].isin(*some))
        assert bitmaps.distinct_counts(part, [], "n").first().n == len(set().union(*(ids[g] for g in some)))
    assert bitmaps.distinct_counts(table, [], "n").first().n == len(set().union(*ids.values()))


def test_empty(spark):
    df = spark.createDataFrame([], "g int, k string")
    table = bitmaps.distinct_bitmaps(df, ["g"], "k", bitmaps.numbered_ids(df, "k"))
    assert bitmaps.distinct_counts(table, ["g"], "n").count() == 0
    assert bitmaps.distinct_counts(table, [], "n").first().n == 0


def test_counts_equal_the_present_ones(spark):
    opp, rep = fx.opportunity(spark, SF_SMALL), fx.opp_report(spark, SF_SMALL)
    yearly = referral.referral_yearly_unique(opp, P)
    row = yearly.where("metric = 'distinct_referral_accounts'").first().asDict()
    counts = {r.year: r.distinct_referral_accounts for r in referral.referrer_counts(referral.referrer_bitmaps(opp, P)).collect()}
    assert {str(y): str(n) for y, n in counts.items() if str(y) in row} == {y: n for y, n in row.items() if y != "metric" and n}
    lines = {r.Record_Type_Name: r.distinct_accts for r in cycles.service_line_counts(rep, P).collect()}
    found = cycles.service_line_accounts(cycles.service_line_bitmaps(rep, P)).collect()
    assert {r.Record_Type_Name: r.distinct_accts for r in found if not r.total} == lines
    total = cycles.report_dedup(rep, P).select("Acct_Id").distinct().count()
    assert [r.distinct_accts for r in found if r.total] == [total]
