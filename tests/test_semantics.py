"""Semantics on literal rows (FIXTURES.md) and against brute force on random data."""

import datetime as dt
import random
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from acvlens.operators import dedup, gaps, joins, stats
from acvlens.params import Params
from acvlens.plans import clients, cycles, penetration, referral
from acvlens.sources.schemas import OPP_REPORT, OPPORTUNITY

WON, LOST = "6 - Closed Won", "7 - Closed Lost"
P = Params(min_year=2018, years=(2018, 2019, 2020), service_lines=("A", "B"))


def opp_rows(spark, rows):
    full = []
    for r in rows:
        d = {f.name: None for f in OPPORTUNITY.fields}
        d.update(r)
        full.append(tuple(d[f.name] for f in OPPORTUNITY.fields))
    return spark.createDataFrame(full, OPPORTUNITY)


def report_rows(spark, rows):
    full = []
    for r in rows:
        d = {f.name: "" if f.dataType.typeName() == "string" else None for f in OPP_REPORT.fields}
        d.update(r)
        full.append(tuple(d[f.name] for f in OPP_REPORT.fields))
    return spark.createDataFrame(full, OPP_REPORT)


def _metric(df, metric, year):
    return {r["metric"]: r[str(year)] for r in df.collect()}[metric]


# --- referral attribution ------------------------------------------------------------

def test_same_referrer_twice_is_one_edge(spark):
    opp = opp_rows(spark, [dict(Id="1", Referring_CPA__c="A", Referral_1_Account__c="A",
                                Referral_2_Account__c="")])
    assert [tuple(r) for r in referral.referral_edges(opp, P).collect()] == [("1", "A")]


@pytest.mark.parametrize("unique", [True, False])
def test_two_referrers_credit_vs_unique(spark, unique):
    p = Params(min_year=2018, years=(2018,), unique_opportunity_id=unique)
    opp = opp_rows(spark, [dict(Id="1", StageName=WON, CloseDate=dt.date(2018, 3, 1),
                                ACV_for_Quotas__c=Decimal("100.50"),
                                Referring_CPA__c="A", Referral_2_Account__c="B")])
    credit = referral.referral_yearly_credit(opp, p)
    unique_t = referral.referral_yearly_unique(opp, p)
    assert _metric(credit, "referral_acv", 2018) == "$201"
    assert _metric(credit, "opportunity_count", 2018) == "2"
    assert _metric(unique_t, "referral_acv", 2018) == "$100"
    assert _metric(unique_t, "opportunity_count", 2018) == "1"
    assert _metric(unique_t, "distinct_referral_accounts", 2018) == "2"


def test_non_unique_id_path_matches_join_semantics(spark):
    # The same Id twice: the reference's left join multiplies the edge.
    p = Params(unique_opportunity_id=False)
    opp = opp_rows(spark, [dict(Id="1", StageName=WON, Referring_CPA__c="A", ACV_for_Quotas__c=Decimal(1)),
                           dict(Id="1", StageName=WON, Referring_CPA__c="A", ACV_for_Quotas__c=Decimal(2))])
    assert referral.referral_edges(opp, p).count() == 1
    s = referral.referral_summary(opp, p).first()
    assert (s.referral_opp_count, s.R_total_acv) == (2, Decimal("3.00"))


def test_win_rate_and_counts(spark):
    opp = opp_rows(spark, [
        dict(Id="1", StageName=WON, CloseDate=dt.date(2019, 1, 1), Referring_CPA__c="A"),
        dict(Id="2", StageName=LOST, CloseDate=dt.date(2019, 1, 1), Referral_1_Account__c="B"),
        dict(Id="3", StageName=WON, CloseDate=dt.date(2019, 1, 1)),
        dict(Id="4", StageName=WON, CloseDate=dt.date(2017, 1, 1)),      # before min_year
        dict(Id="5", StageName=WON, CloseDate=None),                     # no date
        dict(Id="6", StageName="3 - Proposal", CloseDate=dt.date(2019, 1, 1)),
    ])
    w = {(r.year, r.category): r.win_percentage for r in referral.win_pct_by_year(opp, P).collect()}
    assert w == {(2019, "Win % with Referral"): 50.0, (2019, "Win % without Referral"): 100.0}
    s = {r["category"]: (r["2018"], r["2019"]) for r in referral.win_pct_summary(opp, P).collect()}
    assert s["Total Count of Opps"] == (None, "3")
    assert s["Win % with Referral"] == (None, "50%")
    d = {r["Metric"]: r["2018"] for r in referral.win_pct_display(opp, P).collect()}
    assert d["Win % without Referral"] == "-"


def test_zero_sales_year_share_is_null(spark):
    opp = opp_rows(spark, [dict(Id="1", StageName=WON, CloseDate=dt.date(2019, 5, 1),
                                ACV_for_Quotas__c=None, Referring_CPA__c="A")])
    r = referral.referral_share_by_year(opp, P).first()
    assert r.total_sales == Decimal("0.00") and r.referral_percentage is None


def test_referral_share_bounded_by_total(spark):
    rng = random.Random(7)
    rows = [dict(Id=str(i), StageName=WON, CloseDate=dt.date(2018 + rng.randrange(3), 1, 1),
                 ACV_for_Quotas__c=Decimal(rng.randrange(0, 10000)),
                 Referring_CPA__c=rng.choice([None, "", "A", "B"])) for i in range(200)]
    for r in referral.referral_share_dual_axis(opp_rows(spark, rows), P).collect():
        assert r.referral_sales <= r.total_sales
        assert r.referral_line <= float(r.max_total_sales) + 1e-6


# --- client / CPA side ---------------------------------------------------------------

def test_null_name_join_matches_and_multiplies(spark):
    a = spark.createDataFrame([(None, 1), ("X", 2)], "Name string, a int")
    b = spark.createDataFrame([(None, 10), ("X", 20), ("X", 21), ("Y", 30)], "Name string, b int")
    full = sorted((r.Name or "", r.a or 0, r.b or 0) for r in joins.full_join_null_safe(a, b, "Name").collect())
    assert full == [("", 1, 10), ("X", 2, 20), ("X", 2, 21), ("Y", 0, 30)]
    left = sorted((r.Name or "", r.a, r.b) for r in joins.left_join_null_safe(a, b, "Name").collect())
    assert left == [("", 1, 10), ("X", 2, 20), ("X", 2, 21)]


def test_cpa_pairs_drop_missing_client_keep_empty(spark):
    opp = opp_rows(spark, [
        dict(Id="1", CPA_Contact_Account__c="C", AccountId="C"),   # same account: dropped
        dict(Id="2", CPA_Contact_Account__c="C", AccountId=None),  # NA comparison: dropped
        dict(Id="3", CPA_Contact_Account__c="C", AccountId=""),    # "" differs: kept
        dict(Id="4", CPA_Contact_Account__c="", AccountId="Z"),    # no CPA: dropped
    ])
    assert [r.Id for r in clients.cpa_client_pairs(opp, P).collect()] == ["3"]


# --- report keep-first, gaps, cycles -------------------------------------------------

def test_tied_keep_first_client_row_then_smallest_account(spark):
    rep = report_rows(spark, [
        dict(Opp_ID="9", Acct_Id="B2", CPA_Contact_Acct_ID="A0", Record_Type_Name="A",
             Close_Date="1/2/2020", ACV_for_Quotas=Decimal(5), Stage=WON),
        dict(Opp_ID="9", Acct_Id="B1", CPA_Contact_Acct_ID="A0", Record_Type_Name="A",
             Close_Date="1/2/2020", ACV_for_Quotas=None, Stage=WON),
        dict(Opp_ID="9", Acct_Id="B1", CPA_Contact_Acct_ID="", Record_Type_Name="A",
             Close_Date="1/2/2020", ACV_for_Quotas=Decimal(7), Stage=WON),
    ])
    got = [tuple(r) for r in cycles.report_dedup(rep, P).collect()]
    assert got == [("9", "B1", "A", "1/2/2020", Decimal("7.00"))]
    by_party = {r.Acct_Id for r in cycles.report_dedup_by_party(rep, P).collect()}
    assert by_party == {"B1", "B2", "A0"}


def test_long_gap_is_dropped_before_summary(spark):
    base = dt.date(2020, 1, 1)
    days = [0, 100, 1200]
    rep = report_rows(spark, [
        dict(Opp_ID=str(i), Acct_Id="A", Record_Type_Name="A", Stage=WON,
             Close_Date=(base + dt.timedelta(days=d)).strftime("%-m/%-d/%Y")) for i, d in enumerate(days)])
    r = cycles.purchase_cycles(rep, P).first()
    assert r.num_opportunities == 2
    assert r.most_recent_purchase == base + dt.timedelta(days=100)
    assert r.avg_cycle == 100.0 and r.median_cycle == 100.0


def _brute_gaps(pdf, max_gap):
    """The reference's steps on a pandas frame: sort, lag per group, filter, summarise."""
    pdf = pdf.sort_values(["Acct_Id", "Record_Type_Name", "Close_Date", "Opp_ID"], na_position="last")
    out = []
    for (a, r), g in pdf.groupby(["Acct_Id", "Record_Type_Name"], sort=False, dropna=False):
        prev = None
        for row in g.itertuples():
            d = row.Close_Date
            gap = None if (prev is None or pd.isna(d) or pd.isna(prev)) else (d - prev).days
            if gap is not None and gap <= max_gap:
                out.append((row.Opp_ID, a, r, d, float(gap)))
            prev = d
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_gaps_and_cycles_match_brute_force(spark, seed):
    rng = random.Random(seed)
    base = dt.date(2019, 1, 1)
    rows = []
    for i in range(400):
        acct = "HOT" if rng.random() < 0.35 else f"a{rng.randrange(25)}"   # one hot account
        d = None if rng.random() < 0.05 else base + dt.timedelta(days=rng.choice(
            [rng.randrange(0, 60), rng.randrange(0, 2500)]))
        rows.append((f"o{i:04d}", acct, rng.choice("AB"), d))
    df = spark.createDataFrame(rows, "Opp_ID string, Acct_Id string, Record_Type_Name string, Close_Date date")
    pdf = pd.DataFrame(rows, columns=["Opp_ID", "Acct_Id", "Record_Type_Name", "Close_Date"])
    want = sorted(_brute_gaps(pdf, 1000))
    got = sorted(tuple(r) for r in gaps.purchase_gaps(df, ["Acct_Id", "Record_Type_Name"], "Close_Date",
                                                        "Opp_ID", 1000).collect())
    assert got == want
    wdf = pd.DataFrame(want, columns=["Opp_ID", "Acct_Id", "Record_Type_Name", "Close_Date", "gap"])
    summ = {(a, r): (g.gap.mean(), g.gap.median(), len(g) + 1, g.Close_Date.max())
            for (a, r), g in wdf.groupby(["Acct_Id", "Record_Type_Name"])}
    got_s = {(r.Acct_Id, r.Record_Type_Name): (r.avg_cycle, r.median_cycle, r.num_opportunities,
                                               r.most_recent_purchase)
             for r in gaps.purchase_cycles(df, ["Acct_Id", "Record_Type_Name"], "Close_Date", "Opp_ID",
                                           1000).collect()}
    assert got_s.keys() == summ.keys()
    for k, (m, med, n, last) in summ.items():
        gm, gmed, gn, glast = got_s[k]
        assert abs(gm - m) < 1e-9 and gmed == med and gn == n and glast == last


def test_keep_first_matches_sorted_first(spark):
    rng = random.Random(3)
    rows = [(rng.choice("xyz"), rng.choice([None, "b", "a", "c"]), rng.choice([None, 1, 2, 3]))
            for _ in range(300)]
    df = spark.createDataFrame(rows, "k string, a string, v int")
    got = {r.k: (r.a, r.v) for r in dedup.keep_first(df, ["k"], ["a", "v"]).collect()}
    for k in "xyz":
        cand = [(a, v) for kk, a, v in rows if kk == k]
        best = min(cand, key=lambda t: (t[0] is None, t[0] or "", t[1] is None, t[1] or 0))
        assert got[k] == best


# --- statistics ---------------------------------------------------------------------

def test_median_and_boxplot_match_numpy(spark):
    rng = np.random.default_rng(5)
    vals = {g: rng.gamma(2.0, 100.0, size=n).round(3) for g, n in (("a", 101), ("b", 64), ("c", 2))}
    rows = [(g, float(v)) for g, vs in vals.items() for v in vs] + [("a", 5000.0), ("b", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    vals["a"] = np.append(vals["a"], 5000.0)
    med = {r.g: r.median for r in stats.median_exact(df, ["g"], "v").collect()}
    box = {r.g: r for r in stats.boxplot_stats(df, ["g"], "v").collect()}
    for g, vs in vals.items():
        assert med[g] == pytest.approx(float(np.median(vs)), abs=1e-9)
        q1, q2, q3 = np.quantile(vs, [0.25, 0.5, 0.75])
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        inside = vs[(vs >= lo) & (vs <= hi)]
        b = box[g]
        assert (b.q1, b.median, b.q3) == pytest.approx((q1, q2, q3), abs=1e-9)
        assert b.lower_whisker == min(q1, inside.min()) and b.upper_whisker == max(q3, inside.max())
        assert b.n_outliers == len(vs) - len(inside)
    assert box["a"].n_outliers >= 1


def test_density_binned_close_to_exact_and_integrates(spark):
    rng = np.random.default_rng(11)
    rows = [("g", float(x)) for x in rng.normal(300, 80, 500)] + [("one", 1.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    exact = {r.grid_index: r for r in stats.density(df, ["g"], "v", binned=False).collect()}
    binned = {r.grid_index: r for r in stats.density(df, ["g"], "v", binned=True).collect()}
    assert len(exact) == 512 and set(binned) == set(exact)        # "one" (n < 2) dropped
    peak = max(r.density for r in exact.values())
    assert max(abs(binned[i].density - exact[i].density) for i in exact) < 1e-4 * peak
    xs = np.array([exact[i].x for i in range(512)])
    ys = np.array([exact[i].density for i in range(512)])
    assert 0.9 < np.trapezoid(ys, xs) <= 1.0 + 1e-6
    # bandwidth is R's bw.nrd0
    v = np.array([x for g, x in rows if g == "g"])
    q1, q3 = np.quantile(v, [0.25, 0.75])
    bw = 0.9 * min(v.std(ddof=1), (q3 - q1) / 1.34) * len(v) ** -0.2
    assert exact[0].bw == pytest.approx(bw, rel=1e-12)


def test_constant_x_fit_is_null(spark):
    df = spark.createDataFrame([(2.0, 1.0), (2.0, 5.0)], "x double, y double")
    r = stats.lm_fit(df, "x", "y").first()
    assert r.slope is None and r.intercept is None


def test_fit_matches_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(1, 20, 100).astype(float)
    y = 3.5 * x + rng.normal(0, 2, 100)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    r = stats.lm_fit(df, "x", "y").first()
    slope, intercept = np.polyfit(x, y, 1)
    assert r.slope == pytest.approx(slope, rel=1e-9) and r.intercept == pytest.approx(intercept, rel=1e-9)
    assert r.y_at_x_max == pytest.approx(intercept + slope * x.max(), rel=1e-9)


def test_service_line_summary_invariants(spark):
    rng = random.Random(4)
    rep = report_rows(spark, [dict(Opp_ID=str(i), Acct_Id=f"a{rng.randrange(30)}", Stage=WON,
                                   Record_Type_Name=rng.choice("ABCD"),
                                   ACV_for_Quotas=Decimal(rng.randrange(1, 1000)))
                              for i in range(300)])
    per_acct = penetration.acct_sales(rep, P, "won")
    summary = penetration.acv_by_service_lines(rep, P)
    assert summary.agg(F.sum("num_accounts")).first()[0] == per_acct.count()
    assert summary.agg(F.sum("sum_acv")).first()[0] == per_acct.agg(F.sum("total_acv")).first()[0]


@pytest.mark.parametrize("accuracy", [20, 100])
def test_group_quantiles_bracket_path_is_exact(spark, accuracy):
    # Groups far above 10·accuracy rows use the sketch brackets; ties and a
    # hot group included.  Must equal numpy's type-7 quantiles exactly.
    rng = np.random.default_rng(accuracy)
    hot = rng.integers(0, 400, 30000).astype(float)                   # heavy ties
    cont = rng.normal(0, 1, 12000).round(6)
    small = rng.normal(5, 2, 37)
    rows = [("hot", float(x)) for x in hot] + [("cont", float(x)) for x in cont] + \
           [("small", float(x)) for x in small]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    names = [f"p{i}" for i in range(len(probs))]
    got = {r.g: [r[n] for n in names]
           for r in stats.group_quantiles(df, ["g"], "v", probs, names, accuracy=accuracy).collect()}
    med = {r.g: r.m for r in stats.group_quantiles(df, ["g"], "v", [0.5], ["m"], accuracy=accuracy,
                                                   midpoint=True).collect()}
    for g, vals in (("hot", hot), ("cont", cont), ("small", small)):
        want = np.quantile(vals, probs)
        assert got[g] == pytest.approx(list(want), abs=1e-9), g
        assert med[g] == pytest.approx(float(np.median(vals)), abs=1e-9)


def test_boxplot_whiskers_include_quartiles_when_outliers(spark):
    # 0, 10, 10, 10: q1 = 7.5, q3 = 10, IQR = 2.5, 0 is an outlier; the lower
    # whisker is the range of (quartiles, inside values) = 7.5, not 10.
    df = spark.createDataFrame([("g", 0.0), ("g", 10.0), ("g", 10.0), ("g", 10.0)], "g string, v double")
    b = stats.boxplot_stats(df, ["g"], "v").first()
    assert (b.q1, b.q3, b.n_outliers) == (7.5, 10.0, 1)
    assert (b.lower_whisker, b.upper_whisker) == (7.5, 10.0)
    df2 = spark.createDataFrame([("g", float(x)) for x in (1, 2, 3, 4)], "g string, v double")
    b2 = stats.boxplot_stats(df2, ["g"], "v").first()
    assert (b2.lower_whisker, b2.upper_whisker, b2.n_outliers) == (1.0, 4.0, 0)


def test_global_boxplot_without_groups(spark):
    rng = np.random.default_rng(9)
    vals = rng.normal(10, 3, 200)
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    b = stats.boxplot_stats(df, [], "v").first()
    q1, q2, q3 = np.quantile(vals, [0.25, 0.5, 0.75])
    assert (b.q1, b.median, b.q3) == pytest.approx((q1, q2, q3), abs=1e-9)
    assert b.n == 200


def test_group_quantiles_approx_opt_in_within_rank_error(spark):
    rng = np.random.default_rng(13)
    vals = rng.normal(0, 1, 5000)
    df = spark.createDataFrame([("g", float(v)) for v in vals], "g string, v double")
    r = stats.group_quantiles(df, ["g"], "v", [0.5], ["m"], accuracy=100, exact=False).first()
    rank = (vals < r.m).sum()
    assert abs(rank - 2500) <= 5000 / 100 + 1


def test_gaps_with_missing_and_repeated_ids(spark):
    """Every row against the reference's lag over rows in order; the summary agrees with the rows."""
    import datetime as dt
    from acvlens.operators.gaps import purchase_cycles, purchase_gaps
    day = lambda k: dt.date(2020, 1, 1) + dt.timedelta(days=k)
    rows = [("a", None, day(0)), ("a", None, day(31)),                       # missing ids
            ("b", "x", day(0)), ("b", "x", day(31)), ("b", "x", day(31)),    # one id twice on a day
            ("c", None, day(5)), ("c", "1", day(5)), ("c", "2", day(9)), ("c", None, day(9)), ("c", "3", None),
            (None, "q", day(1)), (None, "q", day(3))]
    df = spark.createDataFrame(rows, "g string, id string, d date")
    gaps = purchase_gaps(df, ["g"], "d", "id", 1000).collect()
    want = {}
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g and r[2]), key=lambda r: (r[2], r[1] is None, r[1] or ""))
        want[g] = sorted(float((b[2] - a[2]).days) for a, b in zip(own, own[1:]))
    got = {}
    for r in gaps:
        got.setdefault(r.g, []).append(r.cycle_days)
    assert {g: sorted(v) for g, v in got.items()} == want
    cycles = {r.g: r for r in purchase_cycles(df, ["g"], "d", "id", 1000).collect()}
    for g, v in want.items():
        assert cycles[g].num_opportunities == len(v) + 1 and abs(cycles[g].avg_cycle - sum(v) / len(v)) < 1e-9


def test_default_pivot_years_are_those_in_the_data(spark):
    import datetime as dt
    from dataclasses import replace
    from decimal import Decimal
    from acvlens.params import FIXTURE_PARAMS, WON
    from acvlens.plans import referral
    from acvlens.sources.schemas import OPPORTUNITY
    p = replace(FIXTURE_PARAMS, years=None)
    rows = [{"Id": str(y), "StageName": WON, "CloseDate": dt.date(y, 3, 1), "ACV_for_Quotas__c": Decimal("5.00"),
             "Referring_CPA__c": "r"} for y in (1998, 2000, 2003)]
    opp = spark.createDataFrame([tuple(r.get(f.name) for f in OPPORTUNITY.fields) for r in rows], OPPORTUNITY)
    assert referral.win_pct_summary(opp, p).columns == ["category", "1998", "2000", "2003"]
    assert referral.referral_yearly_unique(opp, p).columns == ["metric", "1998", "2000", "2003"]
    assert referral.referral_yearly_credit(opp, p).columns == ["metric", "1998", "2000", "2003"]


def test_wrong_bracket_is_an_error(spark, monkeypatch):
    """A sketch that is off must stop the job, not give a wrong quantile."""
    import pytest
    from acvlens.operators import stats
    df = spark.range(5000).selectExpr("id % 2 AS g", "double(id) AS v")
    args = (df, ["g"], "v", [0.5], ["m"], 100)
    right = {r.g: r.m for r in stats.group_quantiles(*args).collect()}
    assert right == {0: 2499.0, 1: 2500.0}
    real = stats.F.expr
    monkeypatch.setattr(stats.F, "expr", lambda x: real(x.replace("percentile_approx(__v,", "percentile_approx(__v + 1000,")))
    with pytest.raises(Exception, match="outside its sketched bracket"):
        stats.group_quantiles(*args).collect()
