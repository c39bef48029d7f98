"""Property tests: number text and NA-aware aggregates against plain-Python rules."""

from decimal import ROUND_HALF_EVEN, Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from acvlens.functions import exprs as E
from acvlens.operators.categories import by_category

money = st.decimals(min_value=Decimal("-99999999999.99"), max_value=Decimal("99999999999.99"), places=2,
                    allow_nan=False, allow_infinity=False)


def r_dollar(x: Decimal) -> str:
    """scales::dollar(x, accuracy = 1): half-even to whole units, thousands separators."""
    r = x.quantize(Decimal("1"), rounding=ROUND_HALF_EVEN)
    return ("-" if r < 0 else "") + "$" + f"{abs(int(r)):,}"


def r_dollar_auto(x: Decimal) -> str:
    """scales::dollar(x): cents only for a fractional value of magnitude ≤ 100,000."""
    if abs(x) <= 100000 and x != x.to_integral_value(rounding="ROUND_FLOOR"):
        r = x.quantize(Decimal("0.01"), rounding=ROUND_HALF_EVEN)
        return ("-" if r < 0 else "") + "$" + f"{abs(r):,.2f}"
    return r_dollar(x)


@settings(max_examples=15, deadline=None)
@given(st.lists(money, min_size=1, max_size=40))
def test_dollar_text(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "x decimal(18,2)")
    got = [(r.a, r.b) for r in df.select(E.dollar("x").alias("a"), E.dollar_auto("x").alias("b")).collect()]
    assert got == [(r_dollar(x), r_dollar_auto(x)) for x in xs]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abc"), st.one_of(st.none(), st.sampled_from(["", "x", "y", "z"]))),
                min_size=1, max_size=60))
def test_n_distinct_counts_missing_once(spark, rows):
    df = spark.createDataFrame(rows, "g string, v string")
    a = df.groupBy("g").agg(E.n_distinct("v").alias("a"))
    b = by_category(df, ["g"], "v", "b", {"n": E.n()})
    got = {r.g: (r.a, r.b) for r in a.join(b, "g").collect()}
    for g in {g for g, _ in rows}:
        want = len({v for gg, v in rows if gg == g})          # None counts as one value
        assert got[g] == (want, want)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.one_of(st.none(), money), min_size=1, max_size=40))
def test_sum0_matches_na_rm_sum(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "x decimal(18,2)")
    got = df.agg(E.sum0("x")).first()[0]
    assert got == sum((x for x in xs if x is not None), Decimal("0"))


@settings(max_examples=10, deadline=None)
@given(st.lists(st.floats(min_value=0, max_value=100, allow_nan=False), min_size=1, max_size=30))
def test_pct_text_is_half_even_one_decimal(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(E.pct_text("x")).collect()]
    for x, s in zip(xs, got):
        assert s.endswith("%")
        v = Decimal(repr(x)).quantize(Decimal("0.1"), rounding=ROUND_HALF_EVEN)
        assert Decimal(s[:-1]) == v
        assert not s[:-1].endswith(".0")


def test_approx_distinct_opt_in_close(spark):
    df = spark.range(20000).selectExpr("CAST(id % 5000 AS STRING) AS v")
    exact, approx = df.agg(E.n_distinct("v"), E.n_distinct("v", approx=True)).first()
    assert exact == 5000 and abs(approx - 5000) <= 5000 * 0.1
