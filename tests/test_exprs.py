"""Missing-value, rounding and formatting rules (FIXTURES.md literal rows)."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from acvlens.functions import exprs as E
from acvlens.operators.categories import by_category


def test_na_distinct_counts_missing_as_a_value(spark):
    df = spark.createDataFrame([("a",), (None,), ("",)], "s string")
    both = by_category(df.withColumn("g", F.lit(1)), ["g"], "s", "b", {"n": E.n()})
    assert df.agg(E.n_distinct("s")).first()[0] == both.first().b == 3


def test_n_distinct_without_missing(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "s string")
    assert df.agg(E.n_distinct("s")).first()[0] == 2


def test_all_na_sum_is_zero(spark):
    df = spark.createDataFrame([("g", None), ("g", None)], "g string, x decimal(18,2)")
    row = df.groupBy("g").agg(E.sum0("x").alias("s")).first()
    assert row.s == Decimal("0.00")


def test_present_is_never_null(spark):
    df = spark.createDataFrame([(None,), ("",), ("x",)], "s string")
    assert [r[0] for r in df.select(E.present("s")).collect()] == [False, False, True]


def test_half_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "x double")
    assert [r[0] for r in df.select(E.r_round("x")).collect()] == [0.0, 2.0, 2.0]


def test_bad_dates_become_null(spark):
    df = spark.createDataFrame([("",), ("13/45/2020",), ("1/5/2020",), ("01/05/2020",)], "s string")
    got = [r[0] for r in df.select(E.mdy("s")).collect()]
    assert got == [None, None, dt.date(2020, 1, 5), dt.date(2020, 1, 5)]
    strict = [r[0] for r in df.select(E.mdy_strict("s")).collect()]
    assert strict == got


def test_dollar_formats(spark):
    df = spark.createDataFrame([(Decimal("1234.50"),), (Decimal("-2.5"),), (Decimal("1234567.49"),)],
                               "x decimal(18,2)")
    got = [r[0] for r in df.select(E.dollar("x")).collect()]
    assert got == ["$1,234", "-$2", "$1,234,567"]


def test_dollar_auto_shows_cents_only_for_small_fractional(spark):
    df = spark.createDataFrame([(Decimal("1234.50"),), (Decimal("1234.00"),), (Decimal("123456.78"),)],
                               "x decimal(18,2)")
    got = [r[0] for r in df.select(E.dollar_auto("x")).collect()]
    assert got == ["$1,234.50", "$1,234", "$123,457"]


def test_currency_two_decimals(spark):
    df = spark.createDataFrame([(1234.5,), (0.125,)], "x double")
    assert [r[0] for r in df.select(E.currency("x")).collect()] == ["$1,234.50", "$0.12"]


def test_number_text_like_as_character(spark):
    df = spark.createDataFrame([(50.0,), (53.8,), (53.84615,)], "x double")
    assert [r[0] for r in df.select(E.num_text("x")).collect()] == ["50", "53.8", "53.84615"]
    assert [r[0] for r in df.select(E.pct_text("x")).collect()] == ["50%", "53.8%", "53.8%"]


def test_zero_share_is_null_not_error(spark):
    df = spark.createDataFrame([(Decimal("0"), Decimal("0"))], "a decimal(18,2), b decimal(18,2)")
    assert df.select(E.safe_ratio(F.col("a"), F.col("b"))).first()[0] is None


def test_constant_column_correlation_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 5.0)], "x double, y double")
    assert df.agg(E.corr0("x", "y")).first()[0] is None


def test_correlation_skips_incomplete_pairs(spark):
    import numpy as np
    rows = [(1.0, 2.0), (2.0, None), (3.0, 7.0), (None, 1.0), (4.0, 8.5), (5.0, 9.0)]
    df = spark.createDataFrame(rows, "x double, y double")
    xs = np.array([r[0] for r in rows if r[0] is not None and r[1] is not None])
    ys = np.array([r[1] for r in rows if r[0] is not None and r[1] is not None])
    assert abs(df.agg(E.corr0("x", "y")).first()[0] - np.corrcoef(xs, ys)[0, 1]) < 1e-12


def test_year_filter_is_a_date_range(spark):
    df = spark.createDataFrame([(dt.date(2017, 12, 31),), (dt.date(2018, 1, 1),), (None,)], "d date")
    assert df.filter(E.year_at_least("d", 2018)).count() == 1


def test_lenient_dates(spark):
    cases = {"1/5/85": "1985-01-05", "1/5/68": "2068-01-05", "1/5/69": "1969-01-05", "01-05-2020": "2020-01-05",
             "1.5.2020": "2020-01-05", "Jan 5, 2020": "2020-01-05", "January 5 2020": "2020-01-05",
             "jan. 5 20": "2020-01-05", "01052020": "2020-01-05", "010520": "2020-01-05", "13/1/2020": None,
             "2/30/2020": None, "": None, "x": None, "Janitor 5 2020": None, None: None, " 1/2/2003 ": "2003-01-02"}
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    got = {r.t: r.d and str(r.d) for r in df.select("t", E.mdy("t").alias("d")).collect()}
    assert got == cases


def test_a_date_is_parsed_once(spark):
    """Few pattern calls in the expression, and the analyses read the written date instead of parsing again."""
    import re
    from acvlens.params import FIXTURE_PARAMS as P
    from acvlens.plans import cycles
    from acvlens.sources import fixtures as fx
    from conftest import SF_SMALL
    calls = r"(?i)\b(regexp_replace|regexp_extract|rlike|split|gettimestamp)\b"
    one = spark.createDataFrame([("1/5/2020",)], "s string").select(E.mdy("s").alias("d"))
    assert len(re.findall(calls, one._jdf.queryExecution().optimizedPlan().toString())) <= 12
    rep = fx.opp_report(spark, SF_SMALL)
    assert not re.findall(calls, cycles.purchase_gaps(rep, P)._jdf.queryExecution().optimizedPlan().toString())
    assert len(re.findall(calls, cycles.purchase_cycles(rep, P)._jdf.queryExecution().optimizedPlan().toString())) <= 12


def test_lenient_dates_keep_their_rules(spark):
    want = {"Jan 5, 2020": dt.date(2020, 1, 5), " january-05-20 ": dt.date(2020, 1, 5), "Sept. 7 1999": dt.date(1999, 9, 7),
            "010569": dt.date(1969, 1, 5), "01052068": dt.date(2068, 1, 5), "1.5.68": dt.date(2068, 1, 5),
            "Janu 5 2020": dt.date(2020, 1, 5), "Jax 5 2020": None, "5/2020": None, "2/30/2020": None, "1/5/202": None,
            "  ": None, None: None, "1 / 5 / 2020": dt.date(2020, 1, 5), "1//5//2020": dt.date(2020, 1, 5)}
    got = {r.s: r.d for r in spark.createDataFrame([(k,) for k in want], "s string").select("s", E.mdy("s").alias("d")).collect()}
    assert got == want
