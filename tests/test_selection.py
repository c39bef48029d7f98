"""Exact quantiles by narrowing brackets: results, and how many values the last pass ranks."""

import numpy as np
import pytest

from acvlens.operators import stats


@pytest.fixture(scope="module")
def skewed(spark):
    """Group a: 150,000 distinct values; b: half of them one value; c: two values; d: few rows; e: one row; g: missing."""
    return spark.sql("""
        SELECT 'a' AS g, CAST(xxhash64(id) AS double) / 1e12 AS v FROM range(150000)
        UNION ALL SELECT 'b', IF(id % 2 = 0, 5D, CAST(xxhash64(id, 1) AS double) / 1e12) FROM range(60000)
        UNION ALL SELECT 'c', CAST(id % 2 AS double) FROM range(30000)
        UNION ALL SELECT 'd', CAST(id AS double) FROM range(7)
        UNION ALL SELECT 'e', 1.5D UNION ALL SELECT NULL, CAST(id * id AS double) FROM range(4000)
        UNION ALL SELECT 'g', CAST(NULL AS double)""").repartition(6)


def numpy_quantiles(df, probs):
    found = {}
    for r in df.where("v IS NOT NULL").collect():
        found.setdefault(r.g, []).append(r.v)
    return {g: np.quantile(v, probs).tolist() for g, v in found.items()}


@pytest.mark.parametrize("accuracy, most", [(10000, 100_000), (100, 2000), (50, 1), (1000, 1)])
def test_quantiles_equal_numpy(spark, skewed, monkeypatch, accuracy, most):
    passes = []
    real = stats.materialize
    monkeypatch.setattr(stats, "materialize", lambda df: passes.append(1) or real(df))
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    names = ["p0", "p25", "p50", "p90", "p100"]
    got = stats.group_quantiles(skewed, ["g"], "v", probs, names, accuracy=accuracy, most=most)
    want = numpy_quantiles(skewed, probs)
    rows = {r.g: [r[n] for n in names] for r in got.collect()}
    assert rows.keys() == want.keys()
    for g in want:
        assert rows[g] == pytest.approx(want[g], rel=1e-12, abs=1e-12)
    assert (len(passes) > 1) == (accuracy <= 100)
    assert len(passes) < 8


def test_the_last_pass_ranks_a_bounded_number(spark):
    """A group of 400,000 distinct values with a coarse sketch: at most ``most`` of them lie in a bracket."""
    base = spark.range(400_000).selectExpr("'x' AS g", "CAST(xxhash64(id) AS double) AS __v")
    sketch = base.groupBy("g").agg(stats.F.expr("count(1) AS __n")).selectExpr(
        "g", "__n", "CAST('-Infinity' AS double) AS __lo0", "CAST('Infinity' AS double) AS __hi0",
        "200000L AS __klo0", "200001L AS __khi0", "0D AS __f0")
    row = stats._narrowed(base, sketch, ["g"], 1, 100, 1500).first()
    inside = base.where(f"__v >= {row['__lo0']!r}D AND __v <= {row['__hi0']!r}D").count()
    below = base.where(f"__v < {row['__lo0']!r}D").count()
    assert 2 <= inside <= 1600 and below < 200000 and 200001 <= below + inside


def test_ungrouped_and_empty(spark, skewed):
    one = stats.group_quantiles(skewed, [], "v", [0.5], ["m"], accuracy=100, most=500).first()
    values = [r.v for r in skewed.where("v IS NOT NULL").collect()]
    assert one.m == pytest.approx(float(np.quantile(values, 0.5)), rel=1e-12)
    assert stats.group_quantiles(skewed.where("false"), ["g"], "v", [0.5], ["m"]).count() == 0
