"""Kernel densities by convolution over arrays against direct sums."""

import math

import numpy as np
import pytest

from acvlens.operators import stats


def test_density_of_many_groups(spark):
    """5,000 groups at 512 points; some of them against the sum over all values."""
    df = spark.range(60_000).selectExpr("id % 5000 AS g", "CAST(xxhash64(id) % 100000 AS double) / 100 AS v")
    out = stats.density(df, ["g"], "v")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate posexplode") == 1
    got = out.where("g IN (0, 1, 4999)").toPandas().sort_values(["g", "grid_index"])
    assert out.count() == 5000 * 512
    values = df.toPandas()
    for g, rows in got.groupby("g"):
        v = values.loc[values.g == g, "v"].to_numpy()
        z = (rows["x"].to_numpy()[:, None] - v) / rows["bw"].iloc[0]
        direct = np.exp(-0.5 * z * z).sum(axis=1) / (math.sqrt(2 * math.pi) * rows["bw"].iloc[0] * len(v))
        assert np.abs(rows["density"].to_numpy() - direct).max() < 1e-3 * direct.max()
        assert rows["n"].eq(12).all() and len(rows) == 512


def test_density_within_a_ten_thousandth_of_direct_sums(spark):
    df = spark.range(20_000).selectExpr("IF(id % 3 = 0, 'a', 'b') AS g", "sqrt(CAST(pmod(xxhash64(id), 1000000) AS double)) AS v")
    binned = {(r.g, r.grid_index): r.density for r in stats.density(df, ["g"], "v").collect()}
    direct = {(r.g, r.grid_index): r.density for r in stats.density(df, ["g"], "v", binned=False).collect()}
    assert binned.keys() == direct.keys() and len(binned) == 1024
    peak = max(direct.values())
    assert max(abs(binned[k] - direct[k]) for k in direct) < 1e-4 * peak


def test_density_of_equal_values_and_small_groups(spark):
    df = spark.createDataFrame([("one", 1.0), ("two", 3.0), ("two", 3.0), (None, 1.0), (None, 2.0), ("x", None)], "g string, v double")
    rows = stats.density(df, ["g"], "v", n_grid=8).collect()
    assert {r.g for r in rows} == {"two", None}
    two = [r for r in rows if r.g == "two"]
    assert len(two) == 8 and all(r.x == 3.0 for r in two) and two[0].density == pytest.approx(1 / (math.sqrt(2 * math.pi) * two[0].bw))
