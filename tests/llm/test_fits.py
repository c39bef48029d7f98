"""Fitted parts against direct solutions; flat token files and repeated rows at their limits."""

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from acvlens.llm import common, quality_model, sharding, token_counts


def test_a_sample_is_bounded_by_size(spark):
    rows = spark.range(2000).select(F.xxhash64("id").alias("h"), F.lit(10).alias("n"))
    held = common.bounded(rows, "h", F.col("n"), 5000).collect()
    every = sorted(r.h for r in rows.collect())
    assert 450 <= len(held) <= 500 and sorted(r.h for r in held) == every[:len(held)]
    assert common.bounded(rows, "h", F.col("n"), 20000).count() == 2000
    assert common.bounded(rows.where("false"), "h", F.col("n"), 5).count() == 0


# Quality classifier: the likelihood, row by row

def negative_log_likelihood(weights, thresholds, rows, grades, prior):
    total = prior / 2 * sum(w * w for w in weights)
    for (index, value), g in zip(rows, grades):
        s = sum(weights[i] * v for i, v in zip(index, value))
        tail = [1.0] + [1 / (1 + math.exp(t - s)) for t in thresholds] + [0.0]
        total -= math.log(tail[g] - tail[g + 1])
    return total / len(rows)


def test_ordinal_fit_is_the_most_likely_model():
    rng = np.random.default_rng(3)
    truth, bits = rng.normal(0, 2, 8), 3
    rows, grades = [], []
    for _ in range(120):
        index = np.sort(rng.choice(8, 3, replace=False)).astype(np.int32)
        value = rng.uniform(0.2, 1, 3).astype(np.float32)
        s = truth[index] @ value + rng.logistic()
        rows.append((index, value))
        grades.append(int(s > -1) + int(s > 1.5))
    model = quality_model.fit_ordinal(np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows]),
                                      np.full(120, 3), np.array(grades), 3, bits)

    def value(x):
        return negative_log_likelihood(x[:8], [x[8], x[8] + math.exp(x[9])], rows, grades, 0.5)

    def slope(x):
        return np.array([(value(x + d) - value(x - d)) / 2e-5 for d in np.eye(10) * 1e-5])

    best, rate = np.concatenate([np.zeros(8), [-1.0, 0.5]]), 4.0     # descent with halved steps, from another start
    for _ in range(250):
        g = slope(best)
        while value(best - rate * g) > value(best) - 1e-4 * rate * (g @ g) and rate > 1e-6:
            rate /= 2
        best, rate = best - rate * g, rate * 1.5
    gap = math.log(model.thresholds[1] - model.thresholds[0])
    fitted = np.concatenate([model.weights, [model.thresholds[0], gap]])
    assert value(fitted) <= value(best) + 1e-4
    assert np.abs(model.weights - best[:8]).max() < 0.1


# Flat token files

def test_token_files_are_read_by_ranges(spark, tmp_dir):
    rng = np.random.default_rng(8)
    wanted, tails = Counter(), 0
    for name, n in (("a.bin", 300_000), ("b.bin", 4096), ("c.bin", 1), ("empty.bin", 0), ("d e.bin", 70_001)):
        tokens = rng.integers(0, 50256, n).astype("<u2")
        tokens[rng.random(n) < 0.001] = token_counts.SEPARATOR
        with open(f"{tmp_dir}/{name}", "wb") as f:
            f.write(tokens.tobytes())
        at = np.flatnonzero(tokens == token_counts.SEPARATOR)
        wanted.update(np.diff(np.concatenate([[-1], at])) - 1)
        tails += bool(n and (not len(at) or at[-1] != n - 1))
    for block in (512, 2 * token_counts.BLOCK_TOKENS):
        blocks = token_counts.read_token_files(spark, tmp_dir, block)
        got = token_counts.token_counts(blocks).collect()
        assert Counter(r.n_tokens for r in got if r.closed) == wanted
        assert sum(not r.closed for r in got) == tails
    spread = token_counts.read_token_files(spark, tmp_dir, 512).select("file", F.spark_partition_id().alias("p"))
    of_a = spread.where("file LIKE '%/a.bin'").groupBy("p").count().collect()
    assert len(of_a) == 8 and max(r["count"] for r in of_a) < 400


# Sharding of repeated rows

def test_repeated_rows_are_one_row_until_the_last_step(spark):
    hot = spark.range(5000).selectExpr("CAST(NULL AS bigint) AS doc_id", "'same' AS text", "id % 3 AS shard")
    some = spark.range(300).selectExpr("id % 90 AS doc_id", "concat('t', id % 30) AS text", "0L AS shard")
    docs = hot.union(some).union(spark.range(40).selectExpr("7L", "CAST(NULL AS string)", "1L"))
    plain = sorted(map(tuple, sharding.shard_documents(docs).collect()), key=repr)
    cut = sorted(map(tuple, sharding.shard_documents(docs, chunk=64).collect()), key=repr)
    assert plain == cut and len(plain) == 5340
    slots = {}
    for r in plain:
        slots.setdefault(r[4], []).append(r[5])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    spread = sharding.shard_documents(docs, chunk=64).where("doc_id IS NULL")
    assert len(spread.groupBy(F.spark_partition_id()).count().collect()) > 1
