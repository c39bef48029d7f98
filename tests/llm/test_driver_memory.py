"""What the driver holds while it fits: the sample comes in pieces, and the fits work in blocks."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from acvlens.llm import common, mixing, quality_model


@pytest.fixture()
def held(spark, monkeypatch):
    """Sizes of the features that the driver takes at once, with any method."""
    seen, frame = [], type(spark.range(0))
    for name in ("toPandas", "toArrow", "collect"):
        def taken(self, f=getattr(frame, name)):
            out = f(self)
            if {"i", "v"} <= set(self.columns):
                rows = out.to_pylist() if hasattr(out, "to_pylist") else out.to_dict("records") if hasattr(out, "to_dict") else out
                seen.append(sum(len(r["i"]) + len(r["v"]) for r in rows))
            return out
        monkeypatch.setattr(frame, name, taken)
    return seen


def _documents(spark, n=240, words=60):
    text = F.expr(f"array_join(transform(sequence(1, {words}), k -> concat('w', pmod(xxhash64(id, k), 3000))), ' ')")
    return spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.concat(text, F.lit(" ###"))).otherwise(text).alias("text"),
                                 F.when(F.col("id") % 2 == 0, "en").otherwise("de").alias("domain"))


def test_pieces_hold_every_row_once(spark):
    rows = common.stash(spark.range(3000).select("id", F.xxhash64("id").alias("h"), F.lit(10).alias("n")))
    tables = list(common.pieces(rows, "h", F.col("n"), 4000))
    assert sorted(i for t in tables for i in t.column("id").to_pylist()) == list(range(3000))
    assert 8 <= len(tables) <= 12 and max(t.num_rows for t in tables) <= 400
    runs = [sorted(t.column("h").to_pylist()) for t in tables]
    assert all(a[-1] < b[0] for a, b in zip(runs, runs[1:]))
    assert [t.num_rows for t in common.pieces(rows.where("false"), "h", F.col("n"))] == [0]


def test_the_classifier_takes_its_sample_in_pieces(spark, held, monkeypatch):
    docs = common.stash(_documents(spark))
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 3 != 0 AS int) AS quality", "0 AS toxic")
    whole = quality_model.fit(docs, labels)
    assert len(held) == 1
    monkeypatch.setattr(common.pieces, "__defaults__", (held[0] // 4, 1 << 16))
    cut = quality_model.fit(docs, labels)
    assert len(held) >= 5 and max(held[1:]) <= held[0] // 4 and sum(held[1:]) == held[0]
    assert np.array_equal(whole.weights, cut.weights) and np.array_equal(whole.thresholds, cut.thresholds)


def test_the_domains_take_their_sample_in_pieces(spark, held, monkeypatch):
    docs = common.stash(_documents(spark))
    whole = mixing.fit_domains(docs, ["en", "de", "fr"])
    monkeypatch.setattr(common.pieces, "__defaults__", (held[0] // 4, 1 << 16))
    cut = mixing.fit_domains(docs, ["en", "de", "fr"])
    assert len(held) >= 5 and max(held[1:]) <= held[0] // 4 and sum(held[1:]) == held[0]
    assert whole.domains == cut.domains == ["en", "de"]
    assert np.array_equal(whole.weights, cut.weights) and np.array_equal(whole.bias, cut.bias)


def plain_softmax(index, value, sizes, y, k, bits, steps, rate, ridge):
    """All rows at once."""
    n, width = len(y), 1 << bits
    x = np.zeros((n, width))
    np.add.at(x, (np.repeat(np.arange(n), sizes), index), value)
    w, b = np.zeros((width, k)), np.log(np.bincount(y, minlength=k) / n)
    squares = np.full((width, k), 1e-8)
    for _ in range(steps):
        z = x @ w + b
        e = np.exp(z - z.max(axis=1, keepdims=True))
        d = (e / e.sum(axis=1, keepdims=True) - np.eye(k)[y]) / n
        g = x.T @ d + ridge * w
        squares += g * g
        w -= rate * g / np.sqrt(squares)
        b = b - rate * d.sum(axis=0)
    return w, b


def _sample(n, words, bits):
    rng = np.random.default_rng(5)
    sizes = rng.integers(0, 2 * words, n)
    index = rng.integers(0, 1 << bits, sizes.sum()).astype(np.int32)
    return index, rng.uniform(0.01, 0.2, len(index)).astype(np.float32), sizes, np.arange(n) % 3


def test_softmax_in_blocks_is_the_same(monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 16)
    index, value, sizes, y = _sample(100, 20, 6)
    want = plain_softmax(index, value, sizes, y, 3, 6, 30, 0.3, 1e-5)
    got = mixing.fit_softmax(index.copy(), value, sizes, y, 3, 6, 30, 0.3, 1e-5)
    assert np.abs(got[0] - want[0]).max() < 1e-5 and np.abs(got[1] - want[1]).max() < 1e-9


def test_softmax_holds_little_beside_the_sample():
    index, value, sizes, y = _sample(4000, 500, 12)
    tracemalloc.start()
    mixing.fit_softmax(index, value, sizes, y, 3, 12, 2, 0.3, 1e-5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * len(index)      # all rows at once: over 40 bytes for each feature


def test_every_step_of_the_mixing_is_the_same_plan(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(int(n), p.tolist()) for n, p in zip(rng.integers(1, 900, 300), rng.dirichlet([0.6, 0.4, 0.5], 300))]
    mixed = common.stash(spark.createDataFrame(rows, "tokens long, p array<double>").select(F.struct("tokens", "p").alias("mix")))
    model = mixing.DomainModel(["a", "b", "c"], np.zeros((2, 3), np.float32), np.zeros(3))
    frame, plans = type(spark.range(0)), []

    def first(self, f=frame.first):
        plans.append(len(self._jdf.queryExecution().optimizedPlan().toString()))
        return f(self)
    monkeypatch.setattr(frame, "first", first)
    rates = mixing.fit_rates(mixed, model, {"a": 0.5, "b": 0.3, "c": 0.2}, least=1.0)
    steps = sorted(plans[1:])          # the first one takes the second moments; then gradient and Newton steps
    assert len(steps) >= 3 and sum(b - a > 20 for a, b in zip(steps, steps[1:])) <= 1 and steps[-1] < 1000, steps
    tokens, p = np.array([n for n, _ in rows], float), np.array([q for _, q in rows])
    assert np.allclose((tokens * rates.of(p)) @ p, rates.totals, rtol=1e-12)
