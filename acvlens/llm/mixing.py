"""Mixing sources to target weights by soft membership.

A classifier fitted on labelled rows gives every document a posterior over
domains; its tokens count for the domains in these proportions.  Document
rates r >= 0 are fitted so that the expected domain totals
sum_i r_i * tokens_i * p_i match the targets, by projected gradient steps on
the (scaled) squared error.  Steps are taken in the token-weighted inner
product, where the gradient of a document is its posterior times the scaled
error: documents of equal posterior get equal rates whatever their length.
Where these steps stall or run out before the targets are met (overlapping
posteriors), Newton steps on the dual follow; an error that remains after them
is in ``Rates`` and in a warning, per domain.

Scale.  A step needs one aggregate of D sums over (tokens, posterior, rate):
tasks add up their rows in arrays.  The steps' coefficients travel with the
function, so every step is the same short plan, compiled once; the driver
would otherwise keep the text and the code of a new plan for each.
A rate depends on the posterior and the steps' few coefficients alone, so it is
applied to the documents in the pass that classifies them, without a join.
The classifier is fitted on a bounded sample (``SAMPLE_ROWS`` labelled ids);
the totals cover all rows.

A rate of 2.3 means two copies, and a third one with probability 0.3 by a hash of
the document's id and text: deterministic, and right in expectation.

Defined cases: null text is empty: it has no tokens and the posterior of the
bias alone; a domain without labelled rows is left out of the targets and the
other weights are scaled up; without labelled rows all posteriors are uniform;
without tokens all rates are 1; a null doc_id is kept; repeated rows are mixed
alike.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import SparseRows, batches_bytes, fresh, key_text, pieces, slices, stash, with_field
from .features import hashed, word_counts

SAMPLE_ROWS = 8192
BITS = 16
BLOCK_ROWS = 512
STEPS = 48
TOLERANCE = 1e-4   # of the total: largest error of a domain at which the fit ends
STALL = 1e-6       # of the total: change of the domain totals at which it ends as well
SEED = 10


@dataclass
class DomainModel:
    domains: list[str]
    weights: np.ndarray   # (2^bits, domains)
    bias: np.ndarray

    def posterior(self, counts: dict[bytes, int]) -> np.ndarray:
        bits = int(len(self.weights)).bit_length() - 1
        index, value = hashed(counts, bits)
        z = self.bias + value @ self.weights[index]
        e = np.exp(z - z.max())
        return e / e.sum()


def fit_domains(labelled: DataFrame, domains: list[str], bits: int = BITS, steps: int = 100,
                rate: float = 0.3, ridge: float = 1e-5) -> DomainModel:
    """Softmax regression on ``labelled`` (text, domain), a bounded sample (see ``labelled_domains``)."""
    known = labelled.select(labelled["text"].cast("string").alias("text"), labelled["domain"].cast("string").alias("domain"))
    sample = (known.where(F.col("text").isNotNull() & F.col("domain").isin(domains)).distinct()
              .withColumn("h", F.xxhash64("text", "domain")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = [hashed(word_counts(t), bits) for t in batches_bytes(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("h"), batch.column("domain"), pa.array([i.tobytes() for i, _ in rows], pa.binary()),
                 pa.array([v.tobytes() for _, v in rows], pa.binary())], names=["h", "domain", "i", "v"])

    found = stash(sample.mapInArrow(run, "h long, domain string, i binary, v binary"))
    rows = SparseRows(pieces(found, "h", F.expr("octet_length(i) + octet_length(v)")), ["h", "domain"])
    first: dict[tuple[int, str], int] = {}
    for r, of in enumerate(zip(rows.keys["h"], rows.keys["domain"])):
        first.setdefault(of, r)
    names = [d for d in domains if any(of[1] == d for of in first)]
    if not names:
        return DomainModel(list(domains), np.zeros((1 << bits, len(domains)), np.float32), np.zeros(len(domains)))
    order = sorted(first)
    y = np.array([names.index(d) for _, d in order])
    weights, b = fit_softmax(*rows.sorted_by([first[of] for of in order]), y, len(names), bits, steps, rate, ridge)
    return DomainModel(names, weights, b)


def fit_softmax(index: np.ndarray, value: np.ndarray, sizes: np.ndarray, y: np.ndarray, k: int, bits: int,
                steps: int, rate: float, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias) of ``k`` classes by AdaGrad steps over all rows.

    The rows' features are concatenated in ``index`` and ``value``; ``sizes``
    says how many belong to each row.  ``index`` is overwritten.
    """
    n = len(y)
    number = np.zeros(1 << bits, np.int32)
    number[index] = 1
    used = np.flatnonzero(number)
    number[used] = np.arange(len(used), dtype=np.int32)
    # Rows are worked on in blocks, so that a step's temporary arrays stay small.
    ends = np.concatenate([[0], np.cumsum(sizes)])
    blocks = [(p, min(p + BLOCK_ROWS, n)) for p in range(0, n, BLOCK_ROWS)]
    parts = [(p, q, index[ends[p]:ends[q]], value[ends[p]:ends[q]], sizes[p:q]) for p, q in blocks]
    for _, _, column, _, _ in parts:
        column[:] = number[column]
    w, b = np.zeros((len(used), k)), np.log(np.bincount(y, minlength=k) / n)
    squares = np.full((len(used), k), 1e-8)
    for _ in range(steps):
        g, by_bias = ridge * w, np.zeros(k)
        for p, q, column, x, counts in parts:
            of = np.repeat(np.arange(q - p, dtype=np.int32), counts)
            z = b + np.stack([np.bincount(of, weights=w[column, c] * x, minlength=q - p) for c in range(k)], axis=1)
            e = np.exp(z - z.max(axis=1, keepdims=True))
            d = (e / e.sum(axis=1, keepdims=True) - np.eye(k)[y[p:q]]) / n
            for c in range(k):
                g[:, c] += np.bincount(column, weights=d[of, c] * x, minlength=len(used))
            by_bias += d.sum(axis=0)
        squares += g * g
        w -= rate * g / np.sqrt(squares)
        b -= rate * by_bias
    weights = np.zeros((1 << bits, k), np.float32)
    weights[used] = w
    return weights, b


@dataclass
class Rates:
    """Fitted rates: the steps' coefficients, and what they reach."""

    moves: list[np.ndarray]
    least: float
    start: float
    targets: np.ndarray
    totals: np.ndarray

    def off(self) -> float:
        """Largest error of a domain's total."""
        return float(np.abs(self.totals - self.targets).max())

    def of(self, posteriors: np.ndarray) -> np.ndarray:
        rate = np.full(len(posteriors), self.start)
        for move in self.moves:
            rate = np.maximum(self.least, rate - posteriors @ move)
        return rate


def with_posteriors(docs: DataFrame, model: DomainModel, rates: Rates | None = None, into: str = "mix") -> DataFrame:
    """All columns of ``docs`` and a struct column ``into`` (tokens, p array<double>, rate)."""
    body = fresh("body", docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, body):
            counts = [word_counts(t) for t in batches_bytes(batch, body)]
            p = np.array([model.posterior(c) for c in counts])
            mix = pa.StructArray.from_arrays(
                [pa.array([sum(c.values()) for c in counts], pa.int64()),
                 pa.array(list(p), pa.list_(pa.float64())),
                 pa.array(rates.of(p) if rates else np.ones(len(p)))], names=["tokens", "p", "rate"])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], mix], names=[*batch.schema.names[:-1], into])

    named = docs.withColumn(body, docs["text"].cast("string"))
    return named.mapInArrow(run, with_field(docs.schema, into, "tokens bigint, p array<double>, rate double"))


def fit_rates(mixed: DataFrame, model: DomainModel, weights: dict[str, float], least: float = 0.0,
              total: float | None = None, steps: int = STEPS) -> Rates:
    """Rates for the posteriors in ``mixed`` (column ``mix``) whose domain totals match the targets.

    ``total``: tokens to reach; None: those there are, or with ``least`` > 0 the
    smallest number of which every domain's share covers its own ``least``.
    """
    k = len(model.domains)
    pairs = [(a, b) for a in range(k) for b in range(a, k)]
    sums = mixed.agg(*[F.sum(F.expr(f"mix.tokens * mix.p[{a}]")) for a in range(k)],
                     *[F.sum(F.expr(f"mix.tokens * mix.p[{a}] * mix.p[{b}]")) for a, b in pairs]).first()
    there = np.array([x or 0.0 for x in sums[:k]])
    start = max(1.0, least)
    rates = Rates([], float(least), start, there, there * start)
    if there.sum() == 0:
        return rates
    h = np.zeros((k, k))
    for (a, b), x in zip(pairs, sums[k:]):
        h[a, b] = h[b, a] = x or 0.0
    share = np.array([weights.get(d, 0.0) for d in model.domains])
    share = share / share.sum() if share.sum() else there / there.sum()
    if total is None:
        wanted = share > 0
        total = (there[wanted] * least / share[wanted]).max() if least else there.sum()
    rates.targets = share * total
    scale = 1 / np.maximum(np.diag(h), 1e-12)
    step = 1 / np.linalg.eigvalsh(np.sqrt(scale)[:, None] * h * np.sqrt(scale)).max()
    state = mixed.select("mix.tokens", "mix.p")
    while len(rates.moves) < steps and rates.off() > TOLERANCE * total:
        rates.moves.append(step * scale * (rates.totals - rates.targets))
        moves = Rates(list(rates.moves), rates.least, start, there, there)
        before, rates.totals = rates.totals, _summed(state, k, lambda t, p: (t * moves.of(p)) @ p)
        if np.abs(rates.totals - before).max() <= STALL * total:
            break
    if rates.off() > TOLERANCE * total:
        _ascend(state, start, rates, total, steps)
    if rates.off() > TOLERANCE * total:
        warnings.warn("mixing: domain totals are off target by " + ", ".join(
            f"{d} {x:+.6g}" for d, x in zip(model.domains, rates.totals - rates.targets)) + f" of {total:.6g} tokens")
    return rates


def _summed(state: DataFrame, width: int, of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of ``state`` (tokens, p) of ``width`` numbers: ``of`` gives them for some rows' tokens and posteriors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                tokens = batch.column("tokens").to_numpy(zero_copy_only=False).astype(np.float64)
                total += of(tokens, batch.column("p").flatten().to_numpy(zero_copy_only=False).reshape(len(tokens), -1))
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total.tolist()], names=[f"s{i}" for i in range(width)])

    parts = state.mapInArrow(run, ", ".join(f"s{i} double" for i in range(width)))
    return np.array([x or 0.0 for x in parts.agg(*[F.sum(c) for c in parts.columns]).first()])


def _ascend(state: DataFrame, start: float, rates: Rates, total: float, steps: int) -> None:
    """Newton ascent of the concave dual, for posteriors that overlap so much that gradient steps stall.

    Of all rates that meet the targets it leads to those nearest ``start``: one
    move, clipped at ``least``.  ``rates`` is changed where the error gets smaller.
    """
    k = len(rates.targets)

    least = rates.least

    def at(move: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        def sums(tokens: np.ndarray, p: np.ndarray) -> np.ndarray:
            r = np.maximum(least, start - p @ move)
            h = p.T @ (p * (tokens * (r > least))[:, None])
            return np.concatenate([(tokens * r) @ p, [tokens @ (r - start) ** 2 / 2], h.ravel()])

        got = _summed(state, k + 1 + k * k, sums)
        totals = got[:k]
        return totals, got[k + 1:].reshape(k, k), float(got[k] + move @ (totals - rates.targets))

    move = np.zeros(k)
    totals, h, height = at(move)
    for _ in range(steps):
        error = totals - rates.targets
        if np.abs(error).max() < rates.off():
            rates.moves, rates.totals = [move], totals
        if rates.off() <= TOLERANCE * total:
            return
        up = np.linalg.solve(h + 1e-9 * (np.trace(h) + total * 1e-6) * np.eye(k), error)
        for n in range(12):
            there = at(move + up / 2 ** n)
            if there[2] >= height + 1e-4 * float(up @ error) / 2 ** n:
                break
        else:
            return
        move = move + up / 2 ** n
        totals, h, height = there


def labelled_domains(docs: DataFrame, labels: DataFrame, domain: str = "lang",
                     sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, domain) of documents that the labelled table rates good and not toxic.

    A bounded sample: the ``sample_rows`` such ids of smallest hash (those of
    them that ``docs`` has), shipped to the scan of ``docs``.
    """
    good = (labels.where((labels["quality"].cast("int") == 1) & (labels["toxic"].cast("int") == 0))
            .select(labels["doc_id"].cast("long").alias("id")).where("id IS NOT NULL").distinct())
    chosen = good.orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    named = docs.select(docs["doc_id"].cast("long").alias("id"), docs["text"].alias("text"), docs[domain].alias("domain"))
    return named.join(F.broadcast(chosen), "id", "left_semi").select("text", "domain")


def mixing_rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float], least: float = 0.0) -> DataFrame:
    """doc_id, tokens, domain (most likely), p_domain, rate, copies for every row of ``docs``."""
    model = fit_domains(labelled_domains(docs, labels), list(weights))
    mixed = stash(with_posteriors(key_text(docs), model)
                  .select("doc_id", F.xxhash64("text").alias("h"), "mix"))
    rates = fit_rates(mixed, model, weights, least)
    names = F.array(*[F.lit(d) for d in model.domains])
    top = F.array_max("mix.p")
    return (_rated(mixed, rates)
            .select("doc_id", F.col("mix.tokens").alias("tokens"),
                    F.element_at(names, F.array_position("mix.p", top).cast("int")).alias("domain"),
                    F.round(top, 6).alias("p_domain"), F.round("rate", 6).alias("rate"),
                    F.expr(_copies("rate", "doc_id", "h")).alias("copies")))


def _rated(mixed: DataFrame, rates: Rates) -> DataFrame:
    """``mixed`` with the column ``rate``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.array(batch.column("mix").field("p").to_pylist()).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rates.of(p))],
                                             names=[*batch.schema.names, "rate"])

    return mixed.mapInArrow(run, StructType([*mixed.schema.fields, StructField("rate", DoubleType())]))


def _copies(rate: str, doc_id: str, text_hash: str) -> str:
    unit = f"(pmod(xxhash64({SEED}, {doc_id}, {text_hash}), {1 << 40}L) / {float(1 << 40)!r}D)"
    return f"CAST(floor({rate} + {unit}) AS int)"


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float], least: float = 0.0) -> DataFrame:
    """Every row of ``docs`` as often as its rate says, with all of its columns."""
    model = fit_domains(labelled_domains(docs, labels), list(weights))
    rates = fit_rates(stash(with_posteriors(key_text(docs), model).select("mix")), model, weights, least)
    into, copy = fresh("mix", docs), fresh("copy", docs)
    copies = _copies(f"{into}.rate", "CAST(doc_id AS bigint)", "xxhash64(CAST(text AS string))")
    kept = [f"`{c}`" for c in docs.columns]
    return (with_posteriors(docs, model, rates, into)
            .selectExpr(*kept, f"explode(sequence(1, greatest({copies}, 1))) AS {copy}", f"{copies} AS {into}")
            .where(f"{into} > 0").select(*kept))
