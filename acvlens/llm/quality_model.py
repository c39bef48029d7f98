"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades are ordered (0 toxic, 1 poor, 2 good).  One weight vector over hashed
text features gives a score s; ordered thresholds t1 < t2 turn it into tail
probabilities P(grade > k) = sigmoid(s - t[k]); they share the weights.  From
these come the expected grade and the probability of the top grade, by which
documents are selected.

The model is fitted on a bounded sample (``sample_rows`` labelled documents,
those with the smallest hash of their id, and of them the ``SAMPLE_ENTRIES`` features
of smallest hash of id and text) by gradient steps on the likelihood;
only the hashed features of the sample reach the driver, a few MB at a time.  Scoring is map-only
over whole texts; the weights (2^bits floats) are the only thing shipped.

Defined cases: null text is empty and scores like any text without words;
null or unknown labels are not used; without labelled documents of at least two
grades nothing is rejected (probability 1); ties in the sample hash go by id;
a null doc_id cannot be labelled but is scored; repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SparseRows, batches_bytes, bounded, fresh, key_text, pieces, slices, with_field
from .features import text_features

SAMPLE_ROWS = 16384
SAMPLE_ENTRIES = 1 << 23   # hashed features of them that the driver takes at most
BITS = 18
BLOCK_ROWS = 1024
KEEP_AT = 0.5


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray   # ascending; P(grade > k) = sigmoid(score - thresholds[k])
    bits: int

    def score(self, index: np.ndarray, value: np.ndarray) -> float:
        return float((self.weights[index] * value).sum())

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) per score (rows) and threshold (columns)."""
        return _sigmoid(scores[:, None] - self.thresholds[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_ordinal(index: np.ndarray, value: np.ndarray, sizes: np.ndarray, grades: np.ndarray, n_grades: int, bits: int,
                steps: int = 150, rate: float = 0.2, prior: float = 0.5) -> OrdinalModel:
    """Maximum likelihood of the cumulative-link model by Adam steps over all rows.

    The rows' features are concatenated in ``index`` and ``value``; ``sizes``
    says how many belong to each row.
    """
    n, width = len(sizes), 1 << bits
    # Rows are worked on in blocks, so that a step's temporary arrays stay small.
    ends = np.concatenate([[0], np.cumsum(sizes)])
    blocks = [(a, min(a + BLOCK_ROWS, n)) for a in range(0, n, BLOCK_ROWS)]
    parts = [(a, b, index[ends[a]:ends[b]], value[ends[a]:ends[b]], sizes[a:b]) for a, b in blocks]
    share = np.array([(grades > k).mean() for k in range(n_grades - 1)]).clip(1e-3, 1 - 1e-3)
    first = -np.log(share / (1 - share))
    # Thresholds as the first one and the logarithms of the gaps: always ordered.
    theta = np.concatenate([first[:1], np.log(np.maximum(np.diff(first), 0.1))])
    p = np.concatenate([np.zeros(width), theta])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        w, t = p[:width], _thresholds(p[width:])
        short = w.astype(np.float32)
        s = np.concatenate([np.bincount(np.repeat(np.arange(b - a), k), weights=short[i] * x, minlength=b - a)
                            for a, b, i, x, k in parts])
        bound = np.concatenate([[-np.inf], t, [np.inf]])
        up, down = _sigmoid(bound[grades + 1] - s), _sigmoid(bound[grades] - s)
        up, down = np.where(grades == n_grades - 1, 1.0, up), np.where(grades == 0, 0.0, down)
        within = np.maximum(up - down, 1e-9)
        by_score = ((1 - up - down) / n).astype(np.float32)
        grad_t = np.zeros(n_grades + 1)
        np.add.at(grad_t, grades + 1, -up * (1 - up) / within / n)
        np.add.at(grad_t, grades, down * (1 - down) / within / n)
        g_t = grad_t[1:-1]
        gaps = np.exp(p[width + 1:])
        g_w = prior / n * w
        for a, b, i, x, k in parts:
            g_w += np.bincount(i, weights=np.repeat(by_score[a:b], k) * x, minlength=width)
        g = np.concatenate([g_w, [g_t.sum()], [g_t[j + 1:].sum() * gaps[j] for j in range(len(gaps))]])
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8) * (1 - step / (steps + 1))
    return OrdinalModel(p[:width].astype(np.float32), _thresholds(p[width:]), bits)


def _thresholds(p: np.ndarray) -> np.ndarray:
    return p[0] + np.concatenate([[0.0], np.cumsum(np.exp(p[1:]))])


def grades(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 toxic, 1 poor, 2 good; the worst of a document's labels."""
    q, t = labels["quality"].cast("int"), labels["toxic"].cast("int")
    grade = F.when(t == 1, 0).when(q == 0, 1).when(q == 1, 2)
    return (labels.select(labels["doc_id"].cast("long").alias("doc_id"), grade.alias("grade"))
            .where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.min("grade").alias("grade")))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, bits: int = BITS) -> OrdinalModel | None:
    """The model of a bounded sample of labelled documents; None without two grades."""
    chosen = grades(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    sample = key_text(docs).join(F.broadcast(chosen), "doc_id").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = [text_features(t, bits) for t in batches_bytes(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("grade"), batch.column("h"), pa.array([i.tobytes() for i, _ in rows], pa.binary()),
                 pa.array([v.tobytes() for _, v in rows], pa.binary())], names=["doc_id", "grade", "h", "i", "v"])

    hashes = sample.withColumn("h", F.xxhash64("doc_id", "text"))
    features = bounded(hashes.mapInArrow(run, "doc_id long, grade int, h long, i binary, v binary"), "h",
                       F.expr("octet_length(i) div 4"), SAMPLE_ENTRIES)
    rows = SparseRows(pieces(features, "h", F.expr("octet_length(i) + octet_length(v)")), ["doc_id", "grade", "h"])
    doc_id, grade, h = rows.keys["doc_id"], rows.keys["grade"], rows.keys["h"]
    if len(set(grade)) < 2:
        return None
    order = sorted(range(len(h)), key=lambda r: (doc_id[r], grade[r], h[r]))
    graded = np.array([grade[r] for r in order], np.int64)
    return fit_ordinal(*rows.sorted_by(order), graded, 3, bits)


def rate(docs: DataFrame, model: OrdinalModel | None, keep_at: float = KEEP_AT, into: str = "rating") -> DataFrame:
    """All columns of ``docs`` and a struct column ``into`` of expected_grade, p_good and selected."""
    body = fresh("body", docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, body):
            if model is None:
                tails = np.ones((batch.num_rows, 2))
            else:
                scores = [model.score(*text_features(t, model.bits)) for t in batches_bytes(batch, body)]
                tails = model.tails(np.array(scores))
            rating = pa.StructArray.from_arrays(
                [pa.array(tails.sum(axis=1)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= keep_at)],
                names=["expected_grade", "p_good", "selected"])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], rating], names=[*batch.schema.names[:-1], into])

    named = docs.withColumn(body, docs["text"].cast("string"))
    return named.mapInArrow(run, with_field(docs.schema, into, "expected_grade double, p_good double, selected boolean"))


def select_good(docs: DataFrame, labels: DataFrame, keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all of their columns."""
    into = fresh("rating", docs)
    return rate(docs, fit(docs, labels), keep_at, into).where(f"{into}.selected").drop(into)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, expected_grade, p_good and selected for every row of ``docs``."""
    rated = rate(key_text(docs), fit(docs, labels)).select("doc_id", "rating.*")
    return rated.select("doc_id", F.round("expected_grade", 9).alias("expected_grade"),
                        F.round("p_good", 9).alias("p_good"), "selected")
