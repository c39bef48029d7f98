"""Quality rules: a decision list learned by sequential covering.

From documents rated poor (quality 0) and good a list of rules is learned
one at a time: a conjunction of thresholds on text statistics is grown
condition by condition for the largest information gain, then pruned on
held-out documents; the documents it covers are taken out and the next rule is
learned on the rest, until no rule reaches ``LEAST_PRECISION`` on held-out
documents.  The list is emitted as one ordered CASE expression over the
statistics' columns, which Spark evaluates like any other.

The statistics of every text are computed in one map-only pass.  Learning uses
a bounded sample (``sample_rows`` labelled documents, those with the smallest
hash of their id), of which only the statistics reach the driver.

Defined cases: null text has no words (and so fails the base rule); null
labels are not used, and of several labels of a document the worst counts;
without labels, or with one class, the list is empty and the base rules
decide; a null doc_id is judged like any other; repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_bytes, key_text, slices, stash

SAMPLE_ROWS = 16384
LEAST_PRECISION = 0.95
LEAST_COVERED = 3
MOST_RULES = 16
MOST_CONDITIONS = 4
CUTS = 48

_SPACE = b" \t\n\x0b\x0c\r"
_CONTINUED = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"
_LETTERS = bytes(c for c in range(256) if c >= 0x80 or chr(c).isalnum())
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_distinct", "n_upper", "n_same", "n_marks")
# Statistics that rules test, as SQL over the counts.
FEATURES = {
    "words": "double(n_words)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
    "distinct": "n_distinct / greatest(n_words, 1)",
    "upper": "n_upper / greatest(n_words, 1)",
    "same": "n_same / greatest(n_words, 1)",
    "marks": "n_marks / greatest(n_words, 1)",
}


def statistics(text: bytes) -> tuple[int, ...]:
    """COUNTS and MORE of a text."""
    tokens = text.split()
    n = len(tokens)
    lines = [x for x in text.split(b"\n") if x.split()]
    return (n, len(text.translate(None, _SPACE + _CONTINUED)), len(text) - len(text.translate(None, _SYMBOLS)),
            len(lines) - len(set(lines)), repeat_words(tokens), len(lines), len(set(tokens)),
            sum(map(bytes.isupper, tokens)), sum(map(bytes.__eq__, tokens[1:], tokens)),
            len(text.translate(None, _LETTERS + _SPACE)))


def repeat_words(tokens: list[bytes]) -> int:
    """Words in 3-word windows that occur at least twice."""
    n = len(tokens)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(t, len(number)) for t in tokens), np.int64, n)
    size = len(number)
    _, pair = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)
    _, which, count = np.unique(pair[:-1] * size + ids[2:], return_inverse=True, return_counts=True)
    again = count[which] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k:n - 2 + k] |= again
    return int(covered.sum())


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every row of ``docs``."""
    names = [*COUNTS, *MORE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = [statistics(t) for t in batches_bytes(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in zip(*rows))], names=["doc_id", *names])

    return key_text(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in names))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    at: float

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>=' if self.above else '<'} {self.at!r}D"

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, list(FEATURES).index(self.feature)]
        return v >= self.at if self.above else v < self.at


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    held = np.ones(len(x), bool)
    for c in rule:
        held &= c.holds(x)
    return held


def _grow(x: np.ndarray, bad: np.ndarray) -> Rule:
    """Add the condition of largest gain until only bad rows are covered."""
    rule: list[Condition] = []
    while len(rule) < MOST_CONDITIONS and len(bad) and not bad.all():
        p0, n0 = bad.sum(), (~bad).sum()
        best, gain = None, 0.0
        for k, name in enumerate(FEATURES):
            for at in np.unique(np.quantile(x[:, k], np.linspace(0.01, 0.99, CUTS))):
                high = x[:, k] >= at
                for above, held in ((True, high), (False, ~high)):
                    p, n = (bad & held).sum(), (~bad & held).sum()
                    if p >= LEAST_COVERED:
                        g = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                        if g > gain:
                            best, gain = Condition(name, above, round(float(at), 6)), g
        if best is None:
            break
        rule.append(best)
        held = best.holds(x)
        x, bad = x[held], bad[held]
    return tuple(rule)


def _worth(rule: Rule, x: np.ndarray, bad: np.ndarray) -> tuple[float, int]:
    """Precision and bad rows covered."""
    held = covers(rule, x)
    p, n = int((bad & held).sum()), int((~bad & held).sum())
    return (p / (p + n) if p + n else 0.0), p


def learn(x: np.ndarray, bad: np.ndarray) -> list[Rule]:
    """An ordered list of rules for ``bad`` rows of the statistics ``x``."""
    rules: list[Rule] = []
    kept = np.arange(len(x)) % 3 == 0       # held out for pruning
    while len(rules) < MOST_RULES and (bad & ~kept).sum() >= LEAST_COVERED:
        rule = _grow(x[~kept], bad[~kept])
        if not rule:
            break
        shorter = [rule[:k] for k in range(1, len(rule) + 1)]
        rule = max(shorter, key=lambda r: (lambda w: (2 * w[0] - 1, w[1], -len(r)))(_worth(r, x[kept], bad[kept])))
        precision, found = _worth(rule, x, bad)
        held_out, _ = _worth(rule, x[kept], bad[kept])
        if min(precision, held_out) < LEAST_PRECISION or found < LEAST_COVERED:
            break
        rules.append(rule)
        left = ~covers(rule, x)
        x, bad, kept = x[left], bad[left], kept[left]
    return rules


def expression(rules: list[Rule]) -> str:
    """The decision list as SQL: true where a document is kept."""
    lines = "".join(f" WHEN {' AND '.join(c.sql() for c in r)} THEN false" for r in rules)
    return f"CASE{lines} ELSE true END" if rules else "true"


def learn_rules(stats: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules from the statistics of a bounded sample of labelled documents."""
    quality = (labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("q"))
               .where("doc_id IS NOT NULL AND q IN (0, 1)").groupBy("doc_id").agg(F.min("q").alias("q")))
    chosen = quality.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = (stats.join(F.broadcast(chosen), "doc_id")
            .select("doc_id", "q", *[F.expr(e).alias(f) for f, e in FEATURES.items()]).distinct().toPandas())
    rows = rows.sort_values(["doc_id", *FEATURES], kind="stable")
    if rows["q"].nunique() < 2:
        return []
    return learn(rows[list(FEATURES)].to_numpy(float), (rows["q"] == 0).to_numpy())


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept for every row of ``docs``."""
    stats = stash(text_statistics(docs))
    rules = learn_rules(stats, labels)
    failed = "(n_words < 50 OR 100 * n_repeat_words > 50 * n_words)"
    return stats.selectExpr("doc_id", *COUNTS, f"{failed} AS base_failed",
                            f"NOT {failed} AND {expression(rules)} AS kept")
