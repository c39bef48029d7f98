"""Benchmark decontamination by a distributed positional inverted index.

The index is sharded by document: a segment holds the postings (term ->
ascending word positions) of about a million words of consecutive documents
and is one row of a stored Parquet table.  Postings are kept for the terms
that the test items use (the only ones a query can ask for), at all of their
positions.  A query walks each segment alone: per test window it takes the
posting list of the window's rarest term (rarest over the whole corpus),
shifts it by the term's offset, and intersects the shifted lists of the other
terms in order of rarity, smallest first.  What is left are the exact phrase
occurrences.  ``slack`` > 0 asks for proximity matches instead: every term of
the window within ``length + slack`` consecutive words, in any order.

Scale.  Building and querying are map-only; the only shuffle is the term
frequency (one row per test term and segment, summed map-side).  The test
side is shipped to the tasks in blocks of items of at most ``block_words``
words, so what a task holds does not grow with the corpus, and a larger test
set takes more blocks, not more memory.  A hot document group needs nothing
special: no key is shuffled.

Defined cases: null text has no words; an item without words matches nothing;
an item shorter than the window is one window; a null doc_id is kept and
repeated rows are reported once each; a null item_id counts as the item
"null"; tables without rows give an empty result (or no hits).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_bytes, fresh, key_text, slices, stash

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_TO_SPACE = bytes(c if re.match(WORD, bytes([c])) else 0x20 for c in bytes(range(256)).lower())

SEGMENT = ("doc_ids array<long>, hashes array<long>, lengths array<int>, terms array<int>, counts array<int>, positions binary")
MATCH = "doc_id long, text_hash long, n_words long, n_hit long, items array<string>, starts array<int>, spans array<int>"


def words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words of UTF-8 text: runs of 0-9, a-z and all beyond ASCII."""
    return text.translate(_TO_SPACE).split()


def text_hash(text: bytes) -> int:
    """What Spark's xxhash64 gives for the text: rows of equal text share it."""
    h = xxhash.xxh64_intdigest(text, 42)
    return h - (1 << 64) if h >> 63 else h


class Windows:
    """Test windows as arrays: term numbers (padded with -1), lengths, and their items."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                owners.setdefault(tuple(ids[i:i + window]), set()).add(item)
        self.width = window
        self.lengths = np.array([len(w) for w in owners], np.int64)
        self.terms = np.full((len(owners), window), -1, np.int64)
        for k, w in enumerate(owners):
            self.terms[k, :len(w)] = w
        self.items = [sorted(x) for x in owners.values()]

    def by_rarity(self, frequency: np.ndarray) -> np.ndarray:
        """Per window its offsets, those of the rarest terms first (absent ones last)."""
        cost = np.where(self.terms >= 0, frequency[np.maximum(self.terms, 0)], np.iinfo(np.int64).max)
        return np.argsort(cost, axis=1, kind="stable")


def build_index(docs: DataFrame, vocabulary: dict[bytes, int], segment_words: int = 1 << 20) -> DataFrame:
    """Segments of the positional index of all rows of ``docs`` (doc_id, text)."""
    def segment(parts: list[tuple[int | None, int, np.ndarray]]) -> pa.RecordBatch:
        lengths = np.array([len(x) for _, _, x in parts], np.int32)
        ids = np.concatenate([x for _, _, x in parts])
        at = np.flatnonzero(ids >= 0).astype(np.int32)
        at = at[np.argsort(ids[at], kind="stable")]
        terms, counts = np.unique(ids[at], return_counts=True)
        return pa.RecordBatch.from_arrays([
            pa.array([[k for k, _, _ in parts]], pa.list_(pa.int64())),
            pa.array([[h for _, h, _ in parts]], pa.list_(pa.int64())),
            pa.array([lengths], pa.list_(pa.int32())),
            pa.array([terms.astype(np.int32)], pa.list_(pa.int32())),
            pa.array([counts.astype(np.int32)], pa.list_(pa.int32())),
            pa.array([at.tobytes()], pa.binary())], names=[f.split()[0] for f in SEGMENT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in slices(batches, "text"):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batches_bytes(batch, "text")):
                found = words(text)
                ids = np.fromiter(map(vocabulary.get, found, repeat(-1)), np.int32, len(found))
                if held and n + len(ids) > segment_words:
                    yield segment(held)
                    held, n = [], 0
                held.append((doc_id, text_hash(text), ids))
                n += len(ids)
        if held:
            yield segment(held)

    return key_text(docs).mapInArrow(run, SEGMENT)


def term_frequencies(index: DataFrame, n_terms: int) -> np.ndarray:
    """Occurrences of every term in the whole index (one number per test term)."""
    rows = (index.select(F.explode(F.arrays_zip("terms", "counts")).alias("t"))
            .groupBy("t.terms").agg(F.sum("t.counts").alias("n")).collect())
    frequency = np.zeros(max(1, n_terms), np.int64)
    for term, n in rows:
        frequency[term] = n
    return frequency


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The concatenated ranges start .. start + count - 1."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts) + np.repeat(starts, counts)


class Postings:
    """One segment, opened for queries."""

    def __init__(self, lengths: list[int], terms: list[int], counts: list[int], positions: bytes, n_terms: int):
        self.doc_ends = np.cumsum(np.array(lengths, np.int64))
        self.n_words = int(self.doc_ends[-1]) if len(lengths) else 0
        self.positions = np.frombuffer(positions, np.int32).astype(np.int64)
        self.count = np.zeros(n_terms + 1, np.int64)
        self.count[np.array(terms, np.int64)] = counts
        self.first = np.concatenate([[0], np.cumsum(self.count)[:-1]])
        # The posting lists as one ascending list of (term, position), to look members up in.
        self.stride = self.n_words + 1
        self.keys = np.repeat(np.arange(n_terms + 1), self.count) * self.stride + self.positions

    def holds(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(term), bool)
        want = term * self.stride + position
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return (self.keys[at] == want) & (position >= 0) & (position < self.n_words)

    def doc_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.doc_ends, position, side="right")

    def phrases(self, w: Windows, order: np.ndarray, piece: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, start) of every exact occurrence, in bounded pieces."""
        which = np.arange(len(w.lengths))
        rarest = w.terms[which, order[:, 0]]
        n = self.count[rarest]
        for chosen in _split(np.flatnonzero(n), n, piece):
            window = np.repeat(chosen, n[chosen])
            start = self.positions[_ranges(self.first[rarest[chosen]], n[chosen])] - order[window, 0]
            for j in range(1, w.width):
                offset = order[window, j]
                term = w.terms[window, offset]
                keep = (term < 0) | self.holds(term, start + offset)
                window, start = window[keep], start[keep]
            keep = start >= 0
            window, start = window[keep], start[keep]
            keep = self.doc_of(start) == self.doc_of(start + w.lengths[window] - 1)
            yield window[keep], start[keep]

    def near(self, w: Windows, order: np.ndarray, slack: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(window, start, span) of places that hold all terms of a window within length + slack words."""
        for k in range(len(w.lengths)):
            terms, need = np.unique(w.terms[k, :w.lengths[k]], return_counts=True)
            reach = int(w.lengths[k]) + slack
            rare = w.terms[k, order[k, 0]]
            anchors = self.positions[self.first[rare]:self.first[rare] + self.count[rare]]
            for doc, at in zip(self.doc_of(anchors), anchors):
                lo = max(at - reach + 1, self.doc_ends[doc - 1] if doc else 0)
                hi = min(at + reach, self.doc_ends[doc])
                lists = [self._between(t, lo, hi) for t in terms]
                if any(len(x) < n for x, n in zip(lists, need)):
                    continue
                for start in np.concatenate(lists):
                    held = [x[(x >= start) & (x < start + reach)] for x in lists]
                    if all(len(x) >= n for x, n in zip(held, need)):
                        # The shortest stretch from here that holds the terms as often as the window.
                        last = max(int(x[n - 1]) for x, n in zip(held, need))
                        if start <= at <= last:
                            yield np.array([k]), np.array([start]), np.array([last - start + 1])

    def _between(self, term: int, lo: int, hi: int) -> np.ndarray:
        own = self.positions[self.first[term]:self.first[term] + self.count[term]]
        return own[np.searchsorted(own, lo):np.searchsorted(own, hi)]


def _split(chosen: np.ndarray, n: np.ndarray, piece: int) -> Iterator[np.ndarray]:
    if len(chosen):
        part = (np.cumsum(n[chosen]) - 1) // piece
        yield from np.split(chosen, np.flatnonzero(np.diff(part)) + 1)


def query_index(index: DataFrame, windows: Windows, slack: int = 0) -> DataFrame:
    """Per indexed document: words, words hit, the items hit, and the hits (start, span in words)."""
    frequency = term_frequencies(index, len(windows.vocabulary))
    order = windows.by_rarity(frequency)
    n_terms = len(windows.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                p = Postings(r["lengths"], r["terms"], r["counts"], r["positions"], n_terms)
                if slack:
                    found = list(p.near(windows, order, slack))
                else:
                    found = [(k, s, windows.lengths[k]) for k, s in p.phrases(windows, order)]
                yield _per_document(r["doc_ids"], r["hashes"], p, windows, found)

    return index.mapInArrow(run, MATCH)


def _per_document(doc_ids: list[int | None], hashes: list[int], p: Postings, w: Windows, found: list) -> pa.RecordBatch:
    window, start, span = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64)
                           for i in range(3))
    marks = np.zeros(p.n_words + 1, np.int64)
    np.add.at(marks, start, 1)
    np.add.at(marks, start + span, -1)
    hit = np.concatenate([[0], np.cumsum(np.cumsum(marks[:-1]) > 0)])
    ends, begins = p.doc_ends, np.concatenate([[0], p.doc_ends[:-1]]).astype(np.int64)
    doc = p.doc_of(start)
    rank = np.lexsort((span, start, doc))
    window, start, span, doc = window[rank], start[rank], span[rank], doc[rank]
    first = np.searchsorted(doc, np.arange(len(doc_ids) + 1))
    items, starts, spans = [], [], []
    for i in range(len(doc_ids)):
        own = slice(first[i], first[i + 1])
        items.append(sorted({x for k in set(window[own].tolist()) for x in w.items[k]}))
        places = sorted(set(zip((start[own] - begins[i]).tolist(), span[own].tolist())))
        starts.append([a for a, _ in places])
        spans.append([b for _, b in places])
    return pa.RecordBatch.from_arrays([
        pa.array(doc_ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(ends - begins, pa.int64()),
        pa.array(hit[ends] - hit[begins], pa.int64()), pa.array(items, pa.list_(pa.string())),
        pa.array(starts, pa.list_(pa.int32())), pa.array(spans, pa.list_(pa.int32()))],
        names=[f.split()[0] for f in MATCH.split(", ")])


def item_blocks(benchmark: DataFrame, block_words: int) -> list[DataFrame]:
    """The test items dealt into blocks of about ``block_words`` words at most."""
    b = benchmark.select(F.coalesce(benchmark["item_id"].cast("string"), F.lit("null")).alias("item"),
                         F.coalesce(benchmark["text"].cast("string"), F.lit("")).alias("text"))
    size = b.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // (4 * block_words)))
    part = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    return [b.where(part == k) for k in range(n)]


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, slack: int = 0,
                       block_words: int = 2_000_000, segment_words: int = 1 << 20) -> DataFrame:
    """doc_id, n_words, n_hit, items (those with an occurrence), starts, spans for every row of ``docs``."""
    found = []
    for block in item_blocks(benchmark, block_words):
        w = Windows([(r.item, r.text.encode()) for r in block.distinct().collect()], window)
        found.append(query_index(stash(build_index(docs, w.vocabulary, segment_words)), w, slack))
    return found[0] if len(found) == 1 else _merge(found)


def _merge(found: list[DataFrame]) -> DataFrame:
    """One row per document from the results of several blocks of items.

    What is found depends on the text alone, so the blocks are put together
    per text (map-side combined) and joined back to the documents.
    """
    hits = found[0].where(F.size("starts") > 0)
    for f in found[1:]:
        hits = hits.unionByName(f.where(F.size("starts") > 0))
    places = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.arrays_zip("starts", "spans")))))
    texts = hits.groupBy("text_hash").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), places.alias("at"))
    spot = F.explode(F.sequence(F.col("p.starts"), F.col("p.starts") + F.col("p.spans") - 1))
    n_hit = (texts.select("text_hash", F.explode("at").alias("p")).select("text_hash", spot.alias("w"))
             .groupBy("text_hash").agg(F.count_distinct("w").alias("n_hit")))
    none = F.array().cast("array<int>")
    return (found[0].select("doc_id", "text_hash", "n_words")
            .join(texts.join(n_hit, "text_hash"), "text_hash", "left")
            .select("doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                    F.coalesce("at.starts", none).alias("starts"), F.coalesce("at.spans", none).alias("spans")))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of ``docs`` in which no test window occurs, with all of their columns."""
    found = find_contamination(docs, benchmark, window)
    name = fresh("text_hash", docs)
    bad = found.where(F.col("n_hit") > 0).select(F.col("text_hash").alias(name)).distinct()
    named = docs.withColumn(name, F.xxhash64(docs["text"].cast("string")))
    return named.join(bad, name, "left_anti").select(*[f"`{c}`" for c in docs.columns])


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of ``find_contamination``."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def brute_force(docs: list[tuple], items: list[tuple], window: int = 10) -> list[tuple]:
    """The contract's rows by comparing every position (for tests)."""
    wanted: dict[tuple, set[str]] = {}
    for item, text in items:
        ws = WORD.findall((text or "").encode().lower())
        for i in range(max(1, len(ws) - window + 1) if ws else 0):
            wanted.setdefault(tuple(ws[i:i + window]), set()).add("null" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        ws = WORD.findall((text or "").encode().lower())
        hit, names = set(), set()
        for n in {len(w) for w in wanted}:
            for i in range(len(ws) - n + 1):
                if (own := wanted.get(tuple(ws[i:i + n]))):
                    hit.update(range(i, i + n))
                    names |= own
        out.append((doc_id, len(ws), len(hit), len(names),
                    hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out
