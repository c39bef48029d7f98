"""Ranked lexical search: Block-Max MaxScore over a document-sharded inverted index.

The index holds every term of the corpus.  A segment has about half a million words
of consecutive documents and is one row of a stored Parquet table: its terms
in order, and for each a posting list (document, term frequency) in compressed
blocks of ``BLOCK`` postings.  A block's head tells its last document, its
greatest term frequency and its shortest document, hence a bound of what any
posting in it can add to a score.

A query walks a segment with a heap of its best documents, which goes on from
one segment of a task to the next.  Lists are ordered by the bound of the whole
list; those whose bounds together cannot reach the worst score of a full heap
are non-essential.  Only documents of the essential lists are candidates, taken
in order in windows.  For the non-essential lists, greatest bound first, a
candidate is given up as soon as its score so far and the maxima of the blocks
that could hold it stay below the heap; only blocks with a candidate left are
decompressed.  The heaps of all tasks are merged per item.

Scores are those of BM25 in integers (see ``impact``); document lengths and
frequencies count all documents.

Scale.  Building and searching are map-only; what is shuffled are the
frequencies of the queries' terms (one row a term and task) and the heaps (k
rows an item and task, cut map-side again).  Queries are shipped in blocks of at most
``block_words`` words.  No term's list is gathered: a word in every document is
spread over all segments like the documents.

Defined cases: null text has no words, and a document without words is found by
no query; an item without words has no rows; a null doc_id ranks behind all
others of its score; repeated rows of documents rank each for itself, repeated rows of
items are each answered; a term of weight 0 adds nothing; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import batches_bytes, key_text, slices, stash
from .decontam import words

BLOCK = 128
WINDOW = 2048          # candidates looked at between two looks at the heap
SEGMENT_WORDS = 1 << 19
# Row groups of a few segments and pages of one; both are looked at after every row.
STORED = {"parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}

SEGMENT = ("doc_ids array<long>, lengths array<long>, terms binary, ends binary, lists binary, heads binary, data binary")
HEAP = "item int, doc_id long, score long"


def impact(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """What one occurrence of a query term adds, before its weight: 10^9 tf div (1000 tf + 8 m)."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * norm)


def norms(lengths: np.ndarray, n_docs: int, n_words: int) -> np.ndarray:
    """m of documents of these lengths: 25 + (75 n N) div L."""
    if len(lengths) and 75 * int(lengths.max()) * n_docs < 1 << 62:
        return 25 + (75 * lengths * n_docs) // max(1, n_words)
    return np.array([25 + 75 * n * n_docs // max(1, n_words) for n in lengths.tolist()], np.int64)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


HEAD = np.dtype([("first", "<i4"), ("last", "<i4"), ("count", "<i4"), ("most", "<i4"), ("shortest", "<i8"),
                 ("at", "<i4"), ("gap", "u1"), ("tf", "u1")])


def _width(top: np.ndarray) -> np.ndarray:
    """Bytes of a number: 1, 2 or 4."""
    return np.where(top < 1 << 8, 1, np.where(top < 1 << 16, 2, 4))


def _put(data: np.ndarray, values: np.ndarray, at: np.ndarray, width: np.ndarray) -> None:
    """Writes numbers of the given widths, little-endian, at the given places."""
    for k in range(4):
        own = width > k
        data[at[own] + k] = values[own] >> 8 * k & 255


def segment(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, vocabulary: list[bytes]) -> pa.RecordBatch:
    """One segment from its documents' words (as places in ``vocabulary``, one after the other).

    ``lists`` has where each term's blocks end in ``heads``; a head is (first and last document, count,
    greatest frequency, shortest length, place in ``data``, widths of gaps and frequencies).
    """
    n_docs, length = len(doc_ids), np.array(lengths, np.int64)
    order = sorted(range(len(vocabulary)), key=vocabulary.__getitem__)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    key, tf = np.unique(rank[ids] * max(1, n_docs) + np.repeat(np.arange(n_docs), length), return_counts=True)
    term, doc = np.divmod(key, max(1, n_docs))
    start = np.searchsorted(term, np.arange(len(order) + 1))
    place = (np.arange(len(key)) - start[term]) % BLOCK
    first = np.flatnonzero(place == 0)                     # the postings that begin a block
    block = np.cumsum(place == 0) - 1
    heads = np.zeros(len(first), HEAD)
    data = np.zeros(0, np.uint8)
    if len(first):
        gaps = np.where(place > 0, np.diff(doc, prepend=0), 0)
        heads["first"], heads["last"] = doc[first], doc[np.append(first[1:], len(doc)) - 1]
        heads["count"] = np.diff(first, append=len(doc))
        heads["most"] = np.maximum.reduceat(tf, first)
        heads["shortest"] = np.minimum.reduceat(length[doc], first)
        heads["gap"] = _width(np.maximum.reduceat(gaps, first))
        heads["tf"] = _width(heads["most"] - 1)
        size = heads["count"].astype(np.int64) * (heads["gap"] + heads["tf"])
        heads["at"] = np.cumsum(size) - size
        data = np.zeros(int(size.sum()), np.uint8)
        at, gap, width = (heads[c].astype(np.int64)[block] for c in ("at", "gap", "tf"))
        _put(data, gaps, at + place * gap, gap)
        _put(data, tf - 1, at + heads["count"][block] * gap + place * width, width)
    ordered = [vocabulary[i] for i in order]
    return pa.RecordBatch.from_arrays([
        pa.array([doc_ids], pa.list_(pa.int64())), pa.array([length], pa.list_(pa.int64())),
        pa.array([b"".join(ordered)], pa.binary()),
        pa.array([np.cumsum(list(map(len, ordered)), dtype=np.int64).astype("<i4").tobytes()], pa.binary()),
        pa.array([np.searchsorted(first, start[1:]).astype("<i4").tobytes()], pa.binary()),
        pa.array([heads.tobytes()], pa.binary()), pa.array([data.tobytes()], pa.binary())],
        names=[f.split()[0] for f in SEGMENT.split(", ")])


def build_index(docs: DataFrame, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """Segments of the index of all rows of ``docs`` (doc_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc_ids, lengths, held = [], [], []
        number = defaultdict(count().__next__)
        for batch in slices(batches, "text"):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batches_bytes(batch, "text")):
                found = words(text)
                if doc_ids and sum(lengths) + len(found) > segment_words:
                    yield segment(doc_ids, lengths, np.concatenate(held), list(number))
                    doc_ids, lengths, held = [], [], []
                    number = defaultdict(count().__next__)
                doc_ids.append(doc_id)
                lengths.append(len(found))
                held.append(np.fromiter(map(number.__getitem__, found), np.int32, len(found)))
        if doc_ids:
            yield segment(doc_ids, lengths, np.concatenate(held), list(number))

    return key_text(docs).mapInArrow(run, SEGMENT)


def stored(index: DataFrame) -> DataFrame:
    """``index``, written so that a reader holds few of its segments at once.

    Rows have megabytes here.  By default the writer looks at the size of pages and row groups after
    each 100 rows, so a task's whole part is one page a column, which is read, unpacked and held whole.
    """
    return stash(index, **STORED)


def _each_segment(index: DataFrame, run: Callable[[Iterator[Row]], Iterator[tuple]], schema: str) -> DataFrame:
    """The rows that ``run`` makes of each task's segments.

    Arrow batches go by the number of rows, 10,000 of them, so all of a task's segments would be one
    batch; an RDD's rows go to Python a few megabytes at a time.
    """
    return index.sparkSession.createDataFrame(index.rdd.mapPartitions(run), schema, verifySchema=False)


class Shard:
    """One segment, opened for queries."""

    def __init__(self, row: Row | dict):
        self.lengths = np.array(row["lengths"], np.int64)
        self.doc_ids = row["doc_ids"]
        self.body, self.ends = row["terms"], np.frombuffer(row["ends"], "<i4")
        self.lists = np.frombuffer(row["lists"], "<i4")
        self.heads = np.frombuffer(row["heads"], HEAD)
        self.data = row["data"]
        self.opened = 0   # blocks decompressed

    def find(self, term: bytes) -> int | None:
        """The term's number (binary search over the ordered terms)."""
        low, high = 0, len(self.ends)
        while low < high:
            mid = (low + high) // 2
            if self._term(mid) < term:
                low = mid + 1
            else:
                high = mid
        return low if low < len(self.ends) and self._term(low) == term else None

    def _term(self, k: int) -> bytes:
        return self.body[self.ends[k - 1] if k else 0:self.ends[k]]

    def blocks(self, number: int) -> np.ndarray:
        return self.heads[self.lists[number - 1] if number else 0:self.lists[number]]

    def open(self, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, frequencies) of a block."""
        self.opened += 1
        first, _, n, _, _, at, gap, tf = head.item()
        gaps = np.frombuffer(self.data, f"<u{gap}", n, at)
        counts = np.frombuffer(self.data, f"<u{tf}", n, at + gaps.nbytes)
        return first + np.cumsum(gaps, dtype=np.int64), counts.astype(np.int64) + 1

    def document_frequency(self, number: int) -> int:
        return int(self.blocks(number)["count"].sum())


class Heap:
    """The best k (score, doc_id): higher scores first, then smaller ids, null ids last."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.id, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def floor(self) -> int:
        """Scores below this one cannot enter."""
        return max(1, int(self.score[-1])) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, doc_ids: list[int | None]) -> None:
        null = np.array([d is None for d in doc_ids], bool)
        score = np.concatenate([self.score, score])
        ids = np.concatenate([self.id, np.array([0 if d is None else d for d in doc_ids], np.int64)])
        null = np.concatenate([self.null, null])
        best = np.lexsort((ids, null, -score))[:self.k]
        self.score, self.id, self.null = score[best], ids[best], null[best]

    def rows(self) -> list[tuple[int | None, int]]:
        return [(None if n else i, s) for s, i, n in zip(self.score.tolist(), self.id.tolist(), self.null.tolist())]


class Lists:
    """The posting lists of one query in one shard, by falling bound of the whole list."""

    def __init__(self, shard: Shard, query: list[tuple[bytes, int]], found: dict[bytes, int | None], m: np.ndarray,
                 m_of_length):
        self.shard, self.m = shard, m
        held = []
        for term, times in query:
            if times and found[term] is not None:
                b = shard.blocks(found[term])
                bound = times * impact(b["most"].astype(np.int64), m_of_length(b["shortest"]))
                held.append((int(bound.max()), term, times, b, bound))
        held.sort(key=lambda x: (-x[0], x[1]))
        self.times = [x[2] for x in held]
        self.heads = [x[3] for x in held]
        self.first = [x[3]["first"].astype(np.int64) for x in held]
        self.last = [x[3]["last"].astype(np.int64) for x in held]
        self.block_bound = [x[4] for x in held]
        self.bound = np.array([x[0] for x in held], np.int64)
        self.rest = np.concatenate([np.cumsum(self.bound[::-1])[::-1], [0]])   # bound of this list and all behind it
        self.cache: list[dict[int, tuple[np.ndarray, np.ndarray]]] = [{} for _ in held]

    def block(self, k: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, what they gain) of block j of list k."""
        if j not in self.cache[k]:
            doc, tf = self.shard.open(self.heads[k][j])
            self.cache[k][j] = doc, self.times[k] * impact(tf, self.m[doc])
        return self.cache[k][j]

    def between(self, k: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """The postings of list k in documents low .. high - 1."""
        doc, gain = [], []
        for j in range(int(np.searchsorted(self.last[k], low)), int(np.searchsorted(self.first[k], high))):
            d, g = self.block(k, j)
            inside = slice(np.searchsorted(d, low), np.searchsorted(d, high))
            doc.append(d[inside])
            gain.append(g[inside])
        return (np.concatenate(doc), np.concatenate(gain)) if doc else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def search_shard(shard: Shard, lists: Lists, heap: Heap) -> None:
    """Adds the shard's best documents for one query to the heap."""
    n = len(shard.lengths)
    low = 0
    while low < n:
        floor = heap.floor()
        essential = int(np.searchsorted(-lists.rest, -floor, side="right"))   # the lists behind cannot reach it
        if not essential:
            return
        high = min(n, low + WINDOW)
        score = np.zeros(high - low, np.int64)
        seen = np.zeros(high - low, bool)
        for k in range(essential):
            doc, gain = lists.between(k, low, high)
            score[doc - low] += gain
            seen[doc - low] = True
        at = np.flatnonzero(seen)
        got = score[at]
        for k in range(essential, len(lists.times)):
            # What the remaining lists can add at most: here the block's maximum, behind it the lists' bounds.
            j = np.searchsorted(lists.last[k], at + low)
            there = j < len(lists.last[k])
            most = np.where(there, lists.block_bound[k][np.minimum(j, len(lists.last[k]) - 1)], 0)
            hopeful = got + most + lists.rest[k + 1] >= floor
            at, got, j, there = at[hopeful], got[hopeful], j[hopeful], there[hopeful]
            if not len(at):
                break
            for block in np.unique(j[there]).tolist():
                doc, gain = lists.block(k, block)
                mine = np.flatnonzero(j == block)
                place = np.minimum(np.searchsorted(doc, at[mine] + low), len(doc) - 1)
                got[mine] += np.where(doc[place] == at[mine] + low, gain[place], 0)
        good = got >= floor
        if good.any():
            heap.add(got[good], [shard.doc_ids[d] for d in (at[good] + low).tolist()])
        low = high


def corpus_statistics(index: DataFrame, terms: list[bytes]) -> tuple[int, int, dict[bytes, int]]:
    """N, L and the document frequency of the given terms over the whole index."""
    def run(rows: Iterator[Row]) -> Iterator[tuple]:
        df: Counter = Counter()
        for row in rows:
            shard = Shard(row)
            # -1 and -2 stand for N and L.
            df.update({-1: int((shard.lengths > 0).sum()), -2: int(shard.lengths.sum())})
            for i, term in enumerate(terms):
                if (k := shard.find(term)) is not None:
                    df[i] += shard.document_frequency(k)
        return iter(df.items())

    counted = dict(_each_segment(index, run, "term long, n long").groupBy("term").agg(F.sum("n")).collect())
    return counted.get(-1, 0), counted.get(-2, 0), {t: counted.get(i, 0) for i, t in enumerate(terms)}


def search(index: DataFrame, queries: list[list[bytes]], k: int = 10) -> DataFrame:
    """(item, doc_id, score) of the best documents of each task and query; ``item`` numbers ``queries``."""
    terms = sorted({t for q in queries for t in q})
    n_docs, n_words, df = corpus_statistics(index, terms)
    weights = {t: max(0, weight(n_docs, df[t])) if df[t] else 0 for t in terms}
    wanted = [[(t, n * weights[t]) for t, n in sorted(Counter(q).items())] for q in queries]

    def run(rows: Iterator[Row]) -> Iterator[tuple]:
        heaps = [Heap(k) for _ in wanted]
        for row in rows:
            shard = Shard(row)
            m = norms(shard.lengths, n_docs, n_words)
            found = {t: shard.find(t) for t in terms}
            for query, heap in zip(wanted, heaps):
                search_shard(shard, Lists(shard, query, found, m, lambda x: norms(x, n_docs, n_words)), heap)
        return ((i, d, s) for i, heap in enumerate(heaps) for d, s in heap.rows())

    return _each_segment(index, run, HEAP)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, segment_words: int = SEGMENT_WORDS,
                   block_words: int = 200_000) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents for every row of ``items`` (item_id, text)."""
    index = stored(build_index(docs, segment_words))
    kind = dict(items.dtypes)["item_id"]
    found = None
    for block in _blocks(items, block_words):
        rows = block.select("item_id", F.col("text").cast("string").alias("text")).collect()
        names = docs.sparkSession.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], f"item int, item_id {kind}")
        best = search(index, [words((r.text or "").encode()) for r in rows], k)
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        best = (best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
                .join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
        found = best if found is None else found.unionByName(best)
    return found


def _blocks(items: DataFrame, block_words: int) -> list[DataFrame]:
    """The items dealt into blocks of about ``block_words`` words at most."""
    size = items.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    n = max(1, -(-size // (4 * block_words)))
    part = F.pmod(F.xxhash64(F.col("item_id").cast("string"), F.col("text").cast("string")), F.lit(n))
    return [items.where(part == b) for b in range(n)]


def brute_force(docs: list[tuple], items: list[tuple], k: int = 10) -> list[tuple]:
    """(item_id, rank, doc_id, score) by scoring every document (for tests)."""
    counted = [(d, Counter(words((t or "").encode()))) for d, t in docs]
    n_docs = sum(1 for _, c in counted if c)
    n_words = sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc_id, c in counted:
            m = 25 + 75 * sum(c.values()) * n_docs // max(1, n_words)
            s = sum(weight(n_docs, df[t]) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
                    for t in words((text or "").encode()) if c[t])
            if s > 0:
                scored.append((-s, doc_id is None, doc_id or 0, doc_id))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return out
