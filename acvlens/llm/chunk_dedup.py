"""Substring dedup by content-defined chunking with a gear rolling hash.

A 16-bit gear hash rolls over the bytes of a text (each step shifts it by one
and adds a number for the byte, so it depends on the last 16 bytes).  Cuts are
allowed where words begin, and anywhere in a stretch of 16 bytes in which none
begins.  Of each ``WINDOW`` adjacent allowed places the one of smallest hash (the
last of equal ones) is a cut.  So a place is chosen by the text around it alone, never by
the cut before it: two texts that share a passage have the same cuts from the
choice of its first whole window to that of its last, however they differ outside.

Chunks are compared as blocks: a chunk and those that follow it until
``least_words`` words have begun.  One aggregate gives the 64-bit digest of each block its
documents (first and last row, smallest doc_id, the keeper).  Blocks in more than one
document are joined back, and the text that they cover is reported, in one span
for each stretch with the same keeper.  Every block in common is a
shared passage of ``least_words`` words or more, so chance repeats of short chunks and shared short
lines do not count.  Every shared passage of
least_words + 2 WINDOW + 7 words is found: 8 words at most begin in the 16 bytes
the first hash needs, and less than WINDOW words are lost at either end, so
``least_words`` are left (51 words for the values below).

The keeper of a block holds the whole block, and is not removable in any part of it; so what
is removed elsewhere stays, with least_words words around it, in its keeper.

Scale.  Chunking is map-only and stored packed (one row per document).  The
aggregate by digest is map-side combined, so a passage that a third of the
documents share costs one row per task; the join back is an inner join that AQE
can split; spans are formed per document, whose chunks its own length bounds.
No pairs of documents are formed: each passage is linked to its keeper.

Defined cases: null or empty text has no chunks; a repeat inside one document
alone does not count (``repeats_within`` reports those); identical rows (same doc_id and text) count as one
document; a null doc_id is kept (a passage whose documents all lack an id has
a null keeper); an empty table gives an empty result.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_bytes, fresh, key_text, slices, stash

WINDOW = 14
LEAST_WORDS = 16

_GEAR = np.array([xxhash.xxh64_intdigest(bytes([b]), 8) & 0xFFFF for b in range(256)], np.uint16)
_IS_SPACE = np.array([bytes([b]).isspace() for b in range(256)])


def gear_hash(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte (by doubling: sums over 1, 2, 4, 8, 16 bytes)."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8):
        longer = h.copy()
        longer[k:] += h[:-k] << np.uint16(k)
        h = longer
    return h


def cut_points(text: bytes) -> tuple[list[int], np.ndarray]:
    """Ends of the text's chunks (byte positions), and the text as an array."""
    data = np.frombuffer(text, np.uint8)
    size = len(data)
    space = _IS_SPACE[data]
    begins = np.zeros(size, bool)   # a word begins at this byte
    begins[1:] = space[:-1] & ~space[1:]
    known = np.concatenate([[0], np.cumsum(begins)])
    bare = np.zeros(size, bool)     # none begins at this byte and the 15 before it
    if size > 16:
        bare[16:] = known[17:] == known[1:size - 15]
    at = np.flatnonzero(begins | (bare & ((data & 0xC0) != 0x80)))
    if len(at) < WINDOW:
        return [size], data
    h = gear_hash(data)[at - 1]
    windows = np.lib.stride_tricks.sliding_window_view(h[::-1], WINDOW)
    last = len(at) - 1 - np.arange(len(windows)) - windows.argmin(axis=1)   # of equal ones the last
    return [*at[np.unique(last)].tolist(), size], data


def chunks(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Digest of each chunk, and its place: start << 16 | length << 8 | words (characters, words begun)."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cuts, data = cut_points(text)
    h = xxhash.xxh3_64_intdigest
    digests = np.fromiter((h(text[a:b]) for a, b in zip([0, *cuts], cuts)), np.uint64, len(cuts)).view(np.int64)
    edges = np.array([0, *cuts])
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[edges]
    space = _IS_SPACE[data]
    begun = np.concatenate([[0], np.cumsum(~space & np.concatenate([[True], space[:-1]]))])[edges]
    return digests, chars[:-1] << 16 | np.diff(chars) << 8 | np.diff(begun)


def blocks(digests: np.ndarray, places: np.ndarray, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digest and end (in chunks) of the blocks at the first chunks, and the chunks' edges: start << 32 | words before."""
    words = np.concatenate([[0], np.cumsum(places & 255)])
    chars = np.concatenate([[0], np.cumsum(places >> 8 & 255)])
    ends = np.searchsorted(words, words[:-1] + least_words)
    ends = ends[ends < len(words)]
    h, body = xxhash.xxh3_64_intdigest, digests.tobytes()
    of = np.fromiter((h(body[8 * k:8 * e]) for k, e in enumerate(ends.tolist())), np.uint64, len(ends)).view(np.int64)
    return of, ends, chars << 32 | words


def block_table(docs: DataFrame, least_words: int) -> DataFrame:
    """(doc_id, row, digests, ends, edges): the packed blocks of every row of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = [blocks(*chunks(t), least_words) for t in batches_bytes(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"),
                 *(pa.array([r[k] for r in rows], pa.list_(kind)) for k, kind in enumerate((pa.int64(), pa.int32(), pa.int64())))],
                names=["doc_id", "row", "digests", "ends", "edges"])

    named = key_text(docs).withColumn("row", F.xxhash64("doc_id", "text"))
    return named.mapInArrow(run, "doc_id long, row long, digests array<long>, ends array<int>, edges array<long>")


def spans_of(doc_id: int | None, found: list[tuple]) -> list[tuple]:
    """Spans (start, end, words, chunks, keeper) of one document from its repeated blocks.

    A block is (first chunk, end, edge there, edge at the end, keeper).  A piece
    between ends of blocks belongs to the document itself if it keeps a block
    over it, and else to the smallest keeper.
    """
    found = sorted(found, key=itemgetter(0))
    edge = {x[0]: x[2] for x in found} | {x[1]: x[3] for x in found}
    cuts, spans = sorted(edge), []
    least, own, n = deque(), -1, 0   # (keeper, end) from the smallest keeper on; end of the last block kept here
    for p, q in zip(cuts, cuts[1:]):
        while n < len(found) and found[n][0] <= p:
            end, keep = found[n][1], found[n][4]
            if keep == doc_id:
                own = end
            else:
                while least and least[-1][0] >= keep:
                    least.pop()
                least.append((keep, end))
            n += 1
        while least and least[0][1] <= p:
            least.popleft()
        if own <= p and not least:
            continue
        keep = doc_id if own > p else least[0][0]
        if spans and spans[-1][1:] == (p, keep):
            spans[-1] = (spans[-1][0], q, keep)
        else:
            spans.append((p, q, keep))
    return [(edge[p] >> 32, edge[q] >> 32, (edge[q] & 0xFFFFFFFF) - (edge[p] & 0xFFFFFFFF), q - p, keep)
            for p, q, keep in spans]


def repeated_spans(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """Repeated passages: doc_id, start, end (characters), n_words, n_chunks, keep_doc_id, removable.

    One row per span: text in blocks that other documents hold too, with the
    same keep_doc_id (the smallest doc_id among a block's holders).  The word
    threshold holds for the blocks, so a span between others may be shorter.
    ``removable`` is false in the keeper.
    """
    return _spans(docs, least_words).select("doc_id", "start", "end", "n_words", "n_chunks", "keep_doc_id", "removable")


def _spans(docs: DataFrame, least_words: int) -> DataFrame:
    table = stash(block_table(docs, least_words), compression="zstd")
    held = (table.select("doc_id", "row", F.explode("digests").alias("digest")).groupBy("digest")
            .agg(F.min("row").alias("low"), F.max("row").alias("high"), F.min("doc_id").alias("keep")))
    shared = stash(held.where("low != high").select("digest", "keep"))
    block = "transform(digests, (d, k) -> struct(d AS digest, k, ends[k] AS e, edges[k] AS a, edges[ends[k]] AS b))"
    found = (table.select("doc_id", "row", F.inline(F.expr(block))).join(shared, "digest")
             .groupBy("row").agg(F.min("doc_id").alias("doc_id"),
                                 F.collect_set(F.struct("k", "e", "a", "b", "keep")).alias("found")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, rows = batch.column("found"), []
            at, parts = found.offsets.to_pylist(), found.values.flatten()
            for i, (row, doc_id) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id")))):
                own = [x.slice(at[i], at[i + 1] - at[i]).to_pylist() for x in parts]
                rows += [(row, doc_id, *span, span[-1] != doc_id) for span in spans_of(doc_id, list(zip(*own)))]
            kinds = [pa.int64()] * 7 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)],
                names=["row", "doc_id", "start", "end", "n_words", "n_chunks", "keep_doc_id", "removable"])

    return found.mapInArrow(run, "row long, doc_id long, start long, end long, n_words long, n_chunks long, "
                                 "keep_doc_id long, removable boolean")


def _without(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    if not spans or text is None:
        return text
    return "".join(text[a:b] for a, b in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(text)]))


def inner_spans(text: bytes, least_words: int = LEAST_WORDS) -> list[tuple]:
    """Spans (start, end, words, chunks, 0 first / 1 again) of the blocks that occur more than once in a text."""
    digests, ends, edges = blocks(*chunks(text), least_words)
    _, first, which, times = np.unique(digests, return_index=True, return_inverse=True, return_counts=True)
    at = np.flatnonzero(times[which] > 1)
    again = (first[which[at]] != at).astype(int)
    return spans_of(0, list(zip(*(x.tolist() for x in (at, ends[at], edges[at], edges[ends[at]], again)))))


def repeats_within(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """Passages that a document holds more than once: doc_id, start, end, n_words, n_chunks, removable.

    Map-only and apart from ``repeated_spans``.  The first occurrence of each
    block is whole and not ``removable``; what lies only in later ones is.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = [(doc_id, *span) for doc_id, t in zip(batch.column("doc_id").to_pylist(), batches_bytes(batch, "text"))
                    for span in inner_spans(t, least_words)]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([r[k] for r in rows], pa.int64()) for k in range(5)), pa.array([r[5] == 1 for r in rows], pa.bool_())],
                names=["doc_id", "start", "end", "n_words", "n_chunks", "removable"])

    return key_text(docs).mapInArrow(run, "doc_id long, start long, end long, n_words long, n_chunks long, removable boolean")


def remove_within(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with the first of the passages that a document repeats alone (all columns, texts shortened)."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = [_without(t, [s[:2] for s in inner_spans((t or "").encode(), least_words) if s[4]])
                     for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names], names=names)

    return docs.mapInArrow(run, docs.schema)


def remove_repeats(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with each repeated passage left in its keeper alone (all columns, texts shortened)."""
    row, cut = fresh("row", docs), fresh("cuts", docs)
    cuts = (_spans(docs, least_words).where("removable").groupBy(F.col("row").alias(row))
            .agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(cut)))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column(cut).to_pylist()):
                texts.append(_without(text, [(s["start"], s["end"]) for s in spans or []]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names], names=names)

    named = docs.withColumn(row, F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string")))
    return named.join(cuts, row, "left").mapInArrow(run, docs.schema)
