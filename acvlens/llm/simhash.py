"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint has three segments of 22, 21 and 21 bits.  Each is read as
a word of the perfect binary Golay code (23, 12, 7) and decoded to the indices
of the codewords near it.  A word lies within 3 bits of exactly one codeword.
If that distance is 3 it also has five codewords at distance 4; otherwise the
next ones are farther.  So two words that differ in at most one bit share a
key: the stored side keeps the index of its codeword, the searching side asks
for all codewords within 4 bits (one or six).

Pigeonhole over the segments, for at most 3 differing bits:
* some segment is intact, and then one of the other two has at most one error:
  key (intact segment i, Golay index of segment j), six pairs (i, j), or
* each segment has exactly one error: key (Golay index of the first segment,
  the intact half of the second, the intact half of the third), four choices.
A key has 31 to 34 bits, so buckets stay small when fingerprints are many.
The join on keys loses no pair; the bit distance is verified on every candidate.

Links between fingerprints are not all emitted.  Inside a bucket every member
is first linked to one pivot; components are built from those links, and then
only members whose components still differ are compared.  So a dense group of
copies gives links in the order of its size, and every remaining link
between two components is found (their classes are then joined).  Work is on
distinct fingerprints: exact copies are one row after a map-side aggregate.

Defined cases: null or empty text has fingerprint zero and links like any
other; a text of fewer words than a shingle is one shingle; repeated rows and
null doc_ids are kept; component_id is the smallest non-null doc_id of the
component (null if all are null); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_bytes, fresh, key_text, slices, sorted_join, stash
from .components import connected_components

SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))
KEYED = 8192    # fingerprints that a task gives their keys: the map of the keys in its aggregate stays near 60 MB
# Fixed value: generator polynomial of the (23, 12, 7) Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64-bit SimHash of the XXH64 hashes of the word shingles."""
    found = text.lower().split()
    if not found:
        return 0
    if len(found) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(found), SEED)
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(found) - shingle + 1
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[shingle - 1:].tolist())),
                         np.uint64, n)
    ones = np.zeros(64, np.int64)
    for piece in np.array_split(hashes, -(-n // 65536)):
        bits = np.unpackbits(piece.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, row_hash, fp) of every row; whole texts, one pass, no shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fps = np.array([fingerprint(t, shingle) for t in batches_bytes(batch, "text")], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_hash"), pa.array(fps.view(np.int64))],
                names=["doc_id", "row_hash", "fp"])

    named = key_text(docs).withColumn("row_hash", F.xxhash64("doc_id", "text"))
    return named.mapInArrow(run, "doc_id long, row_hash long, fp long")


class Golay:
    """Decoding table of the (23, 12, 7) code, built from its generator polynomial."""

    def __init__(self) -> None:
        self.unit = np.array([self._remainder(1 << i) for i in range(23)], np.int64)
        self.near = np.full(2048, -1, np.int64)        # the error pattern of weight <= 3 of a syndrome
        self.far = np.zeros((2048, 5), np.int64)       # the five of weight 4 (of syndromes whose pattern has weight 3)
        self.n_far = np.zeros(2048, np.int64)
        for weight in range(5):
            for places in combinations(range(23), weight):
                pattern = sum(1 << i for i in places)
                s = int(np.bitwise_xor.reduce(self.unit[list(places)])) if places else 0
                if weight < 4:
                    self.near[s] = pattern
                elif self.near[s].item().bit_count() == 3:
                    self.far[s, self.n_far[s]] = pattern
                    self.n_far[s] += 1

    @staticmethod
    def _remainder(word: int) -> int:
        for i in range(22, 10, -1):
            if word >> i & 1:
                word ^= GENERATOR << (i - 11)
        return word

    def syndromes(self, words: np.ndarray) -> np.ndarray:
        s = np.zeros(len(words), np.int64)
        for i in range(23):
            s ^= (words >> i & 1) * self.unit[i]
        return s

    def keys(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each word's codeword, and the (n, 6) indices within 4 bits (-1: none)."""
        s = self.syndromes(words)
        own = (words ^ self.near[s]) >> 11
        around = np.where(self.n_far[s, None] > 0, (words[:, None] ^ self.far[s]) >> 11, -1)
        return own, np.concatenate([own[:, None], around], axis=1)


_golay: list[Golay] = []


def golay() -> Golay:
    if not _golay:
        _golay.append(Golay())
    return _golay[0]


def bucket_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the fingerprint, key, stored?) for all keys of the fingerprints (int64)."""
    g, u = golay(), fps.view(np.uint64)
    part = [(u >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    own, around = zip(*(g.keys(p) for p in part))
    fixed = [(k, i, j) for k, (i, j) in enumerate((i, j) for i in range(3) for j in range(3) if i != j)]
    shapes = [(k, part[i], own[j], around[j]) for k, i, j in fixed]
    half = [((p & 0x3FF), (p >> 10)) for p in part]
    for k, (a, b) in enumerate((a, b) for a in range(2) for b in range(2)):
        exact = half[1][a] << 11 | half[2][b]
        shapes.append((6 + k, exact, own[0], around[0]))
    rows, keys, stored = [], [], []
    index = np.arange(len(fps))
    for k, exact, one, several in shapes:
        for column in range(6):
            code = several[:, column]
            has = code >= 0
            rows.append(index[has])
            keys.append((exact[has] << 12 | code[has]) << 4 | k)
            stored.append(np.full(int(has.sum()), column == 0))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(stored)


def _bucketed(fps: DataFrame) -> DataFrame:
    """(key, fp, stored) rows of the distinct fingerprints, about 53 of each, in tasks of about ``KEYED`` of them.

    The fingerprints take few bytes, so Spark would read them in one or two tasks and aggregate all their keys there.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                fp = batch.column("fp").slice(at, 4096).to_numpy(zero_copy_only=False).astype(np.int64)
                rows, keys, stored = bucket_keys(fp)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(fp[rows]), pa.array(stored)], names=["key", "fp", "stored"])

    tasks = max(1, -(-fps.count() // KEYED))
    return fps.select("fp").repartition(tasks, "fp").mapInArrow(run, "key long, fp long, stored boolean")


def link_fingerprints(fps: DataFrame, max_bits: int = 3) -> DataFrame:
    """(fp, component) of distinct fingerprints; component is a fingerprint of its own."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the keys cover bit distances from 0 to 3")
    entries = _bucketed(fps)
    # Only keys that hold a stored and another fingerprint can give a link.
    ends = entries.groupBy("key").agg(
        F.min(F.when(F.col("stored"), F.col("fp"))).alias("pivot"),
        F.min("fp").alias("low"), F.max("fp").alias("high"))
    live = ends.where(F.col("pivot").isNotNull() & (F.col("low") != F.col("high"))).select("key", "pivot")
    buckets = stash(entries.join(sorted_join(live), "key"))
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("pivot"))) <= max_bits
    stars = (buckets.where(close & (F.col("fp") != F.col("pivot")))
             .select(F.col("fp").alias("a"), F.col("pivot").alias("b")))
    label = stash(connected_components(stars, "a", "b"))
    # Buckets whose members are not all in one class yet: compare across classes only.
    named = (buckets.join(sorted_join(label.withColumnRenamed("node", "fp")), "fp", "left")
             .select("key", "fp", "stored", F.coalesce("component", "fp").alias("class")))
    named = stash(named)
    mixed = (named.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi"))
             .where("lo != hi").select("key"))
    open_rows = named.join(sorted_join(mixed), "key")
    left = open_rows.where("stored").select("key", F.col("fp").alias("a"), F.col("class").alias("ca"))
    right = open_rows.select("key", F.col("fp").alias("b"), F.col("class").alias("cb"))
    across = (left.join(sorted_join(right), (left["key"] == right["key"]) & (F.col("ca") != F.col("cb"))
                        & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits))
              .select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")))
    merged = stash(connected_components(across, "a", "b"))
    first = (fps.select("fp").join(sorted_join(label.withColumnRenamed("node", "fp")), "fp", "left")
             .select("fp", F.coalesce("component", "fp").alias("class")))
    return (first.join(sorted_join(merged.select(F.col("node").alias("class"), F.col("component").alias("joined"))),
                       "class", "left")
            .select("fp", F.coalesce("joined", "class").alias("component")))


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """(doc_id, row_hash, fp, component_id, component) for every row of ``docs``.

    row_hash is xxhash64(doc_id, text); component is a fingerprint that names
    the class, component_id its smallest doc_id.
    """
    rows = stash(fingerprints(docs, shingle))
    distinct = stash(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    linked = stash(link_fingerprints(distinct, max_bits).join(sorted_join(distinct), "fp"))
    names = linked.groupBy("component").agg(F.min("first_id").alias("component_id"))
    lookup = linked.join(sorted_join(names), "component").select("fp", "component", "component_id")
    return rows.join(sorted_join(lookup), "fp").select("doc_id", "row_hash", "fp", "component_id", "component")


def deduplicate(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """One row of each group of near-duplicates, with all columns of ``docs``.

    The row of the smallest doc_id stays (rows without one come last; between
    texts of one id the smallest row hash decides); rows that repeat it go.
    """
    marked = near_duplicates(docs, shingle, max_bits)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_hash"))
    row = fresh("row", docs)
    keep = marked.groupBy("component").agg(best.alias("best")).select(F.col("best.row_hash").alias(row))
    named = docs.withColumn(row, F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string")))
    return named.join(sorted_join(keep), row, "left_semi").dropDuplicates([row, "doc_id"]).select(*[f"`{c}`" for c in docs.columns])


def digest(marked: DataFrame) -> DataFrame:
    """The contract's columns of ``near_duplicates``."""
    return marked.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
