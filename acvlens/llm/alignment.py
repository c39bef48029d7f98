"""Cross-tokenizer alignment by inverted bitmaps of token pairs.

Two tokenizers cut the same bytes (a space and the text); where tokens of both end
at one place the text falls into groups, and every token of the one is linked with
every token of the other inside a group.  The index maps a linked pair (a, b) to the documents that
hold it: documents are numbered in ranges of ``RANGE``, and a pair has in each
range a compressed bitmap (the set bits as 16-bit numbers, or plain bits where
those are shorter) and bit planes of how often each document holds it
(plane k: bit k of the multiplicity less one, by the document's rank in the bitmap).
Tasks write partial bitmaps whenever ``FLUSH_LINKS`` links are held; those of one
(pair, range) are OR-merged, their multiplicities added.  A pair's document
count is the sum of its bitmaps' popcounts, its link count that and the planes' popcounts
times their weights.  The postings then return scores: each bitmap gives its pair's
count to the documents whose bits it has, times the multiplicity.

Scale.  What is shuffled are bitmaps, once by (pair, range), once to meet the
pair's count and once by range; a pair that every document holds is one row a
range, so no key gathers more than a bitmap of ``RANGE`` bits at a time, and
a range is split by pair among ``SPLIT`` tasks.  The documents' own figures
meet their scores by (range, slot).  Inside a group, links are counted by
distinct tokens where the group is large, so a group never grows to the product of its lengths.

Defined cases: a text that is null, empty, or that either tokenizer does not give back byte
for byte has no tokens: zeros, and '' for its groups; a null doc_id is kept and
repeated rows are documents of their own; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import VOCABULARY, Vocabulary, file_bytes
from .common import key_text, slices, stash

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
RANGE = 1 << 14
SPLIT = 4
FLUSH_LINKS = 1 << 22
LARGE = 16          # links a token at which a document's links are counted by distinct tokens
_BITSET = RANGE // 16

RECORD = ("range long, slot int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
          "groups string, pair long, docs int, links long, bits binary, planes binary")
POSTING = "pair long, range long, docs int, links long, bits binary, planes binary"


class Tokenizers:
    """Both tokenizers, with the bytes of their tokens."""

    def __init__(self, a: bytes, b: bytes):
        self.a = Vocabulary(a)
        self.a.special = None   # strings of special tokens inside a text are plain text
        self.b = sentencepiece.SentencePieceProcessor()
        self.b.LoadFromSerializedProto(b)
        self.n_b = self.b.get_piece_size()
        self.n_a = max(self.a.bytes_of) + 1
        self.a_bytes = [self.a.bytes_of.get(i, b"") for i in range(self.n_a)]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(self.b.id_to_piece(list(range(self.n_b))))]
        self.a_length = np.array(list(map(len, self.a_bytes)), np.int64)
        self.b_length = np.array(list(map(len, self.b_bytes)), np.int64)
        # Numbers as written in a groups text, filled up with NUL: inside and at the end of its part of a group.
        written = [x for n, end in ((self.n_a, b"|"), (self.n_b, b";"))
                   for i in range(n) for x in (b"%d," % i, b"%d%s" % (i, end))]
        self.written = np.array(written, f"S{max(8, *map(len, written))}")

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Token numbers of both for each text; none where the text is not given back."""
        none = np.zeros(0, np.int64)
        out = []
        for text, ids in zip(texts, self.a.encode([" " + t if t else "" for t in texts])):
            if not text:
                out.append((none, none))
                continue
            raw = b" " + text.encode()
            a, b = np.frombuffer(ids, "<u4").astype(np.int64), self.b.encode(text, num_threads=1)
            # A's tokens are the text's bytes, only put together (tests hold this); it takes their number to be sure.
            same = b"".join(map(self.b_bytes.__getitem__, b)) == raw and int(self.a_length[a].sum()) == len(raw)
            out.append((a, np.array(b, np.int64)) if same else (none, none))
        return out


_opened: dict[tuple[int, int], Tokenizers] = {}


def opened(a: bytes, b: bytes) -> Tokenizers:
    """The tokenizers of two files' bytes, built once per worker."""
    key = hash(a), hash(b)
    if key not in _opened:
        _opened.clear()
        _opened[key] = Tokenizers(a, b)
    return _opened[key]


class Groups:
    """The groups of a document's two token rows."""

    def __init__(self, a: np.ndarray, b: np.ndarray, t: Tokenizers):
        self.a, self.b = a, b
        end_a, end_b = np.cumsum(t.a_length[a]), np.cumsum(t.b_length[b])
        # Both end at the text's last byte: a mark for each byte tells where the other ends too.
        self.last_a, self.last_b = _marked(end_b, end_a), _marked(end_a, end_b)
        self.upto_a, self.upto_b = np.flatnonzero(self.last_a) + 1, np.flatnonzero(self.last_b) + 1
        self.count_a = np.diff(self.upto_a, prepend=0)
        self.count_b = np.diff(self.upto_b, prepend=0)
        self.n_links = int((self.count_a * self.count_b).sum())

    def text(self, t: Tokenizers) -> bytes:
        """``a1,a2|b1;a3|b2,b3``."""
        if not len(self.a):
            return b""
        # Each token is written with the mark behind it, at its place among the tokens of both.
        out = np.empty(len(self.a) + len(self.b), np.int64)
        out[np.arange(len(self.a)) + np.repeat(self.upto_b - self.count_b, self.count_a)] = 2 * self.a + self.last_a
        out[np.arange(len(self.b)) + np.repeat(self.upto_a, self.count_b)] = 2 * (t.n_a + self.b) + self.last_b
        return t.written.take(out).tobytes().translate(None, b"\0")[:-1]

    def links(self, n_b: int) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        """(pair numbers a * n_b + b, how often each; None: once) of the links, in pieces of bounded size."""
        if self.n_links <= LARGE * (len(self.a) + len(self.b)):
            of_a = np.repeat(np.arange(len(self.count_a)), self.count_a)
            yield _crossed(self.a, self.b, of_a, self.count_b, self.upto_b - self.count_b, n_b)[0], None
            return
        group = np.arange(len(self.count_a))
        (ga, a, times_a), (gb, b, times_b) = (
            _distinct(np.repeat(group, count), ids) for count, ids in ((self.count_a, self.a), (self.count_b, self.b)))
        count_b = np.bincount(gb, minlength=len(group))
        start_b = np.cumsum(count_b) - count_b
        part = (np.cumsum(count_b[ga]) - 1) // FLUSH_LINKS
        for own in np.split(np.arange(len(a)), np.flatnonzero(np.diff(part)) + 1):
            pair, left, right = _crossed(a[own], b, ga[own], count_b, start_b, n_b)
            yield pair, times_a[own][left] * times_b[right]


def _marked(ends: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which of ``others`` are among ``ends`` (both ascending, with the same last one)."""
    mark = np.zeros(int(ends[-1]) + 1 if len(ends) else 0, bool)
    mark[ends] = True
    return mark[others]


def _distinct(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, id, how often) of the distinct tokens of each group."""
    key, times = np.unique(group << 32 | ids, return_counts=True)
    return key >> 32, key & 0xFFFFFFFF, times


def _crossed(a: np.ndarray, b: np.ndarray, group: np.ndarray, count_b: np.ndarray, start_b: np.ndarray,
             n_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each of ``a`` (in ``group``) with all of ``b`` of its group: pairs, and their places in a and b."""
    n = count_b[group]
    ends = np.cumsum(n)
    left = np.repeat(np.arange(len(a)), n)
    right = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(start_b[group], n)
    return a[left] * n_b + b[right], left, right


def pack(pair: np.ndarray, slot: np.ndarray, times: np.ndarray) -> list[pa.Array]:
    """Bitmaps of postings in order of (pair, slot): pair, docs, links, bits, planes."""
    first = np.flatnonzero(np.diff(pair, prepend=-1))
    docs = np.diff(first, append=len(pair))
    links = np.add.reduceat(times, first) if len(first) else np.zeros(0, np.int64)
    packed = slot.astype("<u2")
    bits, planes = [], []
    for i, n, m in zip(first.tolist(), docs.tolist(), links.tolist()):
        bits.append(packed[i:i + n].tobytes() if n <= _BITSET else _bitset(packed[i:i + n]))
        planes.append(b"" if m == n else _planes(times[i:i + n] - 1))
    return [pa.array(pair[first], pa.int64()), pa.array(docs, pa.int32()), pa.array(links, pa.int64()),
            pa.array(bits, pa.binary()), pa.array(planes, pa.binary())]


def _bitset(slots: np.ndarray) -> bytes:
    held = np.zeros(RANGE, bool)
    held[slots] = True
    return np.packbits(held, bitorder="little").tobytes()


def _planes(extra: np.ndarray) -> bytes:
    return b"".join(np.packbits(extra >> k & 1, bitorder="little").tobytes() for k in range(int(extra.max()).bit_length()))


def slots_of(docs: int, bits: bytes) -> np.ndarray:
    if docs <= _BITSET:
        return np.frombuffer(bits, "<u2").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little"))


def times_of(docs: int, planes: bytes) -> np.ndarray:
    times, width = np.ones(docs, np.int64), -(-docs // 8)
    for k in range(len(planes) // width):
        plane = np.frombuffer(planes, np.uint8, width, k * width)
        times += np.unpackbits(plane, count=docs, bitorder="little").astype(np.int64) << k
    return times


def index_documents(docs: DataFrame, a_file: str = VOCABULARY, b_file: str = PIECES, with_groups: bool = False,
                    flush_links: int = FLUSH_LINKS) -> DataFrame:
    """Documents (``pair`` null) and partial postings (``pair`` given) of all rows of ``docs``."""
    a_data, b_data = file_bytes(a_file), file_bytes(b_file)
    names = [f.split()[0] for f in RECORD.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    types = [kinds[f.split()[1]] for f in RECORD.split(", ")]

    def batch(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(names, types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, bits = opened(a_data, b_data), RANGE.bit_length() - 1
        number, begun = 0, TaskContext.get().partitionId() << 32   # documents of this task so far; its first range
        held, held_links = [], 0

        def flush(range_no: int) -> pa.RecordBatch:
            plain = [k for k, w in held if w is None]
            weighed = [(k, w) for k, w in held if w is not None]
            key = np.sort(np.concatenate(plain)) if plain else np.zeros(0, np.int64)
            first = np.flatnonzero(np.diff(key, prepend=-1))
            key, times = key[first], np.diff(first, append=len(key))
            if weighed:
                key, times = _summed(np.concatenate([key, *(k for k, _ in weighed)]),
                                     np.concatenate([times, *(w for _, w in weighed)]))
            pair, docs, links, body, planes = pack(key >> bits, key & RANGE - 1, times)
            return batch(len(pair), range=np.full(len(pair), range_no), pair=pair, docs=docs, links=links, bits=body,
                         planes=planes)

        for slice_ in slices(batches, "text", 1 << 20):
            out = []
            for doc_id, (a, b) in zip(slice_.column("doc_id").to_pylist(), t.encode(slice_.column("text").to_pylist())):
                range_no, slot = begun + (number >> bits), number & RANGE - 1
                g = Groups(a, b, t)
                text = g.text(t)
                out.append((range_no, slot, doc_id, len(a), len(b), len(g.count_a), g.n_links,
                            hashlib.sha256(text).hexdigest() if text else "", text.decode() if with_groups else None))
                for pair, times in g.links(t.n_b) if len(a) else ():
                    held.append((pair << bits | slot, times))
                    held_links += len(pair)
                    if held_links >= flush_links:
                        yield flush(range_no)
                        held, held_links = [], 0
                number += 1
                if held and not number & RANGE - 1:
                    yield flush(range_no)
                    held, held_links = [], 0
            yield batch(len(out), **dict(zip(names, zip(*out)))) if out else batch(0)
        if held:
            yield flush(begun + (number - 1 >> bits))

    return key_text(docs).mapInArrow(run, RECORD)


def _summed(key: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key, times = key[order], times[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first], np.add.reduceat(times, first) if len(first) else times


def merge_postings(records: DataFrame) -> DataFrame:
    """One posting for each (pair, range): partial bitmaps OR-merged, their multiplicities added."""
    names = [f.split()[0] for f in POSTING.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None   # rows of the last (pair, range), which may go on in the next batch
        for batch in batches:
            both = pa.Table.from_batches([last, batch] if last is not None else [batch]).combine_chunks()
            rows = both.to_batches()[0] if both.num_rows else batch
            if not rows.num_rows:
                continue
            pair, range_no = rows.column("pair").to_numpy(), rows.column("range").to_numpy()
            first = np.flatnonzero(np.concatenate([[True], (np.diff(pair) != 0) | (np.diff(range_no) != 0)]))
            last = rows.slice(int(first[-1]))
            yield from merged(rows.slice(0, int(first[-1])), first[:-1])
        if last is not None:
            yield from merged(last, np.zeros(1, np.int64))

    def merged(rows: pa.RecordBatch, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        count = np.diff(first, append=rows.num_rows)
        if len(alone := first[count == 1]):
            yield rows.take(pa.array(alone))
        parts = np.flatnonzero(np.repeat(count > 1, count))
        if not len(parts):
            return
        several = rows.take(pa.array(parts))
        of = np.repeat(np.arange(int((count > 1).sum())), count[count > 1])   # which merged posting a part belongs to
        docs = several.column("docs").to_numpy().astype(np.int64)
        links = several.column("links").to_numpy()
        bits, planes = several.column("bits").to_pylist(), several.column("planes").to_pylist()
        at = np.cumsum(docs) - docs
        slot, times = np.empty(int(docs.sum()), np.int64), np.ones(int(docs.sum()), np.int64)
        listed = docs <= _BITSET
        slot[np.repeat(listed, docs)] = np.frombuffer(b"".join(b for b, x in zip(bits, listed) if x), "<u2")
        for i in np.flatnonzero(~listed).tolist():
            slot[at[i]:at[i] + docs[i]] = slots_of(int(docs[i]), bits[i])
        for i in np.flatnonzero(links > docs).tolist():
            times[at[i]:at[i] + docs[i]] = times_of(int(docs[i]), planes[i])
        key, times = _summed(np.repeat(of, docs) * RANGE + slot, times)   # the same document in two parts: once, times added
        whole = pack(key // RANGE, key % RANGE, times)
        lead = rows.take(pa.array(first[count > 1]))
        yield pa.RecordBatch.from_arrays([lead.column("pair"), lead.column("range"), *whole[1:]], names=names)

    return (records.where("pair IS NOT NULL").select(*names).repartition("pair", "range")
            .sortWithinPartitions("pair", "range").mapInArrow(run, POSTING))


def pair_counts(postings: DataFrame, n_b: int) -> DataFrame:
    """(pair, a, b, count, links, best): documents and links of every pair, and whether its count is its a's highest."""
    summed = postings.groupBy("pair").agg(F.sum("docs").cast("long").alias("count"), F.sum("links").alias("links"))
    a = F.expr(f"pair DIV {n_b}")
    counted = summed.withColumn("a", a).withColumn("b", F.expr(f"CAST(pair % {n_b} AS long)"))
    most = summed.groupBy(a.alias("a")).agg(F.max("count").alias("most"))
    return counted.join(most, "a").select("pair", "a", "b", "count", "links", (F.col("count") == F.col("most")).alias("best"))


def document_scores(postings: DataFrame, counts: DataFrame) -> DataFrame:
    """(range, slot, count_sum, n_best): what the postings give back to their documents."""
    schema = "range long, slot int, count_sum long, n_best long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, None

        def rows() -> pa.RecordBatch:
            slot = np.flatnonzero(sums[0])
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(slot), now), pa.int64()), pa.array(slot, pa.int32()),
                 pa.array(sums[0][slot]), pa.array(sums[1][slot])], names=["range", "slot", "count_sum", "n_best"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("range", "docs", "bits", "planes", "count", "best")]
            for range_no, docs, bits, planes, count, best in zip(*columns):
                if range_no != now:
                    if now is not None:
                        yield rows()
                    now, sums = range_no, np.zeros((2, RANGE), np.int64)
                slot = slots_of(docs, bits)
                times = times_of(docs, planes) if planes else 1
                sums[0, slot] += times * count
                if best:
                    sums[1, slot] += times
        if now is not None:
            yield rows()

    part = F.pmod(F.xxhash64("pair"), F.lit(SPLIT)).alias("part")
    return (postings.join(counts.select("pair", "count", "best"), "pair")
            .select("range", part, "docs", "bits", "planes", "count", "best")
            .repartition("range", "part").sortWithinPartitions("range")
            .mapInArrow(run, schema).groupBy("range", "slot")
            .agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best")))


def align(docs: DataFrame, a_file: str = VOCABULARY, b_file: str = PIECES, with_groups: bool = False,
          flush_links: int = FLUSH_LINKS) -> tuple[DataFrame, DataFrame]:
    """Documents with their figures (and ``groups`` as text, if asked for), and the counts of all pairs."""
    n_b = sentencepiece.SentencePieceProcessor(model_proto=file_bytes(b_file)).get_piece_size()
    records = stash(index_documents(docs, a_file, b_file, with_groups, flush_links))
    postings = stash(merge_postings(records))
    counts = stash(pair_counts(postings, n_b))
    scores = document_scores(postings, counts)
    own = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    rows = (records.where("pair IS NULL").select("range", "slot", *own, "groups_sha256", "groups")
            .join(scores, ["range", "slot"], "left")
            .select(*own, F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
                    F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"), "groups_sha256",
                    *(["groups"] if with_groups else [])))
    return rows, counts


def aligned_documents(docs: DataFrame) -> DataFrame:
    """The contract's columns for every row of ``docs``."""
    return align(docs)[0]


def brute_force(docs: list[tuple], a_encode, b_encode, a_bytes, b_bytes) -> list[tuple]:
    """The contract's rows by comparing every token with every other (for tests).

    ``a_encode``, ``b_encode``: token numbers of a text; ``a_bytes``, ``b_bytes``: bytes of a token number.
    """
    found, counts = [], Counter()
    for doc_id, text in docs:
        a, b = (a_encode(" " + text), b_encode(text)) if text else ([], [])
        raw = b" " + (text or "").encode()
        if b"".join(map(a_bytes, a)) != raw or b"".join(map(b_bytes, b)) != raw:
            a, b = [], []
        ends = [[sum(map(len, map(of, ids[:i + 1]))) for i in range(len(ids))] for ids, of in ((a, a_bytes), (b, b_bytes))]
        common = sorted(set(ends[0]) & set(ends[1]))
        groups = [([x for x, e in zip(a, ends[0]) if low < e <= high], [x for x, e in zip(b, ends[1]) if low < e <= high])
                  for low, high in zip([0, *common], common)]
        links = Counter((x, y) for p, q in groups for x in p for y in q)
        counts.update(set(links))
        found.append((doc_id, a, b, groups, links))
    best: dict[int, int] = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for doc_id, a, b, groups, links in found:
        text = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in groups)
        out.append((doc_id, len(a), len(b), len(groups), sum(links.values()),
                    sum(n for k, n in links.items() if counts[k] == best[k[0]]),
                    sum(n * counts[k] for k, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out
