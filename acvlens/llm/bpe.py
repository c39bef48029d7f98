"""Byte-pair encoding and decoding by a segment tree over the ranks of adjacent pairs.

A text is cut at the added tokens' strings and then into pieces by the
vocabulary's pattern; each piece is a row of byte symbols.  A segment tree holds,
for every symbol, the rank of the pair that it makes with the next one: its root
is the leftmost pair of lowest rank.  That pair is merged, which changes three
leaves (the merged symbol's, its left neighbour's, and the one that is gone), each in as
many steps as the tree is high; when the root holds no pair the piece is done.
A piece of n bytes takes O(n log n), however long it is.  Pieces of at most
``LONGEST_REMEMBERED`` bytes are merged many at a time; there the levels above the leaves are taken anew as a whole.

Scale.  Encoding and decoding are map-only: rows neither meet nor shuffle, so a
hot source or group of copies costs its own rows alone.  Pieces that recur are
remembered per worker, up to ``MOST_REMEMBERED`` pieces of at most
``LONGEST_REMEMBERED`` bytes (the memory is emptied when it is full).
The vocabulary file is read on the driver and travels with the job.

Defined cases: null text is empty and has no tokens; a null doc_id is kept and
repeated rows are encoded alike; decoding puts U+FFFD for bytes that are not
UTF-8 and refuses a number that the vocabulary lacks; empty tables give empty results.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

from .common import key_text, slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
# Fixed value: how byte-level vocabularies cut a text into pieces.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MOST_REMEMBERED = 1 << 18
LONGEST_REMEMBERED = 65
MOST_PIECES = 1 << 17
_SMALL = 1 << 12
_NONE = 1 << 62
_HIGH = re.compile("[\U00010000-\U0010FFFF]")


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 characters stand for themselves; the other bytes, in
    order, are written with the characters from U+0100 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


def _newer_letters() -> tuple[re.Pattern, regex.Pattern, re.Pattern]:
    """Letters and digits that the ``regex`` module knows and the tokenizers library doesn't, and two patterns without them.

    The two have Unicode tables of different age; what is newer than Python's own
    tables is held against the library's.  The last pattern is for texts without
    characters from U+10000 on: its classes are lists of characters, which ``re`` looks up in a bitmap.
    """
    known = regex.findall(r"[\p{L}\p{N}]", "".join(map(chr, range(0x110000))))
    theirs = ByteLevel(add_prefix_space=False).pre_tokenize_str
    # Beside a full stop a letter or digit starts a piece of its own.
    new = [ord(c) for c in known if unicodedata.category(c) == "Cn" and len(theirs(f".{c}")) == 1]
    odd = _ranges(new) or r"\U0010FFFF"
    careful = (PATTERN.replace(r"[^\s\p{L}\p{N}]", f"(?:[{odd}]|[^\\s\\p{{L}}\\p{{N}}])")
               .replace(r" ?\p{L}+", f" ?(?:(?![{odd}])\\p{{L}})+").replace(r" ?\p{N}+", f" ?(?:(?![{odd}])\\p{{N}})+"))
    low = "".join(map(chr, range(0x10000)))
    letters, digits, spaces = (_ranges(sorted({*map(ord, regex.findall(c, low))} - {*new})) for c in (r"\p{L}", r"\p{N}", r"\s"))
    plain = (f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{digits}]+| ?[^{spaces}{letters}{digits}]+"
             f"|[{spaces}]+(?![^{spaces}])|[{spaces}]+")
    return re.compile(f"[{odd}]"), regex.compile(careful), re.compile(plain)


def _ranges(numbers: list[int]) -> str:
    """Ascending character numbers as the inside of a class."""
    runs: list[list[int]] = []
    for c in numbers:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in runs)


class Vocabulary:
    """Merges, numbers and bytes of a byte-level vocabulary (the bytes of its JSON file)."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        model, letters = spec["model"], byte_letters()
        if model.get("type", "BPE") != "BPE" or spec.get("normalizer") or model.get("dropout"):
            raise ValueError("not a plain byte-level BPE vocabulary")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take in their surroundings are not supported")
        number = model["vocab"]
        self.shift = max(number.values(), default=0).bit_length()
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[number[a] << self.shift | number[b]] = (rank, number[a + b])
        self.of_byte = [number[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: self._bytes(t, letters) for t, i in [*number.items(), *self.added.items()]}
        self.pair_keys = np.array(sorted(self.merges), np.int64)
        self.pair_ranks = np.array([self.merges[k][0] for k in self.pair_keys.tolist()], np.int64)
        self.new_of_rank = np.array([number["".join(p.split(" ") if isinstance(p, str) else p)] for p in model["merges"]])
        self.cut = regex.compile(PATTERN)
        self.newer, self.careful, self.plain = _newer_letters()
        longest_first = sorted(self.added, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, longest_first))) if longest_first else None
        self.remembered: dict[str, bytes] = {t: i.to_bytes(4, "little") for t, i in self.added.items()}

    @staticmethod
    def _bytes(token: str, letters: dict[str, int]) -> bytes:
        """A token's bytes; one with a character that stands for no byte is text itself."""
        return bytes(map(letters.__getitem__, token)) if all(c in letters for c in token) else token.encode()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The texts' token numbers as little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        held, n = [], 0
        for row, text in enumerate(texts):
            for pieces in self._pieces(text):
                held.append((row, pieces))
                n += len(pieces)
                if n >= MOST_PIECES:
                    self._append(held, out)
                    held, n = [], 0
        self._append(held, out)
        return [b"".join(x) for x in out]

    def _pieces(self, text: str) -> Iterator[list[str]]:
        """The text's pieces in order, in lists of bounded length."""
        cut = self.plain if not _HIGH.search(text) else self.careful if self.newer.search(text) else self.cut
        ends = [(m.start(), m.end()) for m in self.special.finditer(text)] if self.special else []
        at = 0
        for start, end in [*ends, (len(text), len(text))]:
            if start - at <= MOST_PIECES:
                yield cut.findall(text, at, start)
            else:
                found = (m.group() for m in cut.finditer(text, at, start))
                while some := list(islice(found, MOST_PIECES)):
                    yield some
            if end > start:
                yield [text[start:end]]
            at = end

    def _append(self, held: list[tuple[int, list[str]]], out: list[list[bytes]]) -> None:
        """Adds the pieces' numbers to their rows; pieces not met before are merged together."""
        known = self.remembered
        met = set().union(*(pieces for _, pieces in held))
        new = met.difference(known)
        if len(known) + len(new) > MOST_REMEMBERED:
            known.clear()
            known.update((t, i.to_bytes(4, "little")) for t, i in self.added.items())
            new = met.difference(known)
        raw = {p: p.encode() for p in new}
        short = [p for p, b in raw.items() if len(b) <= LONGEST_REMEMBERED]
        known.update(zip(short, self.merge_many([raw[p] for p in short])))
        long = {p: array("I", self.merge([self.of_byte[x] for x in b])).tobytes()
                for p, b in raw.items() if len(b) > LONGEST_REMEMBERED}
        for row, pieces in held:
            out[row].append(b"".join([known[p] if p in known else long[p] for p in pieces] if long
                                     else map(known.__getitem__, pieces)))

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Token numbers of short pieces: one tree a piece, the trees of one height as columns of a matrix.

        Every round takes the roots of all trees that still hold a pair, merges
        these pairs, updates the three leaves of each and then the levels above, each in one go for all trees.
        """
        out: list[bytes] = [b""] * len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        height = np.ceil(np.log2(np.maximum(lengths - 1, 1))).astype(np.int64)
        for h in np.unique(height).tolist():
            rows, size = np.flatnonzero(height == h), 1 << h
            n, width = lengths[rows], size + 2
            symbols = np.full((len(rows), width), -1, np.int64)
            symbols[np.arange(width) < n[:, None]] = np.array(self.of_byte)[
                np.frombuffer(b"".join(pieces[r] for r in rows), np.uint8)]
            symbols = np.ascontiguousarray(symbols.T)
            place = np.arange(width)[:, None]
            after, before = np.tile(place + 1, len(rows)), np.tile(place - 1, len(rows))
            tree = np.full((2 * size, len(rows)), _NONE, np.int64)
            tree[size:] = self._leaf(symbols[:size], symbols[1:size + 1], place[:size])
            while True:
                for k in (1 << x for x in range(h - 1, -1, -1)):
                    np.minimum(tree[2 * k:4 * k:2], tree[2 * k + 1:4 * k:2], out=tree[k:2 * k])
                if not len(r := np.flatnonzero(tree[1] < _NONE)):
                    break
                root = tree[1, r]
                i = root & 0xFFFFFFFF
                j = after[i, r]
                k = np.minimum(after[j, r], width - 1)
                merged = self.new_of_rank[root >> 32]
                symbols[i, r], symbols[j, r] = merged, -1
                after[i, r], before[k, r] = k, i
                left = before[i, r]
                h_at = np.where(left >= 0, left, i)
                tree[size + i, r] = self._leaf(merged, symbols[k, r], i)
                tree[size + np.minimum(j, size - 1), r] = np.where(j < size, _NONE, tree[2 * size - 1, r])
                tree[size + h_at, r] = np.where(left >= 0, self._leaf(symbols[h_at, r], merged, h_at), tree[size + i, r])
            kept = symbols.T >= 0
            ends = np.cumsum(kept.sum(axis=1)) * 4
            data = symbols.T[kept].astype("<u4").tobytes()
            for r, start, end in zip(rows.tolist(), [0, *ends[:-1].tolist()], ends.tolist()):
                out[r] = data[start:end]
        return out

    def _leaf(self, a: np.ndarray, b: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Leaves of the pairs (a, b): rank << 32 | place, or no pair (a symbol that is gone is -1)."""
        key = a << self.shift | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (a >= 0) & (b >= 0), self.pair_ranks[at] << 32 | place, _NONE)

    def merge(self, symbols: list[int]) -> list[int]:
        """``symbols`` with pairs merged, always the leftmost of lowest rank, until none is left."""
        n, merges, shift = len(symbols), self.merges, self.shift
        if n < 2:
            return symbols
        size = 1 << (n - 2).bit_length()   # leaves of the tree: one for each pair, up to a power of two
        # A leaf is rank << 32 | place, so that the least one is the leftmost of lowest rank.
        tree = [_NONE] * (2 * size) if n <= _SMALL else array("q", [_NONE]) * (2 * size)
        after = list(range(1, n + 1)) if n <= _SMALL else array("q", range(1, n + 1))
        before = list(range(-1, n - 1)) if n <= _SMALL else array("q", range(-1, n - 1))
        symbols = symbols if n <= _SMALL else array("q", symbols)
        for i in range(n - 1):
            pair = merges.get(symbols[i] << shift | symbols[i + 1])
            if pair:
                tree[size + i] = pair[0] << 32 | i
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
        while (root := tree[1]) < _NONE:
            i = root & 0xFFFFFFFF
            j = after[i]
            symbols[i] = merges[symbols[i] << shift | symbols[j]][1]
            symbols[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                pair = merges.get(symbols[i] << shift | symbols[k])
                changed = [(i, pair[0] << 32 | i if pair else _NONE), (j, _NONE)]
            else:
                changed = [(i, _NONE), (j, _NONE)]
            if (h := before[i]) >= 0:
                pair = merges.get(symbols[h] << shift | symbols[i])
                changed.append((h, pair[0] << 32 | h if pair else _NONE))
            for place, value in changed:
                at = size + place
                if place < n - 1 and tree[at] != value:
                    tree[at] = value
                    while at > 1:
                        at >>= 1
                        a, b = tree[2 * at], tree[2 * at + 1]
                        least = a if a < b else b
                        if tree[at] == least:
                            break
                        tree[at] = least
        return [s for s in symbols if s >= 0]

    def decode(self, ids: bytes) -> str:
        numbers = np.frombuffer(ids, "<u4").tolist()
        try:
            return b"".join(map(self.bytes_of.__getitem__, numbers)).decode("utf-8", "replace")
        except KeyError as unknown:
            raise ValueError(f"the vocabulary has no token {unknown}") from None


_opened: dict[int, Vocabulary] = {}


def opened(data: bytes) -> Vocabulary:
    """The vocabulary of a file's bytes, built once per worker."""
    key = hash(data)
    if key not in _opened:
        _opened.clear()
        _opened[key] = Vocabulary(data)
    return _opened[key]


def file_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids binary) for every row of ``docs``: token numbers, little-endian, 32 bits each.

    The strings of added tokens are those tokens, as in the library's own encoding.
    """
    data = file_bytes(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = opened(data)
        for batch in slices(batches, "text", 1 << 21):
            ids = v.encode([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return key_text(docs).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids, decoded string) for every row of ``encoded`` (doc_id, ids); null ids are none."""
    data = file_bytes(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = opened(data)
        for batch in slices(batches, "ids"):
            texts = [v.decode(i) if i else "" for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.string())],
                                             names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded string")


def token_ids(column: str = "ids") -> F.Column:
    """A binary ``ids`` column as array<long>."""
    hexed = F.hex(column)
    places = F.expr(f"sequence(0, CAST(octet_length({column}) / 4 AS int) - 1)")
    one = F.transform(places, lambda i: F.conv(F.concat(*[F.substring(hexed, i * 8 + 1 + 2 * k, F.lit(2))
                                                          for k in (3, 2, 1, 0)]), 16, 10).cast("long"))
    return F.when(F.octet_length(column) > 0, one).otherwise(F.array().cast("array<long>"))


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids, decoded) for every row of ``docs``."""
    return decode(encode(docs, vocabulary), vocabulary)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of ``round_trip``."""
    return found.select("doc_id", F.expr("CAST(octet_length(ids) DIV 4 AS long)").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
