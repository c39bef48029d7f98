"""Hashed features of whole texts, as sparse rows for the models of this subpackage."""

from __future__ import annotations

from collections import Counter
from zlib import crc32

import numpy as np

from .decontam import words

WORD_SCALE, MARK_SCALE, LEAST_NORM = 4.0, 10.0, 100.0
_PLAIN = frozenset((b".", b",", b"?", b"!", b";", b":"))
_WORD_BYTES = bytes(c for c in range(256) if c >= 0x80 or chr(c).isalnum())


def word_counts(text: bytes) -> Counter:
    return Counter(words(text))


def hashed(counts: dict[bytes, int], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers and square-rooted shares of the tokens (a row of length 1)."""
    n = len(counts)
    index = np.fromiter(map(crc32, counts), np.uint32, n) & np.uint32((1 << bits) - 1)
    value = np.fromiter(counts.values(), np.float32, n)
    total = value.sum()
    return index.astype(np.int32), np.sqrt(value / total) if total else value


def text_features(text: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of the text and the shapes of its tokens.

    Words: 1 + log(count), scaled to a row of length WORD_SCALE.  Shapes: the
    marks on a token, capitals only, repeats of the token or line before; each
    with MARK_SCALE times its share of the tokens (lines).
    """
    tokens = text.split()
    n = max(1, len(tokens))
    shapes = Counter(text.translate(None, _WORD_BYTES).split())
    odd = sum(v for k, v in shapes.items() if k not in _PLAIN)
    upper = sum(map(bytes.isupper, tokens))
    same = sum(map(bytes.__eq__, tokens[1:], tokens))
    lines = [x for x in text.split(b"\n") if x]
    marks = {b"\x01" + k: v / n for k, v in shapes.items() if k not in _PLAIN}
    marks |= {b"\x02odd": odd / n, b"\x02upper": upper / n, b"\x02same": same / n,
              b"\x02lines": (len(lines) - len(set(lines))) / max(1, len(lines))}
    counts = word_counts(text)
    keys = [*counts, *marks]
    index = np.fromiter(map(crc32, keys), np.uint32, len(keys)) & np.uint32((1 << bits) - 1)
    value = 1 + np.log(np.fromiter(counts.values(), np.float32, len(counts)))
    value *= WORD_SCALE / np.sqrt(max(LEAST_NORM, float((value * value).sum())))
    shares = np.fromiter(marks.values(), np.float32, len(marks)) * MARK_SCALE
    return index.astype(np.int32), np.concatenate([value, shares]).astype(np.float32)
