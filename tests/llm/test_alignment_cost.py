"""What op11 adds to its tokenizers, and the cutting of texts that it shares with op13."""

import random
import time

import pytest

pytest.importorskip("sentencepiece")
ByteLevel = pytest.importorskip("tokenizers").pre_tokenizers.ByteLevel

from acvlens.llm import alignment, bpe  # noqa: E402


def test_alignment_costs_little_beside_its_piece_library():
    rng = random.Random(5)
    parts = ["an", "the", "ing", "é", "ción", "ß", "ou", "re", "st", "ö", "he", "ll", "a", "t"]
    words = ["".join(rng.choices(parts, k=rng.randrange(1, 5))) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=600)) + "." for _ in range(150)]
    t = alignment.Tokenizers(bpe.file_bytes(bpe.VOCABULARY), bpe.file_bytes(alignment.PIECES))
    pairs = t.encode(texts)   # from here on the words are known

    def seconds(work):
        began = time.process_time()
        work()
        return time.process_time() - began

    def operator():
        for a, b in t.encode(texts):
            g = alignment.Groups(a, b, t)
            g.text(t)
            list(g.links(t.n_b))

    assert all(len(a) and len(b) for a, b in pairs)
    # Both by the same CPU and turn by turn, so that a slow machine slows both.
    library, whole = (min(x) for x in zip(*[(seconds(lambda: [t.b.encode(x, num_threads=1) for x in texts]), seconds(operator))
                                            for _ in range(5)]))
    assert whole < 2.6 * library, whole / library


def test_pieces_of_every_character_equal_the_library():
    v = bpe.Vocabulary(bpe.file_bytes(bpe.VOCABULARY))
    theirs = ByteLevel(add_prefix_space=False).pre_tokenize_str
    for c in (*range(0xD800), *range(0xE000, 0x10000), *range(0x10000, 0x110000, 97)):
        text = f"  a{chr(c)}a {chr(c)}1{chr(c)}. {chr(c)}\n\n{chr(c)}'ll \x1c"
        assert [p for pieces in v._pieces(text) for p in pieces] == [text[a:b] for _, (a, b) in theirs(text)], hex(c)


def test_special_strings_end_the_pieces_before_them():
    text = f"a  <|endoftext|>b é  <|endoftext|>{chr(0x1F600)}  "
    v = bpe.Vocabulary(bpe.file_bytes(bpe.VOCABULARY))
    assert [p for pieces in v._pieces(text) for p in pieces] == [
        "a", "  ", "<|endoftext|>", "b", " é", "  ", "<|endoftext|>", chr(0x1F600), "  "]
