"""The operators for tokenizers and search against brute force, the libraries, and hard cases."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from acvlens.llm import alignment, bpe, search
from acvlens.llm.oracle import ORACLE_SQL

SCHEMA = "doc_id long, text string, ids string, score string, item int, pair string, `range` string"


def make_rows():
    rng = random.Random(5)
    vocabulary = [f"{'zyxw'[i % 4]}ord{i}" for i in range(90)] + ["the", "of", "naïve", "Straße", "日本語"]
    texts = [None, "", " ", "\n\t ", "a", "The the THE", "▁ odd", "<|endoftext|> and <|endoftext|>", "<s>x</s> <0x41>",
             "x" * 3000, "日本語のテキスト" * 40, "tab\tand\x00nul\x1cmore", "it's we'll 12345 !!! ...", "a  b   c    ",
             " ".join(rng.choice(vocabulary) for _ in range(6000)), "Ᲊ \U000105c0x ꟎1"]
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 80))) for _ in range(40)]
    rows = [(i, t, "x", "y", 1, "p", "r") for i, t in enumerate(texts)]
    return rows + [rows[14], rows[5], (None, "the word without id", None, None, None, None, None), (None, None, *[None] * 5)]


ROWS = make_rows()
PAIRS = [(r[0], r[1]) for r in ROWS]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.VOCABULARY)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(bpe.file_bytes(bpe.VOCABULARY))


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# Byte-pair encoding

def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_bpe_query_equals_the_library(docs, none, library):
    want = []
    for doc_id, text in PAIRS:
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(back.encode())))
    found = bpe.digest(bpe.round_trip(docs))
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert rows_of(found) == sorted(want, key=repr)
    assert bpe.round_trip(none).collect() == []


def test_token_numbers_as_arrays(docs, library):
    found = bpe.encode(docs).select("doc_id", bpe.token_ids().alias("n")).where("doc_id IN (1, 5, 12)").collect()
    for r in found:
        text = dict(PAIRS)[r.doc_id]
        assert r.n == library.encode(text, add_special_tokens=False).ids


def test_merges_of_one_tree_and_of_many_equal_a_plain_search(vocabulary):
    rng = random.Random(3)
    pieces = [bytes(rng.choice(b"abcdehinortst e.") for _ in range(rng.randrange(1, 66))) for _ in range(400)]
    pieces += [bytes([rng.randrange(256) for _ in range(n)]) for n in range(1, 66)]

    def plain(symbols):
        while True:
            ranked = [(vocabulary.merges[p], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:]))
                      if (p := a << vocabulary.shift | b) in vocabulary.merges]
            if not ranked:
                return symbols
            (_, new), i = min(ranked, key=lambda x: (x[0][0], x[1]))
            symbols = [*symbols[:i], new, *symbols[i + 2:]]

    many = vocabulary.merge_many(pieces)
    for piece, ids in zip(pieces, many):
        start = [vocabulary.of_byte[b] for b in piece]
        want = plain(start)
        assert vocabulary.merge(list(start)) == want
        assert np.frombuffer(ids, "<u4").tolist() == want


def test_long_pieces_and_a_full_memory(vocabulary, library, monkeypatch):
    texts = ["ab" * 20000, "a" * 9001, "\n" * 5000 + "end", "hello " * 3000, "é" * 4000]
    monkeypatch.setattr(bpe, "MOST_REMEMBERED", 3)
    monkeypatch.setattr(bpe, "MOST_PIECES", 2)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in vocabulary.encode(texts)] == want


def test_random_texts_equal_the_library(vocabulary, library):
    rng = random.Random(11)
    letters = "abcdetho  '\n\tsé日ñ1 ,.#<|>Ᲊ꟎\U0001f600́"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(2000)]
    texts += [t[:9] + "<|endoftext|>" + t[9:] for t in texts[:200]]
    for text, ids in zip(texts, vocabulary.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert vocabulary.decode(ids) == text


def test_decoding_odd_numbers(spark, vocabulary, library):
    part = [vocabulary.of_byte[0xE6], vocabulary.of_byte[0x97], 64, vocabulary.of_byte[0xFF]]
    assert vocabulary.decode(np.array(part, "<u4").tobytes()) == library.decode(part, skip_special_tokens=False)
    with pytest.raises(ValueError, match="no token"):
        vocabulary.decode(np.array([70000], "<u4").tobytes())
    rows = spark.createDataFrame([(1, None), (2, b"")], "doc_id long, ids binary")
    assert sorted((r.doc_id, r.decoded) for r in bpe.decode(rows).collect()) == [(1, ""), (2, "")]


# Ranked search

ITEMS = [(1, "the word of word3 word3"), (2, "nowhere known"), (3, None), (4, "..."), (5, "THE"), (None, "naïve Straße of"),
         (6, ROWS[14][1][:700]), (1, "the word of word3 word3"), (7, "the zord8 yord9 yord1")]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(*i, "z", 1) for i in ITEMS], "item_id long, text string, item string, `rank` int")


@pytest.mark.parametrize("words, window, block, block_words", [(1 << 20, 512, 128, 200000), (300, 4, 2, 200000), (60, 3, 3, 4)])
def test_search_equals_brute_force(docs, items, none, monkeypatch, words, window, block, block_words):
    monkeypatch.setattr(search, "WINDOW", window)
    monkeypatch.setattr(search, "BLOCK", block)
    found = search.rank_documents(docs, items, segment_words=words, block_words=block_words)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows_of(found) == sorted(search.brute_force(PAIRS, ITEMS), key=repr)
    assert search.rank_documents(none, items).collect() == []


def test_search_equals_its_sql(docs, items, spark):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas())
    con.register("benchmark", items.select("item_id", "text").toPandas())
    sql = con.execute(ORACLE_SQL["op12_ranked_search"]).fetchall()
    plain = [(None if r[0] is None or r[0] != r[0] else int(r[0]), r[1], None if r[2] is None or r[2] != r[2] else int(r[2]), r[3])
             for r in sql]
    assert sorted(plain, key=repr) == rows_of(search.rank_documents(docs, items))


def test_block_maxima_spare_blocks():
    rng = random.Random(2)
    texts = [[rng.choice([b"rare%d" % (i // 400), b"common", b"also", b"too"]) for _ in range(rng.randrange(5, 60))] for i in range(6000)]
    vocabulary = sorted({w for x in texts for w in x}, reverse=True)
    ids = np.array([vocabulary.index(w) for x in texts for w in x], np.int32)
    row = search.segment(list(range(6000)), list(map(len, texts)), ids, vocabulary).to_pylist()[0]
    shard = search.Shard(row)
    n_words = sum(map(len, texts))
    m = search.norms(shard.lengths, 6000, n_words)
    df = {t: sum(t in x for x in texts) for t in (b"rare0", b"common", b"also")}
    query = [(t, search.weight(6000, n)) for t, n in df.items()]
    lists = search.Lists(shard, query, {t: shard.find(t) for t in df}, m, lambda x: search.norms(x, 6000, n_words))
    heap = search.Heap(10)
    search.search_shard(shard, lists, heap)
    blocks = sum(map(len, lists.heads))
    assert 0 < shard.opened < blocks / 2
    scores = [sum(w * (1_000_000_000 * x.count(t) // (1000 * x.count(t) + 8 * int(k))) for t, w in query if t in x)
              for x, k in zip(texts, m)]
    assert heap.rows() == sorted(((i, s) for i, s in enumerate(scores)), key=lambda r: (-r[1], r[0]))[:10]


def test_norms_of_huge_corpora():
    lengths = np.array([10 ** 9, 5], np.int64)
    assert search.norms(lengths, 10 ** 12, 10 ** 15).tolist() == [25 + 75 * 10 ** 21 // 10 ** 15, 25]


# Alignment

@pytest.fixture(scope="module")
def encoders():
    plain = Tokenizer.from_file(bpe.VOCABULARY)
    plain.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=alignment.PIECES)
    letters = bpe.byte_letters()

    def piece_bytes(i):
        return bytes([int(pieces.id_to_piece(i)[3:-1], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode()

    return (lambda t: plain.encode(t, add_special_tokens=False).ids, pieces.encode,
            lambda i: bytes(letters[c] for c in plain.id_to_token(i)), piece_bytes)


SHORT = [(i, t and t[:600]) for i, t in PAIRS]


@pytest.mark.parametrize("flush, large", [(1 << 22, 16), (40, 16), (500, 0)])
def test_alignment_equals_brute_force(spark, encoders, monkeypatch, flush, large):
    monkeypatch.setattr(alignment, "LARGE", large)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in SHORT], "doc_id long, text string, pair string, slot int").repartition(3)
    found, _ = alignment.align(docs, flush_links=flush)
    want = alignment.brute_force(SHORT, *encoders)
    assert any(r[4] > 10 for r in want) and sum(r[1] == 0 for r in want) >= 4
    assert rows_of(found) == sorted(want, key=repr)


@pytest.mark.parametrize("size", [16, 64])
def test_alignment_over_many_small_ranges(spark, encoders, monkeypatch, size):
    monkeypatch.setattr(alignment, "RANGE", size)
    monkeypatch.setattr(alignment, "_BITSET", size // 16)
    docs = spark.createDataFrame(SHORT, "doc_id long, text string").repartition(2)
    found, counts = alignment.align(docs, flush_links=300)
    assert rows_of(found) == sorted(alignment.brute_force(SHORT, *encoders), key=repr)
    total = found.agg({"n_links": "sum"}).first()[0]
    assert counts.agg({"links": "sum"}).first()[0] == total


def test_alignment_empty_and_with_groups(spark, none, encoders):
    assert alignment.aligned_documents(none).collect() == []
    one = spark.createDataFrame([(1, "Hello wörld")], "doc_id long, text string")
    rows, counts = alignment.align(one, with_groups=True)
    r = rows.first()
    assert r.groups_sha256 == sha(r.groups.encode()) and r.n_groups == r.groups.count(";") + 1
    assert r.n_best == r.n_links and counts.where("best").count() == counts.count() == r.n_links


def test_bitmaps_round_trip():
    rng = np.random.default_rng(1)
    for n in (1, 7, 1024, 1025, 9000):
        slot = np.sort(rng.choice(alignment.RANGE, n, replace=False))
        times = rng.integers(1, 40, n)
        pair, docs, links, bits, planes = alignment.pack(np.full(n, 3), slot, times)
        assert (docs[0].as_py(), links[0].as_py()) == (n, times.sum())
        assert alignment.slots_of(n, bits[0].as_py()).tolist() == slot.tolist()
        assert alignment.times_of(n, planes[0].as_py()).tolist() == times.tolist()
