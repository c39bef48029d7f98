"""The corpus pipeline and the registered queries."""

import random

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from acvlens.llm import decontam, quality_model, queries, sharding
from tests.llm.test_operators import _capacity, _classes, _fingerprint, _words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rng = random.Random(21)
    docs, labels = [], []
    item = " ".join(_words(rng, 14, 3000))
    for i in range(160):
        ws = _words(rng, rng.randrange(90, 160))
        if i % 5 == 0:
            ws = [w + "###" for w in ws]
        if i % 16 == 3:
            ws[20:20] = item.split()
        docs.append((i, " ".join(ws), ("en", "de")[i % 2]))
        labels.append((i, int(i % 5 != 0), 0))
    docs += [(200 + k, docs[k][1], docs[k][2]) for k in range(40)]               # exact copies
    docs += [(300 + k, docs[k][1] + " end", docs[k][2]) for k in range(40, 60)]  # near copies
    docs += [(400, None, "en"), (401, "", "de"), (None, "text without an id", "en"), docs[7]]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_pipeline_equals_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    good = quality_model.select_good(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    rows = [(r.doc_id, r.text) for r in good.collect()]
    assert not [i for i, _ in rows if i is not None and i < 160 and i % 5 == 0]
    root = _classes({_fingerprint(t) for _, t in rows})
    first = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(root[_fingerprint(t)], (i, t))
    hit = {r[0] for r in decontam.brute_force(list(first.values()), [(1, spark.read.parquet(
        f"{folder}/benchmark.parquet").first().text)]) if r[5]}
    want = {i for i, _ in first.values()} - hit
    got = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in got} == want and hit
    load, group = {}, {}
    for r in got:
        load.setdefault(r.shard, []).append(r)
    text = dict(rows)
    for r in got:
        group[text[r.doc_id] or ""] = group.get(text[r.doc_id] or "", 0) + r.size
    import hashlib
    sizes = [group[t] for t in sorted(group, key=lambda t: hashlib.sha256(t.encode()).hexdigest())]
    assert max(sum(r.size for r in v) for v in load.values()) == _capacity(sizes, 8)
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in load.values())


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
        assert stage(spark, docs.where("false"), folder).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, SF)
    assert sorted(want.columns) == sorted(got.columns)
    rows = sorted(map(tuple, got.select(*want.columns).collect()))
    assert rows == sorted(want.fetchall()) and rows


def test_entry_has_the_queries():
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in names if k.startswith("op")}
    assert "pipeline" in names and set(queries.ORACLE_SQL) <= set(entry.oracle_sql())
    assert sharding.BUCKETS < 20_000
