"""What a task of the ranked search holds of the index: a few segments, not all that it writes or reads."""

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from acvlens.llm import search


def test_the_index_is_stored_and_read_a_few_segments_at_a_time(spark, monkeypatch):
    words = F.expr("array_join(transform(sequence(1, 60000), k -> hex(xxhash64(id, k))), ' ')")
    docs = spark.range(0, 12, 1, 1).select(F.col("id").alias("doc_id"), F.concat(words, F.lit(" needle")).alias("text"))
    items = spark.createDataFrame([(7, "needle"), (8, "absent")], "item_id long, text string")
    stored, plans = [], []

    def taken(df, *a, f=search.stash, **options):
        stored.append(f(df, *a, **options))
        return stored[-1]

    def planned(index, *a, f=search.search, **k):
        plans.append((out := f(index, *a, **k))._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(search, "stash", taken)
    monkeypatch.setattr(search, "search", planned)
    found = search.rank_documents(docs, items, 5, segment_words=60001).collect()
    assert sorted((r.item_id, r["rank"], r.doc_id) for r in found) == [(7, n, n - 1) for n in range(1, 6)]
    files = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in stored[0].inputFiles()]
    groups = [m.row_group(i) for m in files for i in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 12 and sum(g.total_byte_size for g in groups) > 30 << 20
    assert max(g.total_byte_size for g in groups) < 16 << 20
    assert len(plans) == 1 and "MapInArrow" not in plans[0]    # a batch of it would be all segments of a task
