"""Tables that grow with the documents are not broadcast by the driver, however small Spark takes them to be."""

import random

import pytest
from pyspark.sql import functions as F

from acvlens.llm import components, simhash


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _broadcast(plans) -> list[str]:
    """Joins that broadcast a table, but for the rounds of the components: they may broadcast the nodes (counted by then)."""
    joins = [line for p in plans for line in p.splitlines() if "BroadcastHashJoin" in line]
    return [x for x in joins if "[u#" not in x or "LeftOuter, BuildRight" not in x]


@pytest.fixture()
def plans(monkeypatch):
    """Plans of what the two modules write."""
    seen = []
    for module in (simhash, components):
        def taken(df, f=module.stash):
            seen.append(_plan(df))
            return f(df)
        monkeypatch.setattr(module, "stash", taken)
    return seen


def _near(n=40):
    rng = random.Random(11)
    fps = {rng.getrandbits(63) for _ in range(n)}
    return sorted(fps | {f ^ 1 << rng.randrange(60) for f in list(fps)[:n // 2]})


def test_the_keys_of_fingerprints_are_not_broadcast(spark, plans):
    fps = spark.createDataFrame([(f,) for f in _near()], "fp long")
    linked = simhash.link_fingerprints(fps)
    plans.append(_plan(linked))
    keys = [p for p in plans if "MapInArrow" in p and "Join" in p]
    assert len(keys) == 1 and "SortMergeJoin" in keys[0]
    assert not _broadcast(plans)
    assert linked.select("component").distinct().count() == 40


def test_near_duplicates_broadcast_nothing(spark, plans):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("one two three four five "), F.expr("id % 50")).alias("text"))
    marked, kept = simhash.near_duplicates(docs), simhash.deduplicate(docs)
    plans += [_plan(marked), _plan(kept)]
    assert sum("SortMergeJoin" in p for p in plans) >= 6
    assert not _broadcast(plans)
    assert marked.count() == 200 and 1 <= kept.count() <= 50


def test_the_rounds_of_the_components_never_broadcast_links(spark, plans):
    links = spark.range(300).select(F.expr("id div 7").alias("a"), F.expr("id % 40 + 20").alias("b"))
    components.connected_components(links, "a", "b").collect()
    rounds = [p for p in plans if "Join" in p]
    assert rounds and not _broadcast(rounds)
    assert all("LeftOuter" in line for p in rounds for line in p.splitlines() if "Join " in line)
