"""The corpus pipeline: documents in, the shard and slot of every training document out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``docs``.  A stage works on all rows that the one
before it kept, and ``run`` writes each stage's rows once to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from acvlens.llm import decontam, mixing, quality_model, sharding, simhash
from acvlens.llm.common import read, stash
from acvlens.llm.queries import MIXTURE


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier expects to be good."""
    return quality_model.select_good(docs, read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (shingles of 3 words, 3 bits)."""
    return simhash.deduplicate(docs, shingle=3, max_bits=3)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"), window=10)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; languages short of their share more often."""
    return mixing.mix(docs, read(spark, sf_dir, "labels"), MIXTURE, least=1.0)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row, equal texts together, shards of near equal size."""
    return sharding.shard_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing to target weights", mix),
    ("sharding", shard),
]

# Fitted models and hashes that SQL lacks: tested against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
