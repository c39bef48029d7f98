"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..session import checkpoint_dir

PIECE_BYTES = 2 << 20   # of a sample that the driver takes at once


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stash(df: DataFrame, compression: str = "snappy", **options: object) -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and read it back.

    Cuts the lineage for an intermediate that several passes read; the copy
    is columnar (pruning and pushdown work) and any executor can read it.
    ``options`` go to the Parquet writer.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def sorted_join(df: DataFrame) -> DataFrame:
    """``df`` for a join that is done by shuffling and sorting, however small Spark takes its sides to be.

    Rows made by an Arrow function count as wide ones but as no more rows than went in, and a Parquet
    folder counts as its packed bytes; so a table many times over the limit would be broadcast by the driver.
    """
    return df.hint("merge")


def bounded(rows: DataFrame, key: str, size: Column, limit: int, parts: int = 1 << 16) -> DataFrame:
    """The rows of smallest ``key`` (a 64-bit hash) whose sizes add up to ``limit`` or less: a sample bounded in bytes.

    The keys are cut into ``parts`` ranges, of which the first ones that fit are kept; only
    the ranges' sums reach the driver.  All rows where they fit together.
    """
    rows = stash(rows)
    part = _range_of(key, parts)
    held, first_over = 0, parts + 1
    for p, n in _range_sizes(rows, part, size):
        held += n
        if held > limit:
            first_over = p
            break
    return rows.where(part < first_over)


def pieces(rows: DataFrame, key: str, size: Column, limit: int = PIECE_BYTES, parts: int = 1 << 16) -> Iterator[pa.Table]:
    """All of ``rows`` (stored ones, which are read again and again) as Arrow tables of at most ``limit`` bytes by ``size``.

    Each is a run of ranges of ``key`` (a 64-bit hash), or one range that is larger by itself, in
    ascending order.  The driver's JVM holds one table at a time, however many rows there are.
    """
    part = _range_of(key, parts)
    first, held, runs = 0, 0, []
    for p, n in _range_sizes(rows, part, size):
        if held and held + n > limit:
            runs.append((first, p - 1))
            first, held = p, 0
        held += n
    for first, last in [*runs, (first, parts)]:
        yield rows.where(part.between(first, last)).toArrow()


def _range_of(key: str, parts: int) -> Column:
    return F.floor((F.col(key) / 2.0 ** 64 + 0.5) * parts).cast("int")


def _range_sizes(rows: DataFrame, part: Column, size: Column) -> list[tuple[int, int]]:
    return sorted(map(tuple, rows.groupBy(part.alias("p")).agg(F.sum(size)).collect()))


class SparseRows:
    """Rows of hashed features (columns i, v: int32 and float32 bytes) taken piece by piece, then put in order.

    ``sorted_by`` gives the buckets and values of all rows in one array each; a
    piece's bytes are dropped as soon as they are copied there.
    """

    def __init__(self, tables: Iterator[pa.Table], keys: list[str]):
        self.keys = {k: [] for k in keys}
        self.bytes: dict[str, list[list[bytes]]] = {"i": [], "v": []}
        for t in tables:
            for k, held in self.keys.items():
                held += t.column(k).to_pylist()
            for c, held in self.bytes.items():
                held.append(t.column(c).to_pylist())

    def sorted_by(self, order: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index, value, sizes) of the rows numbered ``order``; the rows are gone after it."""
        flat = {c: [x for held in self.bytes.pop(c) for x in held] for c in ("i", "v")}
        sizes = np.array([len(flat["i"][r]) // 4 for r in order], np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        out = []
        for c, kind in (("i", np.int32), ("v", np.float32)):
            rows, all_of = flat.pop(c), np.empty(ends[-1], kind)
            for r, a, b in zip(order, ends, ends[1:]):
                all_of[a:b] = np.frombuffer(rows[r], kind)
                rows[r] = b""
            out.append(all_of)
        return out[0], out[1], sizes


def fresh(name: str, df: DataFrame) -> str:
    """``name``, lengthened until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def key_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id long, text string) of ``docs``: extra columns cannot clash."""
    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))


def batches_bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """UTF-8 bytes of a string column; null is the empty text."""
    return [b if b is not None else b"" for b in batch.column(name).cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], name: str, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice holds about ``max_bytes`` of text (or one row)."""
    for batch in batches:
        start, held = 0, 0
        sizes = [x or 0 for x in pa.compute.binary_length(batch.column(name)).to_pylist()]
        for i, n in enumerate(sizes):
            if held and held + n > max_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def with_field(schema: StructType, name: str, fields: str) -> StructType:
    """``schema`` and a struct column of the given fields (DDL)."""
    return StructType([*schema.fields, StructField(name, StructType.fromDDL(fields))])
