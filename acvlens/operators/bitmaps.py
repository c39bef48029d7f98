"""Exact distinct counts that merge: bitmaps over numbered ids.

A count of distinct ids per year cannot be added up to one over several years; a
bitmap of the ids can be OR-ed.  Ids are numbered densely once; per group and range of 32,768
numbers one 4 KB bitmap is built (map-side combined), and the distinct count of
any union of groups is the number of bits in the OR of their bitmaps.  The table of
bitmaps can be kept and asked again, without another look at the rows.

A missing id is an id like any other (``n_distinct`` counts it as one more value).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024   # parts in which ids are numbered side by side


def numbered_ids(df: DataFrame, id_col: str) -> DataFrame:
    """(id, number) of the distinct ids; numbers from 1, dense up to the evenness of a hash.

    Each of ``BUCKETS`` parts numbers its ids alone, and the parts take turns: no task sees all ids.
    """
    ids = df.select(F.col(id_col).alias("id")).distinct()
    bucket = F.pmod(F.xxhash64("id"), F.lit(BUCKETS))
    turn = F.row_number().over(Window.partitionBy("__bucket").orderBy("id")).cast("long") - 1
    return (ids.withColumn("__bucket", bucket).withColumn("number", turn * BUCKETS + F.col("__bucket") + 1)
            .select("id", "number"))


def distinct_bitmaps(df: DataFrame, group_cols: Sequence[str], id_col: str, numbers: DataFrame) -> DataFrame:
    """(group, range_no, bits): the ids of each group as bitmaps of the numbers in each range."""
    g = list(group_cols)
    pairs = df.select(*g, F.col(id_col).alias("__id")).distinct()
    known = pairs.join(numbers, F.col("__id").eqNullSafe(F.col("id")))
    return (known.groupBy(*g, F.bitmap_bucket_number("number").alias("range_no"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits")))


def merged_bitmaps(bitmaps: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """The bitmaps OR-ed to coarser groups (none: all groups together)."""
    return bitmaps.groupBy(*group_cols, "range_no").agg(F.bitmap_or_agg("bits").alias("bits"))


def distinct_counts(bitmaps: DataFrame, group_cols: Sequence[str], name: str) -> DataFrame:
    """Distinct ids per group, from bitmaps of these or of finer groups."""
    g = list(group_cols)
    counted = merged_bitmaps(bitmaps, g).select(*g, F.bitmap_count("bits").alias("__n"))
    return counted.groupBy(*g).agg(F.coalesce(F.sum("__n"), F.lit(0)).cast("long").alias(name))
