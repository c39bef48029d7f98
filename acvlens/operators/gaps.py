"""Gaps between consecutive purchases within a group, and their summary.

The reference sorts each (account, service line) and takes ``lag`` of the
date.  A direct window would shuffle every row by the group key and sort a
hot group (one account with a large share of rows) in a single task.  Here
rows are first pre-aggregated to one row per (group, date) — count and the
first row — with partial aggregation before the shuffle.  A group then has
at most one row per calendar day, and the ``lag`` runs on that: the previous
purchase date of a day is the previous day row, and every further row on the
same day is a gap of 0.  Exactly one row of a day is its first: the smallest by
id (a missing id last), then by the other columns; of identical rows, one.  The summary statistics,
including the exact median, are computed from (gap, weight) pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _daily(rows: DataFrame, group_cols: Sequence[str], date_col: str, *extra: Column) -> DataFrame:
    """One row per (group, date) with the row count, ``extra`` and the previous date."""
    g = list(group_cols)
    daily = (rows.filter(F.col(date_col).isNotNull())
                 .groupBy(*g, date_col)
                 .agg(F.count(F.lit(1)).alias("__c"), *extra))
    w = Window.partitionBy(*g).orderBy(F.col(date_col).asc())
    return daily.withColumn("__prev", F.lag(date_col).over(w))


def _rank_of(rows: DataFrame, group_cols: Sequence[str], date_col: str, id_col: str) -> Column:
    """A row's order within its day: id with missing last, then the other columns."""
    rest = [c for c in rows.columns if c not in (*group_cols, date_col, id_col)]
    return F.struct(*[x for c in (id_col, *rest) for x in (F.col(f"`{c}`").isNull().alias(f"n_{c}"), F.col(f"`{c}`"))])


def purchase_gaps(rows: DataFrame, group_cols: Sequence[str], date_col: str, id_col: str,
                  max_gap_days: int, unique_rows: bool = False) -> DataFrame:
    """Every row with its gap in days to the previous purchase of its group.

    Rows are ordered by date, ties by ``id_col``; rows without a date or
    without a previous purchase, and gaps over ``max_gap_days``, are dropped.
    ``unique_rows`` says that no two rows are equal in all columns: the first
    row of a day is then known without shuffling the rows once more.
    """
    g = list(group_cols)
    keys = g + [date_col]
    rows = rows.filter(F.col(date_col).isNotNull())
    rank = _rank_of(rows, g, date_col, id_col)
    daily = _daily(rows, g, date_col, F.min(rank).alias("__first")).alias("__d")
    r = rows.withColumn("__rank", rank).alias("__r")
    on = None
    for k in keys:
        c = F.col(f"__r.`{k}`").eqNullSafe(F.col(f"__d.`{k}`"))
        on = c if on is None else on & c
    j = r.join(daily, on, "inner").select("__r.*", "__d.__first", "__d.__prev")
    first = F.col("__rank").eqNullSafe(F.col("__first"))
    if not unique_rows:
        # Identical rows meet here, and nothing else: one of them can be the first.
        same = Window.partitionBy(*keys, F.xxhash64("__rank")).orderBy("__rank")
        first = first & (F.row_number().over(same) == 1)
    gap = F.when(first, F.datediff(F.col(date_col), F.col("__prev"))).otherwise(F.lit(0)).cast("double")
    out = j.select(*[F.col(f"`{c}`") for c in rows.columns if c != "__rank"], gap.alias("cycle_days"))
    return out.filter(F.col("cycle_days").isNotNull() & (F.col("cycle_days") <= max_gap_days))


def purchase_cycles(rows: DataFrame, group_cols: Sequence[str], date_col: str, id_col: str,
                    max_gap_days: int) -> DataFrame:
    """Per group: mean and exact median gap, purchases (= gaps + 1), last purchase date.

    Same rows as summarising ``purchase_gaps`` per group, computed from the
    per-day rows: the exchange on the group key carries at most one row per
    group and day, and the two windows and the final aggregate share it.
    """
    g = list(group_cols)
    d = _daily(rows, g, date_col)
    gap = F.datediff(F.col(date_col), F.col("__prev"))
    keep = gap.isNotNull() & (gap <= max_gap_days)
    entries = F.array(
        F.when(keep, F.struct(gap.cast("long").alias("v"), F.lit(1).cast("long").alias("w"),
                              F.col(date_col).alias("d"))),
        F.when((F.col("__c") > 1) & F.lit(0 <= max_gap_days),
               F.struct(F.lit(0).cast("long").alias("v"), (F.col("__c") - 1).cast("long").alias("w"),
                        F.col(date_col).alias("d"))),
    )
    e = (d.select(*g, F.explode(entries).alias("__e"))
          .filter(F.col("__e").isNotNull())
          .select(*g, "__e.v", "__e.w", "__e.d"))
    by_value = Window.partitionBy(*g).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*g)
    e = e.select("*", F.sum("w").over(by_value).alias("__cum"), F.sum("w").over(whole).alias("__tot"))
    lo = F.floor((F.col("__tot") + 1) / 2)
    hi = F.floor(F.col("__tot") / 2) + 1
    out = e.groupBy(*g).agg(
        F.sum("w").alias("__n"),
        F.sum(F.col("v") * F.col("w")).alias("__s"),
        F.min(F.when(F.col("__cum") >= lo, F.col("v"))).alias("__m1"),
        F.min(F.when(F.col("__cum") >= hi, F.col("v"))).alias("__m2"),
        F.max("d").alias("most_recent_purchase"),
    )
    out = out.select(
        *g,
        (F.col("__s").cast("double") / F.col("__n").cast("double")).alias("avg_cycle"),
        ((F.col("__m1") + F.col("__m2")).cast("double") / F.lit(2.0)).alias("median_cycle"),
        (F.col("__n") + 1).cast("long").alias("num_opportunities"),
        "most_recent_purchase",
    )
    return out.filter(F.col("num_opportunities") > 1)
