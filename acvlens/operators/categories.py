"""Per-key totals with the number of distinct categories (service lines, record types)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def category_totals(df: DataFrame, keys: Sequence[str], category: str, sums: Mapping[str, Column]) -> DataFrame:
    """``sums`` (additive aggregates by name) per key and category (``__category``): totals that can be merged."""
    return df.groupBy(*keys, F.col(category).alias("__category")).agg(*[e.alias(c) for c, e in sums.items()])


def merged_totals(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The ``category_totals`` of all rows, from those of any parts of them."""
    sums = [c for c in parts.columns if c not in (*keys, "__category")]
    types = dict(parts.dtypes)
    return parts.groupBy(*keys, "__category").agg(*[F.sum(c).cast(types[c]).alias(c) for c in sums])


def key_totals(totals: DataFrame, keys: Sequence[str], distinct: str,
               distinct_if: Mapping[str, str] | None = None) -> DataFrame:
    """Per key the sums of its ``category_totals`` and the number of categories (each is one row)."""
    sums = [c for c in totals.columns if c not in (*keys, "__category")]
    types = dict(totals.dtypes)
    return totals.groupBy(*keys).agg(
        *[F.sum(c).cast(types[c]).alias(c) for c in sums],
        F.count(F.lit(1)).alias(distinct),
        *[F.count_if(F.col(c) > 0).alias(name) for name, c in (distinct_if or {}).items()])


def by_category(df: DataFrame, keys: Sequence[str], category: str, distinct: str,
                sums: Mapping[str, Column], distinct_if: Mapping[str, str] | None = None) -> DataFrame:
    """``sums`` per key, and how many categories it has (a missing one counts as one more).

    Two levels: totals per (key, category), then per key, where every row is
    one category.  Both are hash aggregates with map-side combine; no set of
    categories is held for a key, and a hot key is spread by category.
    ``sums``: additive aggregates by name; ``distinct_if``: counts of the
    categories whose named sum is positive.
    """
    return key_totals(category_totals(df, keys, category, sums), keys, distinct, distinct_if)
