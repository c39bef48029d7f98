"""Joins: dimension lookups and the NA-matching many-to-many full join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def lookup(df: DataFrame, dim: DataFrame, left_key: str, right_key: str | None = None,
           keep_left_key: bool = True, reduce_dim: bool = True, write_left: bool = True) -> DataFrame:
    """Left N:1 join of an aggregated table to a dimension (account names).

    No broadcast hint: the dimension grows with the data.  A left join can
    only build its right side, so a plain join would shuffle the whole
    dimension to attach names to a few rows.  With ``reduce_dim`` (for key
    sets that are a small part of the dimension, e.g. referrers) the left
    side (one row per key) is written once, and the dimension is first cut
    to its keys by a semi join — AQE broadcasts the key set when its
    measured size is under ``spark.sql.adaptive.autoBroadcastJoinThreshold``
    (the dimension is then filtered map-side, no shuffle) and sort-merges
    otherwise.  When the keys cover most of the dimension, ``reduce_dim=False``
    is the cheaper plan (one sort-merge join).  ``write_left=False`` when
    ``df`` already reads written data (cheap to read twice).
    """
    right_key = right_key or left_key
    if reduce_dim:
        if write_left:
            df = materialize(df)
        keys = df.select(F.col(left_key).alias(right_key)).where(F.col(right_key).isNotNull()).distinct()
        dim = dim.join(keys, right_key, "left_semi")
    if left_key == right_key:
        return df.join(dim, left_key, "left")
    out = df.join(dim, df[left_key] == dim[right_key], "left")
    return out.drop(dim[right_key]) if keep_left_key else out


def full_join_null_safe(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """``full_join(a, b, by = key)`` with NA matching NA, many-to-many.

    Built as inner ∪ left-only ∪ right-only.  A full outer sort-merge join
    cannot have a skewed key split by AQE; an inner join can, so a key that
    holds a large share of either side (the missing name, a common firm
    name) is spread over several tasks.  The one-sided parts are anti joins
    against the other side's distinct keys.
    """
    a_cols = [c for c in a.columns if c != key]
    b_cols = [c for c in b.columns if c != key]
    A, B = a.alias("__a"), b.alias("__b")
    on = F.col(f"__a.`{key}`").eqNullSafe(F.col(f"__b.`{key}`"))
    inner = A.join(B, on, "inner").select(
        F.col(f"__a.`{key}`").alias(key),
        *[F.col(f"__a.`{c}`").alias(c) for c in a_cols],
        *[F.col(f"__b.`{c}`").alias(c) for c in b_cols])
    b_keys = b.select(key).distinct().alias("__b")
    a_keys = a.select(key).distinct().alias("__a")
    left_only = A.join(b_keys, on, "left_anti").select(
        F.col(f"__a.`{key}`").alias(key), *[F.col(f"__a.`{c}`").alias(c) for c in a_cols],
        *[F.lit(None).cast(b.schema[c].dataType).alias(c) for c in b_cols])
    right_only = B.join(a_keys, on, "left_anti").select(
        F.col(f"__b.`{key}`").alias(key),
        *[F.lit(None).cast(a.schema[c].dataType).alias(c) for c in a_cols],
        *[F.col(f"__b.`{c}`").alias(c) for c in b_cols])
    return inner.unionByName(left_only).unionByName(right_only)


def left_join_null_safe(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """``left_join(a, b, by = key)`` with NA matching NA (AQE can split a skewed left side)."""
    a_cols = [c for c in a.columns if c != key]
    b_cols = [c for c in b.columns if c != key]
    A, B = a.alias("__a"), b.alias("__b")
    on = F.col(f"__a.`{key}`").eqNullSafe(F.col(f"__b.`{key}`"))
    return A.join(B, on, "left").select(
        F.col(f"__a.`{key}`").alias(key),
        *[F.col(f"__a.`{c}`").alias(c) for c in a_cols],
        *[F.col(f"__b.`{c}`").alias(c) for c in b_cols])
