"""Deterministic "first row per key" (``distinct(k, .keep_all = TRUE)``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per ``keys``: the smallest by ``order`` (each ascending, NULL last).

    Written as ``min(struct(order…, payload…))`` per key: an aggregate, so the
    survivor is picked map-side before the shuffle (partial aggregation) and
    a hot key never gathers its rows in one task.  ``dropDuplicates`` would
    keep an arbitrary row; a ``row_number`` window would shuffle every row.
    """
    keys = list(keys)
    payload = [c for c in df.columns if c not in keys]
    fields = []
    for i, c in enumerate(order):
        fields += [F.col(c).isNull().alias(f"__n{i}"), F.col(c).alias(f"__o{i}")]
    fields += [F.col(c).alias(c) for c in payload]
    best = df.groupBy(*keys).agg(F.min(F.struct(*fields)).alias("__best"))
    return best.select(*[F.col(k) for k in keys], *[F.col("__best")[c].alias(c) for c in payload])
