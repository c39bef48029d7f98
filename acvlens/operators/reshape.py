"""Long ↔ wide reshapes on year-level aggregates.

Inputs here are already aggregated to one row per (id, year), so they are
tiny; explicit pivot values fix the output schema and spare Spark the extra
job that discovers the distinct years.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pivot_wider(df: DataFrame, id_cols: Sequence[str], names_from: str, values_from: str,
                values: Sequence[int | str]) -> DataFrame:
    """``pivot_wider``: one column per value of ``names_from``; missing cell → NULL."""
    out = (df.groupBy(*id_cols)
             .pivot(names_from, list(values))
             .agg(F.first(values_from)))
    return out.select(*id_cols, *[F.col(f"`{v}`").alias(str(v)) for v in values])


def pivot_longer(df: DataFrame, id_cols: Sequence[str], cols: Sequence[str],
                 names_to: str = "metric", values_to: str = "value") -> DataFrame:
    """``pivot_longer`` over same-typed columns."""
    return df.unpivot(list(id_cols), list(cols), names_to, values_to)


def transpose_metrics(df: DataFrame, year_col: str, metric_cols: Sequence[str],
                      years: Sequence[int]) -> DataFrame:
    """Metrics as rows, years as columns (longer, then wider)."""
    long = pivot_longer(df, [year_col], metric_cols, "metric", "value")
    return pivot_wider(long, ["metric"], year_col, "value", years)
