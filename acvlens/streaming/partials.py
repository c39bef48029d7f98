"""Analyses kept up with the landing: partial aggregates of every landed batch.

With each batch of exports that is landed, two partial aggregates of its rows are
written, each to a folder of the batch's own:

* ``dedup``: the first row per (Opp_ID, Close_Date, Record_Type_Name), a minimum, for Q25-Q30;
* ``totals``: rows and ACV per (account, service line), sums, for Q31-Q39.

Both merge: the minimum of minima and the sum of sums are those of all rows.
A batch that is run again overwrites its own folder, and folders are named after the source and
the batch's number, so nothing counts twice.  The analyses read the merged
aggregates, whose size follows the distinct keys, instead of all rows ever landed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.categories import merged_totals
from ..operators.dedup import keep_first
from ..params import Params
from ..plans.cycles import DEDUP_KEYS, report_dedup
from ..plans.penetration import acct_line_totals, acct_sales_of
from .landing import land_report_exports, source_key

BATCH = "batch"


def write_partials(rows: DataFrame, p: Params, folder: str, batch: str) -> None:
    """The partial aggregates of one batch, in place of those an earlier attempt left."""
    for name, part in (("dedup", report_dedup(rows, p)), ("totals", acct_line_totals(rows, p))):
        part.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}/{BATCH}={batch}")


def land_with_partials(spark: SparkSession, export_dir: str, table_path: str, folder: str, p: Params,
                       max_files_per_trigger: int | None = None, wait: bool = True, multi_line: bool = True) -> StreamingQuery:
    """``land_report_exports``, with the partial aggregates of every batch written to ``folder`` before it counts as landed."""
    key = source_key(spark, export_dir)
    return land_report_exports(spark, export_dir, table_path, max_files_per_trigger=max_files_per_trigger, wait=wait,
                               multi_line=multi_line,
                               then=lambda rows, number: write_partials(rows, p, folder, f"{key}-{number:06d}"))


def current_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of Q25 over all that is landed (``dedup=`` of Q26-Q28)."""
    parts = spark.read.parquet(f"{folder.rstrip('/')}/dedup").drop(BATCH)
    return keep_first(parts, DEDUP_KEYS, ["Acct_Id", "ACV_for_Quotas"]).select(*parts.columns)


def current_accounts(spark: SparkSession, folder: str) -> DataFrame:
    """The figures per account over all that is landed (``accounts=`` of Q31-Q39)."""
    parts = spark.read.parquet(f"{folder.rstrip('/')}/totals").drop(BATCH)
    return acct_sales_of(merged_totals(parts, ["Acct_Id"]))
