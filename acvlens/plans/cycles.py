"""Purchase-cycle report over the flat opportunity export (Q22–Q30)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import mdy, mdy_strict, n, n_distinct, present
from ..operators.bitmaps import distinct_bitmaps, distinct_counts, numbered_ids
from ..operators.dedup import keep_first
from ..operators.gaps import purchase_cycles as _cycles
from ..operators.gaps import purchase_gaps as _gaps
from ..operators.stats import boxplot_outliers, boxplot_stats, density
from ..params import Params
from ..session import materialize

ROW_COLS = ("Opp_ID", "Acct_Id", "Record_Type_Name", "Close_Date", "ACV_for_Quotas")
DEDUP_KEYS = ("Opp_ID", "Close_Date", "Record_Type_Name")
GROUP = ("Acct_Id", "Record_Type_Name")


def report_won(report: DataFrame, p: Params) -> DataFrame:
    """Q22: won rows in the service-line list."""
    return report.filter((F.col("Stage") == p.won) & F.col("Record_Type_Name").isin(*p.service_lines))


def report_client_rows(report: DataFrame, p: Params) -> DataFrame:
    """Q23: distinct 5-tuples keyed by the end client."""
    return report_won(report, p).select(*ROW_COLS).distinct()


def report_cpa_rows(report: DataFrame, p: Params) -> DataFrame:
    """Q24: distinct 5-tuples keyed by the CPA contact."""
    return (report_won(report, p)
            .filter(present("CPA_Contact_Acct_ID"))
            .select("Opp_ID", F.col("CPA_Contact_Acct_ID").alias("Acct_Id"),
                    "Record_Type_Name", "Close_Date", "ACV_for_Quotas")
            .distinct())


def report_dedup(report: DataFrame, p: Params) -> DataFrame:
    """Q25: client rows ∪ CPA rows, first row per (Opp_ID, Close_Date, Record_Type_Name).

    Client rows are bound first, and every CPA row's key comes from a won row
    that is also a client row, so a CPA row never survives: the result is the
    first client row per key — the smallest ``Acct_Id``, then the smallest
    ACV with missing last (the group order of the client-row summary).  The
    CPA branch is therefore not computed.  ``report_dedup_sorted`` gives the
    rows in display order; the downstream analyses do not need it.
    """
    rows = report_won(report, p).select(*ROW_COLS)
    return keep_first(rows, DEDUP_KEYS, ["Acct_Id", "ACV_for_Quotas"]).select(*ROW_COLS)


def report_dedup_by_party(report: DataFrame, p: Params) -> DataFrame:
    """Q25b (extension): first row per (Opp_ID, Acct_Id, Close_Date, Record_Type_Name),
    so a CPA row survives for a party that is not the end client.

    One scan: each won row yields its client row and, when a CPA contact is
    present, its CPA row (bound second); the keep-first aggregate subsumes
    the DISTINCT of each group.
    """
    party = F.explode(F.array(
        F.struct(F.col("Acct_Id").alias("a"), F.lit(0).alias("src")),
        F.when(present("CPA_Contact_Acct_ID"),
               F.struct(F.col("CPA_Contact_Acct_ID").alias("a"), F.lit(1).alias("src")))))
    rows = (report_won(report, p)
            .select("Opp_ID", "Record_Type_Name", "Close_Date", "ACV_for_Quotas", party.alias("__p"))
            .where(F.col("__p").isNotNull())
            .select("Opp_ID", F.col("__p.a").alias("Acct_Id"), "Record_Type_Name", "Close_Date",
                    "ACV_for_Quotas", F.col("__p.src").alias("__src")))
    keys = ("Opp_ID", "Acct_Id", "Close_Date", "Record_Type_Name")
    return keep_first(rows, keys, ["__src", "ACV_for_Quotas"]).select(*ROW_COLS)


def service_line_counts(report: DataFrame, p: Params, dedup: DataFrame | None = None) -> DataFrame:
    """Q26: per service line distinct accounts and rows of Q25 (``dedup`` if it is already written)."""
    rows = report_dedup(report, p) if dedup is None else dedup
    return rows.groupBy("Record_Type_Name").agg(
        n_distinct("Acct_Id", p.approx_distinct).alias("distinct_accts"), n().alias("num_opps"))


def service_line_bitmaps(report: DataFrame, p: Params, dedup: DataFrame | None = None) -> DataFrame:
    """Accounts of Q25 per service line as bitmaps: the table from which Q26's distinct counts merge."""
    rows = materialize((report_dedup(report, p) if dedup is None else dedup).select("Record_Type_Name", "Acct_Id").distinct())
    return distinct_bitmaps(rows, ["Record_Type_Name"], "Acct_Id", materialize(numbered_ids(rows, "Acct_Id")))


def service_line_accounts(bitmaps: DataFrame) -> DataFrame:
    """Distinct accounts per service line, and over all lines (``total``), from one table of bitmaps."""
    lines = distinct_counts(bitmaps, ["Record_Type_Name"], "distinct_accts").withColumn("total", F.lit(False))
    return lines.unionByName(distinct_counts(bitmaps, [], "distinct_accts")
                             .withColumns({"Record_Type_Name": F.lit(None).cast("string"), "total": F.lit(True)}))


def dated(dedup: DataFrame) -> DataFrame:
    """The rows of Q25 with their parsed date, the text as ``date_text`` behind it.

    To be written before use: every row's date is then parsed once, and no parse is
    pushed below the de-duplication or repeated in a filter, a key and a
    projection.  (Opp_ID, Record_Type_Name, date_text) tells the rows apart.
    """
    return dedup.select("Opp_ID", "Acct_Id", "Record_Type_Name", mdy("Close_Date").alias("Close_Date"),
                        "ACV_for_Quotas", F.col("Close_Date").alias("date_text"))


def report_dated(report: DataFrame, p: Params) -> DataFrame:
    """``dated`` rows of Q25 straight from the report.

    The parsed date is a payload of the keep-first aggregate: one parse a row, and a
    filter on it cannot be pushed below the aggregate and parse again.
    """
    rows = report_won(report, p).select(*ROW_COLS, mdy("Close_Date").alias("date"))
    first = keep_first(rows, DEDUP_KEYS, ["Acct_Id", "ACV_for_Quotas"])
    return first.select("Opp_ID", "Acct_Id", "Record_Type_Name", F.col("date").alias("Close_Date"), "ACV_for_Quotas",
                        F.col("Close_Date").alias("date_text"))


def report_dedup_sorted(report: DataFrame, p: Params, dedup: DataFrame | None = None) -> DataFrame:
    """Q25 in its display order: by account, then by the strictly parsed close date (``parsed_date``)."""
    rows = report_dedup(report, p) if dedup is None else dedup
    return (rows.withColumn("parsed_date", mdy_strict("Close_Date"))
            .orderBy(F.col("Acct_Id").asc_nulls_last(), F.col("parsed_date").asc_nulls_last(), "Opp_ID"))


def purchase_gaps(report: DataFrame, p: Params, dedup: DataFrame | None = None,
                  dates: DataFrame | None = None) -> DataFrame:
    """Q27: gap in days to the previous purchase per (account, service line), ≤ max.

    The dated rows feed both the per-day pre-aggregate and the join back
    (``dates``: ``dated`` rows if they are already written).
    """
    if dates is None:
        dates = materialize(report_dated(report, p) if dedup is None else dated(dedup))
    return _gaps(dates, GROUP, "Close_Date", "Opp_ID", p.max_gap_days, unique_rows=True).drop("date_text")


def purchase_cycles(report: DataFrame, p: Params, dedup: DataFrame | None = None,
                    dates: DataFrame | None = None) -> DataFrame:
    """Q28: mean / median gap, purchases and last purchase per (account, service line)."""
    if dates is None:
        dates = report_dated(report, p) if dedup is None else materialize(dated(dedup))
    return _cycles(dates, GROUP, "Close_Date", "Opp_ID", p.max_gap_days)


def _written_cycles(report: DataFrame, p: Params, cycles: DataFrame | None) -> DataFrame:
    return materialize(purchase_cycles(report, p)) if cycles is None else cycles


def cycle_boxplot(report: DataFrame, p: Params, cycles: DataFrame | None = None) -> DataFrame:
    """Q29: box-plot statistics of ``avg_cycle`` by service line (``cycles``: Q28 if already written)."""
    return boxplot_stats(_written_cycles(report, p, cycles), ["Record_Type_Name"], "avg_cycle")


def cycle_boxplot_outliers(report: DataFrame, p: Params, cycles: DataFrame | None = None) -> DataFrame:
    """Q29 (points): the (account, service line) rows drawn as box-plot outliers."""
    return boxplot_outliers(_written_cycles(report, p, cycles), ["Record_Type_Name"], "avg_cycle",
                            keep_cols=["Acct_Id"])


def cycle_density(report: DataFrame, p: Params, binned: bool = True, cycles: DataFrame | None = None) -> DataFrame:
    """Q30: kernel density of ``avg_cycle`` per service line (512-point grid)."""
    return density(_written_cycles(report, p, cycles), ["Record_Type_Name"], "avg_cycle", binned=binned)
