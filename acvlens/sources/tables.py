"""Landed tables, the CSV opportunity export, and the CSV sink.

The reference pulls ``opportunity`` / ``account`` from a CRM and reads the
flat report from a CSV export.  Here the CRM tables are landed tables
(Parquet or a catalog table) and the export's columns are picked by header
name and typed by a declared schema (no inference pass).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import CLOSE_YEAR
from .csv_records import read_records
from .schemas import ACCOUNT, OPP_REPORT, OPPORTUNITY


def read_table(spark: SparkSession, path_or_name: str, schema: T.StructType | None = None) -> DataFrame:
    """A landed table: a catalog name, or a Parquet path read with ``schema``'s columns."""
    if "/" not in path_or_name and spark.catalog.tableExists(path_or_name):
        df = spark.table(path_or_name)
    else:
        df = spark.read.parquet(path_or_name)
    if schema is not None:
        df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    return df


def write_opportunity(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Land opportunities laid out by close year (``close_year=…`` folders, rows without a date in one of their own).

    Rows are dealt out by year and rebalanced by size: AQE splits a large year over
    several tasks and files and puts small ones together.  Within a file rows are in order of date,
    so that a bound inside a year skips row groups.
    """
    year = F.year("CloseDate")
    (df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in OPPORTUNITY.fields], year.alias(CLOSE_YEAR))
     .hint("rebalance", CLOSE_YEAR).sortWithinPartitions(CLOSE_YEAR, "CloseDate")
     .write.mode(mode).partitionBy(CLOSE_YEAR).parquet(path))


def read_opportunity(spark: SparkSession, path_or_name: str) -> DataFrame:
    """Landed opportunities; one laid out by close year keeps that column, which year bounds then use."""
    table = read_table(spark, path_or_name)
    layout = [F.col(CLOSE_YEAR)] if CLOSE_YEAR in table.columns else []
    return table.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in OPPORTUNITY.fields], *layout)


def read_account(spark: SparkSession, path_or_name: str) -> DataFrame:
    return read_table(spark, path_or_name, ACCOUNT)


# How R writes and reads a quoted cell: quotes inside are doubled.
CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"'}
BAD_ROW = "__bad_row"


def csv_header(spark: SparkSession, path: str | list[str]) -> list[str]:
    """Column names of the export (its first file), in file order."""
    return spark.read.options(**CSV_OPTIONS).csv(path).columns


def csv_schema(header: list[str]) -> T.StructType:
    """Text columns in file order, and a column that takes the rows that do not fit them."""
    missing = [f.name for f in OPP_REPORT.fields if f.name not in header]
    if missing:
        raise ValueError(f"the export lacks the columns {', '.join(missing)}; it has {', '.join(header)}")
    return T.StructType([T.StructField(c, T.StringType()) for c in [*header, BAD_ROW]])


def csv_reader(reader, schema: T.StructType, multi_line: bool):
    """``reader`` set up for the export; a file whose header differs from the schema is an error."""
    return (reader.schema(schema).options(**CSV_OPTIONS, multiLine=multi_line, enforceSchema=False,
                                          mode="PERMISSIVE", columnNameOfCorruptRecord=BAD_ROW))


def report_columns(raw: DataFrame) -> DataFrame:
    """The declared columns, picked by name and typed.

    A cell ``NA`` is missing; a blank text cell is "" (as R's ``read.csv``
    gives for character columns); a blank or unreadable amount is missing.
    """
    cols = []
    for f in OPP_REPORT.fields:
        text = F.coalesce(F.col(f"`{f.name}`"), F.lit(""))
        text = F.when(text != "NA", text)
        cols.append((text if isinstance(f.dataType, T.StringType) else F.trim(text).try_cast(f.dataType)).alias(f.name))
    return raw.select(*cols)


def read_opp_report_csv(spark: SparkSession, path: str | list[str], multi_line: bool = True,
                        whole_files: bool = False) -> DataFrame:
    """The flat opportunity export: columns by header name, in any order, others ignored.

    A missing column, or files with different headers, are errors.  Quoted
    cells may hold doubled quotes and (``multi_line``) line breaks; a file of either
    kind is read by many tasks (``csv_records``).  ``whole_files`` takes Spark's own reader for
    line breaks in cells instead, which makes a file one task (and knows lines that end with ``\\r`` alone).
    Rows that do not fit are kept as far as they parse; ``unparsed_rows`` shows them.
    """
    return report_columns(_raw_csv(spark, path, multi_line, whole_files))


def _raw_csv(spark: SparkSession, path: str | list[str], multi_line: bool, whole_files: bool = False) -> DataFrame:
    if multi_line and not whole_files:
        options = {k: str(v).lower() if isinstance(v, bool) else v for k, v in CSV_OPTIONS.items() if k != "header"}
        return read_records(spark, path, csv_schema(csv_header(spark, path)), {
            **options, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD_ROW})
    return csv_reader(spark.read, csv_schema(csv_header(spark, path)), multi_line).csv(path)


def unparsed_rows(spark: SparkSession, path: str | list[str], multi_line: bool = True) -> DataFrame:
    """Rows of the export that do not fit its header, or whose amount is no number."""
    raw = _raw_csv(spark, path, multi_line)
    amounts = [F.trim(F.col(f"`{f.name}`")) for f in OPP_REPORT.fields if not isinstance(f.dataType, T.StringType)]
    bad = F.col(BAD_ROW).isNotNull()
    for a in amounts:
        bad = bad | (a.isNotNull() & ~a.isin("", "NA") & a.try_cast(OPP_REPORT["ACV_for_Quotas"].dataType).isNull())
    # All columns are read, so that every malformed row is noticed.
    return raw.where(bad & F.coalesce(F.concat_ws("", *[F.col(f"`{c}`") for c in raw.columns]), F.lit("")).isNotNull())


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """``write.csv(df, file, row.names = FALSE)``: header, missing as ``NA``, quotes doubled.

    The result is a directory of part files; a preceding ``orderBy`` keeps
    its order across parts (range partitioning).  ``single_file`` puts the whole
    result through one task: for small report tables only.
    """
    out = df.coalesce(1) if single_file else df
    (out.write.mode("overwrite").options(**CSV_OPTIONS, nullValue="NA", emptyValue="").csv(path))
