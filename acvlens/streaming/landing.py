"""Incremental landing of the flat opportunity export (the CSV source, SRC3).

The reference re-reads one CSV export in full on every run.  At scale the
exports arrive as files in folders; this job lands each new file once into a
Parquet table with Structured Streaming (file source, ``availableNow`` trigger:
process what is there, then stop).  Any number of folders (or patterns) can be
landed into one table.  The analyses then read the table (``spark.read.parquet``).

Every pair of source and table has a log of its own, the stream's checkpoint,
beside the table (``<table>.landing/<source>``), so that it outlives the
application.  A source is known by its qualified path: two spellings of a folder
are one source.  A batch is first written aside and then moved into the table
under names made of the source and the batch's number; a batch that is run
again after a failure replaces its own files.  Hence no export is lost to
another one and none is there twice.  (While a batch is being moved, a reader
may see a part of it.)

Refused, because rows would be lost or doubled: a second log for a source of
the table; a source that matches files of another source of the table; a table that
Spark's own file sink wrote (its metadata log hides other files).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources import files
from ..sources.tables import csv_header, csv_reader, csv_schema, report_columns

# A file is landed however old it is beside the newest one (the source's own default leaves old ones out).
ANY_AGE = "36500d"


def report_export_stream(spark: SparkSession, export_dir: str, max_files_per_trigger: int | None = None,
                         multi_line: bool = True) -> DataFrame:
    """Streaming DataFrame over the CSV export files in ``export_dir``, columns by header name.

    All files must have the header of the first one; another header stops the stream with an error.
    """
    reader = csv_reader(spark.readStream, csv_schema(csv_header(spark, export_dir)), multi_line)
    reader = reader.option("maxFileAge", ANY_AGE)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return report_columns(reader.csv(export_dir))


def source_key(spark: SparkSession, export_dir: str) -> str:
    """The name of a source in the log and in the table's files, whatever its spelling."""
    return hashlib.sha256(files.qualified(spark, export_dir).encode()).hexdigest()[:16]


def landing_checkpoint(spark: SparkSession, export_dir: str, table_path: str) -> str:
    """Where the landing of this folder into this table keeps its log, whatever application runs it."""
    return f"{table_path.rstrip('/')}.landing/{source_key(spark, export_dir)}"


def _register(spark: SparkSession, export_dir: str, table: str, checkpoint: str) -> None:
    """Notes the source and its log beside the table; refuses what would lose or double rows."""
    if files.exists(spark, f"{table}/_spark_metadata"):
        raise ValueError(f"{table} was written by a file sink with a log of its own: rewrite it as a plain Parquet table "
                         "and land into that")
    folder, key = f"{table}.landing/sources", source_key(spark, export_dir)
    own, log = files.qualified(spark, export_dir), files.qualified(spark, checkpoint)
    for name in files.names(spark, folder):
        if name.startswith("."):
            continue
        source, other_log = files.read_text(spark, f"{folder}/{name}").split("\n")[:2]
        if name == key and other_log != log:
            raise ValueError(f"{source} is landed into {table} with the log {other_log}; a second log would land it twice")
        if name != key and (both := _files(spark, own).intersect(_files(spark, source)).first()):
            raise ValueError(f"{own} and {source} are both landed into {table} and share the file {both.path}")
    if key not in files.names(spark, folder):
        files.write_text(spark, f"{folder}/{key}", f"{own}\n{log}\n")


def _files(spark: SparkSession, source: str) -> DataFrame:
    """Paths of the files that a source matches now (none is opened)."""
    from pyspark.errors import AnalysisException
    try:
        return spark.read.format("binaryFile").load(source).select("path")
    except AnalysisException:   # nothing there any more
        return spark.createDataFrame([], "path string")


def land_batches(stream: DataFrame, table_path: str, checkpoint: str, prefix: str,
                 then: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Starts a stream whose batches go into the Parquet table, each exactly once.

    ``prefix`` tells the files of this stream from those of others.  ``then`` gets every batch's landed rows and
    its number before the batch counts as done; it may get the same batch again after a failure.
    """
    table = table_path.rstrip("/")

    def land(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        staged = f"{table}.landing/staged/{prefix}-{number:06d}"
        batch.write.mode("overwrite").parquet(staged)
        if then:
            then(spark.read.schema(batch.schema).parquet(staged), number)
        files.replace_parts(spark, staged, table, f"part-{prefix}-{number:06d}")

    return (stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())


def land_report_exports(spark: SparkSession, export_dir: str, table_path: str,
                        checkpoint_location: str | None = None,
                        max_files_per_trigger: int | None = None,
                        wait: bool = True, multi_line: bool = True,
                        then: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Append every export file not yet landed to the Parquet table at ``table_path``."""
    checkpoint = checkpoint_location or landing_checkpoint(spark, export_dir, table_path)
    _register(spark, export_dir, table_path.rstrip("/"), checkpoint)
    source = files.qualified(spark, export_dir)
    q = land_batches(report_export_stream(spark, source, max_files_per_trigger, multi_line), table_path, checkpoint,
                     source_key(spark, export_dir), then)
    if wait:
        q.awaitTermination()
    return q
