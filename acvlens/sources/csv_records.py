"""CSV files whose quoted cells may hold line breaks, read by many tasks a file.

A line break ends a record only outside quotes, and whether a line begins inside
quotes depends on everything before it.  That is found by a prefix scan.  A line is a
function from "inside or outside a quoted cell at its start" to the same at its
end; such functions are the identity, a constant, or the exchange of both, and
compose: the state before a line is the last constant before it, exchanged as
often as exchanges lie between.  The scan has two levels, lines within a block
of a file (a split of the text source) and blocks within a file, and runs over an
index of a few bytes a line.

The index gives the lines that continue a record.  All other lines are records as they
stand and are parsed where they are read; the lines of records over several
lines meet by record.  So the text is read twice and, but for those records,
never shuffled; no file, however large, is one task.  Where no line, begun outside quotes, ends
inside them, there are no such records, and the scan is left out.  The scan holds one row per block of
a file in one task.

Lines end with ``\\n`` or ``\\r\\n`` (as the first line of a file does); ``\\r\\n`` inside
a cell of a file of the latter kind reads as ``\\n``.  A quote opens a cell only at its beginning, and a
cell that goes on after its closing quote ends at the next comma, as in Spark's own reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

OUT, IN, CLOSING = 0, 1, 2


def _line_end(start: int) -> Column:
    """State at the end of the line ``value`` that begins in ``start``: a fold over the pieces between its quotes."""
    def step(acc: Column, piece: Column) -> Column:
        opens = F.endswith(piece, F.lit(",")) | ((acc["i"] == 0) & (piece == "") & F.lit(start == OUT))
        state = (F.when(acc["s"] == IN, CLOSING)
                 .when((acc["s"] == CLOSING) & (piece == ""), IN)
                 .when(opens, IN).otherwise(OUT))
        return F.struct((acc["i"] + 1).alias("i"), state.alias("s"))

    pieces = F.split("value", '"', -1)
    before_quotes = F.slice(pieces, 1, F.size(pieces) - 1)
    end = F.aggregate(before_quotes, F.struct(F.lit(0).alias("i"), F.lit(start).alias("s")), step)["s"]
    return F.when(end == IN, IN).otherwise(OUT)


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, block, line, value): the files' physical lines, numbered in order within a block.

    The same list of files gives the same numbers in every pass.
    """
    return (spark.read.option("lineSep", "\n").text(paths)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("line"), "value"))


def line_index(lines: DataFrame) -> DataFrame:
    """(file, block, line, outside, inside): the state that each start of a line leads to."""
    quoted = F.contains("value", F.lit('"'))
    return lines.select("file", "block", "line",
                        F.when(quoted, _line_end(OUT)).otherwise(OUT).cast("byte").alias("outside"),
                        F.when(quoted, _line_end(IN)).otherwise(IN).cast("byte").alias("inside"))


def multi_line_members(index: DataFrame) -> DataFrame:
    """(file, block, line, begins) of the lines of records over several lines; ``begins``: where the record begins."""
    place = F.struct("block", "line")
    in_block = Window.partitionBy("file", "block").orderBy("line")
    before = in_block.rowsBetween(Window.unboundedPreceding, -1)
    swap = (F.col("outside") == IN) & (F.col("inside") == OUT)
    # Level one: what the lines of a block before this one make of either start of the block.
    index = index.withColumn("swaps", F.sum(F.when(swap, 1).otherwise(0)).over(in_block))
    constant = F.when(F.col("outside") == F.col("inside"), F.struct(F.col("outside").alias("to"), F.col("swaps").alias("at")))
    index = (index.withColumn("last", F.last(constant, ignorenulls=True).over(before))
             .withColumn("earlier", F.coalesce(F.lag("swaps").over(in_block), F.lit(0))))
    # Level two: each block as one function, and the state before it.
    end = F.max_by(F.struct(F.coalesce(constant, F.col("last")).alias("last"), F.col("swaps")), F.col("line"))
    blocks = index.groupBy("file", "block").agg(end.alias("end")).select("file", "block", "end.*")
    odd = (F.col("swaps") - F.coalesce(F.col("last.at"), F.lit(0))) % 2
    blocks = blocks.select("file", "block", odd.alias("odd"), ((F.col("last.to") + odd) % 2).alias("fixed"))
    in_file = Window.partitionBy("file").orderBy("block")
    blocks = blocks.withColumn("turns", F.sum(F.when(F.col("fixed").isNull(), F.col("odd")).otherwise(0)).over(in_file))
    fixed = F.last(F.when(F.col("fixed").isNotNull(), F.struct("fixed", "turns")), ignorenulls=True).over(
        in_file.rowsBetween(Window.unboundedPreceding, -1))
    turns = F.coalesce(F.lag("turns").over(in_file), F.lit(0)) - F.coalesce(fixed["turns"], F.lit(0))
    starts = blocks.select("file", "block", ((F.coalesce(fixed["fixed"], F.lit(OUT)) + turns) % 2).alias("start"))
    state = (F.coalesce(F.col("last.to"), F.col("start")) + F.col("earlier") - F.coalesce(F.col("last.at"), F.lit(0))) % 2
    stated = index.join(starts, ["file", "block"]).withColumn("state", state)
    stated = stated.withColumn("after", F.when(F.col("state") == OUT, F.col("outside")).otherwise(F.col("inside")))
    inside = stated.where((F.col("state") == IN) | (F.col("after") == IN))
    # A record begins at the last line before that starts outside: in this block, or else in an earlier one.
    begins = F.when(F.col("state") == OUT, place)
    inside = inside.withColumn("begins", F.last(begins, ignorenulls=True).over(in_block))
    opened = (inside.groupBy("file", "block").agg(F.max("begins").alias("begins"))
              .select("file", "block", F.last("begins", ignorenulls=True).over(
                  in_file.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier_begin")))
    return (inside.select("file", "block", "line", "begins").join(opened, ["file", "block"])
            .select("file", "block", "line", F.coalesce("begins", "earlier_begin").alias("begins")))


def assembled(lines: DataFrame, members: DataFrame) -> DataFrame:
    """(file, begins, value): one row a record, lines put together by their place."""
    members = members.withColumn("member", F.lit(True))
    held = lines.join(members, ["file", "block", "line"], "left")
    single = held.where("member IS NULL").select("file", F.struct("block", "line").alias("begins"), "value")
    parts = F.array_sort(F.collect_list(F.struct("block", "line", "value")))
    several = (held.where("member").groupBy("file", "begins").agg(parts.alias("parts"))
               .select("file", "begins", F.array_join(F.col("parts.value"), "\n").alias("value")))
    return single.unionByName(several)


def read_records(spark: SparkSession, path: str | list[str], schema: T.StructType, options: dict) -> DataFrame:
    """The files' records parsed with ``schema`` (column names in file order, and a last column for misfits).

    A file whose header differs from the schema's names is an error.
    """
    lines = read_lines(spark, sorted(spark.read.text(path).inputFiles()))
    first = lines.groupBy("file").agg(F.min(F.struct("block", "line", "value")).alias("f"))
    first = first.select("file", F.struct("f.block", "f.line").alias("first"), F.endswith("f.value", F.lit("\r")).alias("crlf"))
    index = line_index(lines)
    if index.where(F.col("outside") == IN).limit(1).count():
        records = assembled(lines, multi_line_members(index))
    else:   # no line opens a cell and leaves it open: every line begins outside quotes and is a record
        records = lines.select("file", F.struct("block", "line").alias("begins"), "value")
    records = records.join(first, "file")
    header = F.col("begins") == F.col("first")
    text = F.when(F.col("crlf"), F.regexp_replace(F.regexp_replace("value", "\r$", ""), "\r\n", "\n")).otherwise(F.col("value"))
    text = F.when(header, F.ltrim(text, F.lit("\ufeff"))).otherwise(text)
    rows = records.select(header.alias("header"), text.alias("value")).where("value != ''")
    names = [f.name for f in schema.fields[:-1]]
    ddl = ", ".join(f"`{f.name.replace('`', '``')}` STRING" for f in schema.fields)
    # A generator parses each record once, whatever reads its cells.
    rows = rows.select(F.col("header").alias("__header"), F.inline(F.array(F.from_csv("value", F.lit(ddl), options))))
    same = F.lit(True)
    for n in names:
        same = same & F.col(f"`{n.replace('`', '``')}`").eqNullSafe(F.lit(n))
    differs = F.raise_error(F.lit("a file's header differs from the columns " + ", ".join(names))).cast("boolean")
    return rows.where(F.when(~F.col("__header"), F.lit(True)).when(same, F.lit(False)).otherwise(differs)).drop("__header")
