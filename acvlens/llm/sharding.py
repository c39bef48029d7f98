"""Sharding by minimax contiguous partition (DataFrame functions only).

Documents of equal text form one atomic group; groups are ordered by the
SHA-256 of the text.  The smallest shard capacity for which a greedy filling
needs at most ``shards`` shards is found by binary search, and the order is
cut where the greedy filling at that capacity closes a shard.

Scale.  Rows of equal id and text are counted first and are one row until the last step, where those
of over ``CHUNK`` copies are spread over tasks by chunk.  A group is one row after a map-side combined aggregate,
so a text that a third of the rows share costs one row here; its ids are numbered
per (text, salt), so no task holds a whole group.  Prefix sums run per bucket
of the digest (uniform) with an offset per bucket (at most ``BUCKETS`` rows).
The search needs only "the largest group end <= x".  The driver holds block
summaries (first end, last end, number of ends: at most ``BLOCKS`` rows at
first) which bound every greedy step from both sides, and asks Spark to split
just the blocks in which a step of the search still lies.  So the driver sees
a bounded summary, and the table of ends is scanned a handful of times.

Defined cases: null text counts as the empty text (size 1, CRC 0); a null
doc_id is kept; repeated rows get slots of their own; with an empty table the
result is empty; fewer groups than shards leave the last shards empty; a group larger
than the mean sets the capacity by itself.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import key_text, stash

BUCKETS = 4096
BLOCKS = 8192
SUB_BLOCKS = 512
SPLIT_AT_ONCE = 32
CHUNK = 1 << 16


def shard_documents(docs: DataFrame, shards: int = 8, salts: int = 64, chunk: int = CHUNK) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``."""
    d = key_text(docs)
    body = F.coalesce("text", F.lit(""))
    rows = d.select(
        "doc_id",
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.sha2(body, 256).alias("digest"),
        F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"))
    base = stash(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n")))
    units = stash(_ordered_units(base))
    cuts = minimax_cuts(units.where("opens").select("end"), shards)
    shard = sum([(F.col("end") > c).cast("int") for c in cuts], F.lit(0))
    units = units.withColumn("shard", shard)
    starts = {r.shard: r.at for r in units.groupBy("shard").agg(F.min("rows_before").alias("at")).collect()}
    first = F.lit(0).cast("long")
    for k, at in starts.items():
        first = F.when(F.col("shard") == k, F.lit(at)).otherwise(first)
    earlier = Window.partitionBy("digest", "salt").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    place = units.select("digest", "salt", "shard", (F.col("rows_before") - first).alias("before"))
    placed = (base.withColumn("inside", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(place, ["digest", "salt"])
              .withColumn("at", F.col("before") + F.col("inside")))
    slots = placed.where(F.col("n") <= chunk).withColumn("slot", F.explode(F.expr("sequence(at, at + n - 1)")))
    if not base.where(F.col("n") > chunk).isEmpty():
        cut = placed.where(F.col("n") > chunk).withColumn("part", F.explode(F.expr(f"sequence(at, at + n - 1, {chunk}L)")))
        # A number is named, so that chunks, few bytes before they are unfolded, are not put together again.
        tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        slots = slots.union(cut.repartition(tasks, "digest", "doc_id", "part").withColumn(
            "slot", F.explode(F.expr(f"sequence(part, least(part + {chunk}L, at + n) - 1)"))).drop("part"))
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))


def _ordered_units(base: DataFrame) -> DataFrame:
    """Per (digest, salt): rows before it, and the byte prefix at the end of its group."""
    bucket = F.conv(F.substring("digest", 1, 3), 16, 10).cast("int")
    units = (base.groupBy("digest", "salt")
             .agg(F.sum("n").alias("n"), F.sum(F.col("size") * F.col("n")).alias("bytes"))
             .withColumn("bucket", bucket))
    run = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (base.withColumn("bucket", bucket).groupBy("bucket")
               .agg(F.sum("n").alias("n"), F.sum(F.col("size") * F.col("n")).alias("bytes"))
               .select("bucket", F.coalesce(F.sum("n").over(run), F.lit(0)).alias("off_n"),
                       F.coalesce(F.sum("bytes").over(run), F.lit(0)).alias("off_bytes")))
    by = Window.partitionBy("bucket")
    peers = by.orderBy("digest").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = by.orderBy("digest", "salt")
    return (units.withColumn("end", F.sum("bytes").over(peers))
            .withColumn("rows_before", F.coalesce(
                F.sum("n").over(rows.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .withColumn("opens", ~F.lag("digest").over(rows).eqNullSafe(F.col("digest")))
            .join(offsets, "bucket")
            .select("digest", "salt", "n", "opens", (F.col("end") + F.col("off_bytes")).alias("end"),
                    (F.col("rows_before") + F.col("off_n")).alias("rows_before")))


class _Ends:
    """What the driver knows of the group ends: blocks (first, last, how many), ascending."""

    def __init__(self, blocks: list[tuple[int, int, int]]):
        self.blocks = sorted(blocks)
        self.firsts = [b[0] for b in self.blocks]

    def at_most(self, x: int) -> tuple[int, int, int | None]:
        """Bounds of the largest end <= x, and the block that leaves it open (if one does)."""
        i = bisect_right(self.firsts, x) - 1
        if i < 0:
            return 0, 0, None
        first, last, n = self.blocks[i]
        if x >= last:
            return last, last, None
        return (first, first, None) if n <= 2 else (first, min(x, last - 1), i)

    def fill(self, capacity: int, shards: int, side: int) -> list[int]:
        """Greedy ends of the shards with every step taken at its lower (0) or upper (1) bound."""
        ends = [0]
        for _ in range(shards):
            ends.append(self.at_most(ends[-1] + capacity)[side])
        return ends

    def least(self, shards: int, low: int, total: int, side: int) -> int:
        """Smallest capacity whose filling (at that bound) reaches the total."""
        high = total
        while low < high:
            mid = (low + high) // 2
            if self.fill(mid, shards, side)[-1] >= total:
                high = mid
            else:
                low = mid + 1
        return low

    def open_blocks(self, low: int, high: int, shards: int) -> list[int]:
        """Blocks in which a greedy step can still lie, those of the first steps first."""
        found: dict[int, None] = {}
        under, over = self.fill(low, shards, 0), self.fill(high, shards, 1)
        for capacity in (low, high, (low + high) // 2):
            for ends in (self.fill(capacity, shards, 0), self.fill(capacity, shards, 1)):
                for at in ends[:-1]:
                    i = self.at_most(at + capacity)[2]
                    if i is not None:
                        found[i] = None
                        break
        for k in range(shards):
            i = max(0, bisect_right(self.firsts, under[k] + low) - 1)
            while i < len(self.blocks) and self.firsts[i] <= over[k] + high and len(found) < SPLIT_AT_ONCE:
                if self.blocks[i][2] > 2:
                    found[i] = None
                i += 1
        return list(found)


def minimax_cuts(ends: DataFrame, shards: int) -> list[int]:
    """The inner cuts (``shards - 1`` byte positions) of the smallest feasible capacity.

    ``ends``: one row per group, the byte prefix at its end, in column ``end``.
    """
    total = ends.agg(F.max("end")).first()[0]
    if not total:
        return [0] * (shards - 1)
    known = _Ends(_summary(ends, [(1, total, 0)], BLOCKS))
    while True:
        low = known.least(shards, -(-total // shards), total, 1)
        high = known.least(shards, low, total, 0)
        under, over = known.fill(low, shards, 0), known.fill(high, shards, 1)
        if low == high and under == over:
            return under[1:-1]
        split = known.open_blocks(low, high, shards)
        parts = _summary(ends, [known.blocks[i] for i in split], SUB_BLOCKS)
        gone = set(split)
        known = _Ends([b for i, b in enumerate(known.blocks) if i not in gone] + parts)


def _summary(ends: DataFrame, spans: list[tuple[int, int, int]], parts: int) -> list[tuple[int, int, int]]:
    """(first, last, number) of the ends in each of ``parts`` equal parts of each span."""
    e, which = F.col("end"), F.lit(None).cast("long")
    within = F.lit(False)
    for k, (first, last, _) in enumerate(spans):
        inside = e.between(first, last)
        width = -(-(last - first + 1) // parts)
        which = F.when(inside, F.floor((e - first) / width).cast("long") + k * (parts + 1)).otherwise(which)
        within = within | inside
    rows = (ends.where(within).groupBy(which.alias("part"))
            .agg(F.min("end"), F.max("end"), F.count(F.lit(1))).collect())
    return [(r[1], r[2], r[3]) for r in rows]
