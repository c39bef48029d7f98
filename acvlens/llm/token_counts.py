"""Token counts by scanning flat token files for separators.

A flat token file is a stream of fixed-width little-endian token numbers in
which an end-of-document number closes each document; there is no index.  The
scan reads blocks of a file independently: a vectorised search finds the
separators of a block, which give the documents that lie inside it and, at its
ends, the parts of documents that cross into other blocks.  A prefix scan over
the blocks' summaries (tokens, separators, last separator) stitches these:
the document that a block's first separator closes began after the last
separator of all blocks before it.

Scale.  Searching is map-only.  The prefix scan works on one row per block and
in two levels (blocks within a group of ``GROUP`` blocks, groups within a
file), so even a file that holds a third of all tokens is spread over many
tasks; only the groups of one file (a block / GROUP of its size) meet in one.

``encode_documents`` makes such files from texts with a public byte-level BPE
vocabulary: one file per partition, blocks of ``BLOCK_TOKENS`` tokens cut
without regard to documents.  A document's id goes with the block that holds its
separator, in the order of the separators; the scan does not look at it.

Defined cases: null or empty text is a document of no tokens; a null doc_id is
kept and repeated rows count once each; tokens after the last separator of a file
are a document with ``closed`` false; an empty block or file has none; a token
equal to the separator inside a text cannot occur (the vocabulary lacks it).
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import tiktoken
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import key_text, slices, stash

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed values of that vocabulary: how texts are pre-split, and the free number used as separator.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SEPARATOR = 50256
BLOCK_TOKENS = 1 << 18
GROUP = 1024
SPAN = 1 << 16        # blocks of a file listed in one array
NEIGHBOURS = 16       # adjacent blocks that one task reads
TASK_BYTES = 1 << 28  # read by a task, about
BLOCKS = "file string, block long, payload binary, doc_ids array<long>"

_encodings: dict[int, tiktoken.Encoding] = {}


def _encoding(vocabulary: bytes) -> tiktoken.Encoding:
    """The tokenizer of the vocabulary file's bytes, built once per worker."""
    key = hash(vocabulary)
    if key not in _encodings:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        _encodings[key] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[key]


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY, separator: int = SEPARATOR,
                     block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Flat token files (file, block, payload: 2-byte numbers, doc_ids) of all rows of ``docs``."""
    with open(vocabulary, "rb") as f:
        ranks = f.read()

    def block(name: str, number: int, tokens: np.ndarray, ids: list[int | None]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([name]), pa.array([number], pa.int64()), pa.array([tokens.astype("<u2").tobytes()], pa.binary()),
             pa.array([ids], pa.list_(pa.int64()))], names=["file", "block", "payload", "doc_ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, name = _encoding(ranks), f"part-{TaskContext.get().partitionId():06d}"
        number, held, n, closed = 0, [], 0, []   # closed: (position of the separator in what is held, doc_id)
        for batch in slices(batches, "text"):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                tokens = encoding.encode_to_numpy(text or "", disallowed_special=())
                held += [tokens, np.array([separator], np.uint32)]
                n += len(tokens) + 1
                closed.append((n - 1, doc_id))
                if n >= block_tokens:
                    stream = np.concatenate(held)
                    cut = n - n % block_tokens
                    for at in range(0, cut, block_tokens):
                        inside = [i for p, i in closed if at <= p < at + block_tokens]
                        yield block(name, number, stream[at:at + block_tokens], inside)
                        number += 1
                    closed = [(p - cut, i) for p, i in closed if p >= cut]
                    held, n = [stream[cut:]], n - cut
        if n:
            yield block(name, number, np.concatenate(held), [i for _, i in closed])

    return key_text(docs).mapInArrow(run, BLOCKS)


def read_token_files(spark: SparkSession, path: str, block_bytes: int = 2 * BLOCK_TOKENS) -> DataFrame:
    """Blocks of flat token files in a folder, of any size: each byte range is read by the task that has its row.

    The files are listed with their lengths (their content is not read) and cut into ranges of ``block_bytes``
    (a multiple of the tokens' width), which are spread over tasks by hash.  Ranges are opened through ``pyarrow.fs``
    (local, HDFS, S3 and Google storage addresses).  A file must not change between listing and reading: a range that
    ends early is an error.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = opened = None
        for batch in batches:
            for at in batch.to_pylist():
                if at["path"] != name:
                    if opened:
                        opened.close()
                    address = quote(re.sub("^s3[an]:", "s3:", at["path"]), safe="/:@")   # Spark's paths are not quoted
                    files, place = pafs.FileSystem.from_uri(address)
                    name, opened = at["path"], files.open_input_file(place)
                start = at["block"] * block_bytes
                payload = opened.read_at(min(block_bytes, at["length"] - start), start)
                if len(payload) != min(block_bytes, at["length"] - start):
                    raise EOFError(f"{name}: {len(payload)} bytes at {start}, the file was listed with {at['length']}")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([at["block"]], pa.int64()), pa.array([payload], pa.binary()),
                     pa.nulls(1, pa.list_(pa.int64()))], names=["file", "block", "payload", "doc_ids"])
        if opened:
            opened.close()

    files = spark.read.format("binaryFile").load(path).select("path", "length")
    spans = files.where("length > 0").selectExpr(
        "path", "length", f"explode(sequence(0L, (length - 1) div {block_bytes}, {SPAN}L)) AS span")
    ranges = spans.selectExpr(
        "path", "length", f"explode(sequence(span, least(span + {SPAN} - 1, (length - 1) div {block_bytes}))) AS block")
    # The number is named, so that ranges, a few bytes each here, are not put together again.
    total = files.agg(F.sum("length")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))
    spread = (ranges.repartition(tasks, F.col("path"), F.floor(F.col("block") / NEIGHBOURS))
              .sortWithinPartitions("path", "block"))
    return spread.mapInArrow(run, BLOCKS)


def scan_blocks(blocks: DataFrame, separator: int = SEPARATOR, width: int = 2) -> DataFrame:
    """Per block: tokens, separators, first and last separator, and the lengths between separators."""
    kind = np.dtype(f"<u{width}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, first, last, between = [], [], [], []
            for payload in batch.column("payload").to_pylist():
                tokens = np.frombuffer(payload or b"", kind)
                at = np.flatnonzero(tokens == separator)
                n.append(len(tokens))
                first.append(int(at[0]) if len(at) else None)
                last.append(int(at[-1]) if len(at) else None)
                between.append((np.diff(at) - 1).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("block"), batch.column("doc_ids"), pa.array(n, pa.int64()),
                 pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(between, pa.list_(pa.int64()))],
                names=["file", "block", "doc_ids", "n", "first", "last", "between"])

    kept = blocks.select("file", "block", "payload", "doc_ids")
    return kept.mapInArrow(run, "file string, block long, doc_ids array<long>, n long, first long, last long, "
                                "between array<long>")


def stitch(scanned: DataFrame) -> DataFrame:
    """The scanned blocks with the tokens (``carry``) and separators (``before``) that precede them."""
    s = (scanned.withColumn("super", F.floor(F.col("block") / GROUP))
         .withColumn("seps", F.when(F.col("last").isNull(), 0).otherwise(F.size("between") + 1)))
    inside = Window.partitionBy("file", "super").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    above = Window.partitionBy("file").orderBy("super").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    groups = (s.groupBy("file", "super").agg(F.sum("n").alias("gn"), F.sum("seps").alias("gs"))
              .select("file", "super", F.coalesce(F.sum("gn").over(above), zero).alias("at"),
                      F.coalesce(F.sum("gs").over(above), zero).alias("seps_at")))
    s = (s.withColumn("pre_n", F.coalesce(F.sum("n").over(inside), zero))
         .withColumn("pre_s", F.coalesce(F.sum("seps").over(inside), zero))
         .join(groups, ["file", "super"])
         .withColumn("start", F.col("at") + F.col("pre_n"))
         .withColumn("before", F.col("seps_at") + F.col("pre_s"))
         .withColumn("end_of_last", F.col("start") + F.col("last") + 1))
    ends = (s.groupBy("file", "super").agg(F.max("end_of_last").alias("g"))
            .select("file", "super", F.max("g").over(above).alias("earlier")))
    return (s.withColumn("nearer", F.max("end_of_last").over(inside)).join(ends, ["file", "super"])
            .withColumn("carry", F.col("start") - F.greatest(F.coalesce("nearer", zero), F.coalesce("earlier", zero))))


def token_counts(blocks: DataFrame, separator: int = SEPARATOR, width: int = 2) -> DataFrame:
    """(file, ordinal, doc_id, n_tokens, closed) of every document in the token files."""
    s = stash(stitch(stash(scan_blocks(blocks, separator, width))))
    lengths = F.concat(F.array(F.col("carry") + F.col("first")), "between")
    closed = (s.where("last IS NOT NULL")
              .select("file", "before", "doc_ids", F.posexplode(lengths).alias("k", "n_tokens"))
              .select("file", (F.col("before") + F.col("k")).alias("ordinal"),
                      F.get("doc_ids", F.col("k")).alias("doc_id"), "n_tokens", F.lit(True).alias("closed")))
    tails = (s.groupBy("file").agg(F.max(F.col("start") + F.col("n")).alias("end"), F.sum("seps").alias("ordinal"),
                                   F.coalesce(F.max("end_of_last"), F.lit(0)).alias("last_end"))
             .where("end > last_end")
             .select("file", "ordinal", F.lit(None).cast("long").alias("doc_id"),
                     (F.col("end") - F.col("last_end")).alias("n_tokens"), F.lit(False).alias("closed")))
    return closed.union(tails)


def document_token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of every row of ``docs``, counted in the token files made of it."""
    files = stash(encode_documents(docs, vocabulary), compression="zstd")
    return token_counts(files).select("doc_id", "n_tokens")
