"""Folders of the cluster's file systems, through Hadoop's FileSystem (any store that Spark reads)."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    """(file system, path) of the store that holds ``path``."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with scheme and absolute: one spelling for each folder or pattern."""
    fs, p = _path(spark, path)
    q = fs.makeQualified(p)
    uri = q.toUri()
    return f"{uri.getScheme()}://{uri.getAuthority() or ''}{uri.getPath()}"


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of what a folder holds; none if there is no such folder."""
    fs, p = _path(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _path(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small new file; one that exists already is an error."""
    fs, p = _path(spark, path)
    stream = fs.create(p, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def replace_parts(spark: SparkSession, staged: str, table: str, prefix: str) -> int:
    """Moves the part files in ``staged`` into ``table`` as ``prefix``-00000 and so on.

    Part files of that prefix which an interrupted attempt left there go first, so doing
    it again gives the same table.  Only names change; no row passes the driver.
    """
    fs, target = _path(spark, table)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs.mkdirs(target)
    for name in names(spark, table):
        if name.startswith(f"{prefix}-"):
            fs.delete(path(target, name), False)
    parts = [n for n in names(spark, staged) if n.startswith("part-")]
    for k, name in enumerate(parts):
        ending = name[name.index("."):]
        if not fs.rename(path(staged, name), path(target, f"{prefix}-{k:05d}{ending}")):
            raise OSError(f"cannot move {staged}/{name} into {table}")
    return len(parts)
