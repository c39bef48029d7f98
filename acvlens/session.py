"""SparkSession construction and shared-folder settings.

On a cluster the session is built by the platform; ``get_session`` only
fills in what is unset, so a cluster's own settings (shuffle partitions,
checkpoint folder, AQE thresholds) always win.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Defaults applied only when the key is not already set on the session.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "acvlens") -> SparkSession:
    """Return the active session, or build a local one for tests and benches."""
    active = SparkSession.getActiveSession()
    if active is not None:
        _apply_defaults(active)
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("ACVLENS_DRIVER_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
        # materialize() writes checkpoints; remove them once unreferenced.
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        # Python call-site capture for error messages costs ~4 extra JVM round
        # trips per Column built; plans here build hundreds of Columns.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    _apply_defaults(spark)
    return spark


def _apply_defaults(spark: SparkSession) -> None:
    for k, v in _DEFAULTS.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and streaming checkpoints.

    Taken from the context, else from ``spark.checkpoint.dir``.  A scratch
    folder is created only for a local master that names none (tests); on a
    cluster a machine-local folder would not be shared, so that is an error.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder on shared storage")
        d = tempfile.mkdtemp(prefix="acvlens-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def materialize(df):
    """Write ``df`` once as Parquet to the shared checkpoint folder and read it back.

    For an intermediate that several branches of a plan read (Catalyst
    prunes each branch differently, so their shuffles are not reused): the
    branches then read the written columns they need instead of recomputing
    them, and a lost executor costs a re-read, not a recomputation.  The folder is
    scratch space: what is written there may be removed once the results are
    used.  Under Spark Connect (no client-side context) the server's
    ``spark.checkpoint.dir`` applies through ``checkpoint()``.
    """
    from pyspark.sql.utils import is_remote
    if is_remote():
        return df.checkpoint(eager=True)
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/intermediate-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
