"""SparkSession construction shared by tests, bench and the entry points."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on: UTC wall clock (all `as_of` windows are UTC),
# AQE for runtime coalescing / skew splitting, Arrow for the grouped pandas
# functions, and no UI server.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.ansi.enabled": "true",
    # No Python call-site capture on every Column / DataFrame call: planning
    # a report of ~60 checks is thousands of such calls on the driver.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def get_session(
    master: str | None = None,
    app: str = "costlens",
    shuffle_partitions: int | None = None,
    extra: dict | None = None,
) -> SparkSession:
    """Build (or reuse) a session with the engine's settings.

    No master is set unless one is given, so that the submitted one holds; tests
    and the bench pass theirs.  A checkpoint folder is only configured when the
    cluster did not name one (``spark.checkpoint.dir``), as in tests.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a scratch one only if unset."""
    cur = spark.conf.get("spark.checkpoint.dir", None)
    if not cur:
        cur = spark.sparkContext.getCheckpointDir()
    if not cur:
        # A machine-local scratch folder is only valid when every executor is
        # in this process (local master: tests, single-node runs).  On a
        # cluster the checkpoint folder must be shared and is not guessed.
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        cur = tempfile.mkdtemp(prefix="costlens-ckpt-")
        atexit.register(shutil.rmtree, cur, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", cur)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(cur)
    return cur


def materialize(df):
    """Write `df` once to the session's shared checkpoint folder and cut its
    lineage (reliable `checkpoint()`, never `localCheckpoint`)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_table(df, stem: str):
    """`df` written as compressed Parquet under the session's checkpoint folder and read again.

    For what several jobs read, as `materialize` is, but columnar and smaller.
    The folder is removed when the session's file system is closed.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, stem)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def scratch_folder(spark: SparkSession, stem: str) -> str:
    """A path under the checkpoint folder that is no other's, removed when the session's file system is closed."""
    path = f"{ensure_checkpoint_dir(spark)}/{stem}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(folder.getParent())
    files.deleteOnExit(folder)
    return path


def folder_exists(spark: SparkSession, path: str) -> bool:
    """Whether the path is there, on whatever file system it names."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
