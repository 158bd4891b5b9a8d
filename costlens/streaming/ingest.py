"""Structured Streaming ingest (the reference's "constant stream" of daily exports).

* `billing_stream` — new AWS export files as they land under
  `base/BILLING_PERIOD=*/<run folder>/daily_costs-00001*.gz`; the run-folder
  pattern and the billing period come from the file path metadata.
* `metric_buckets_stream` — hourly (or other) metric buckets (MET-1) kept
  incrementally with a watermark, so late points within the allowed delay
  still land in their bucket and finished buckets are emitted once.
* `start_by_name` — the same files, columns by name: each batch groups its files by header.
* `start_ingest` — exactly-once append into a Parquet table (file sink +
  checkpoint in the cluster's shared checkpoint folder).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from costlens.functions import davg, dsum, finite
from costlens.session import ensure_checkpoint_dir
from costlens.operators.clean import FILE_ORDER
from costlens.sources.billing import AWS_FILE_PREFIX, AWS_PARTITION_PREFIX, AWS_RUN_FOLDER, read_by_name


def billing_stream(spark: SparkSession, base: str, schema, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming read of AWS export files; adds `BILLING_PERIOD` and `source_file`."""
    r = (
        spark.readStream.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)  # a header that differs from the schema fails, it isn't read by position
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", f"{AWS_FILE_PREFIX}*.gz")
    )
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", int(max_files_per_trigger))
    df = r.csv(base)
    parts = F.split(F.col("_metadata.file_path"), "/")
    return (
        df.withColumn("source_file", F.col("_metadata.file_path"))
        .withColumn("BILLING_PERIOD", F.regexp_extract(F.col("source_file"), f"{AWS_PARTITION_PREFIX}([^/]+)/", 1))
        .filter(F.element_at(parts, -2).rlike(AWS_RUN_FOLDER))
        .filter(F.col("BILLING_PERIOD") != "")
    )


def metric_buckets_stream(points: DataFrame, period: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """MET-1 as a stream: per metric, resource and `period` bucket — sum, avg, count.
    Buckets are emitted once the watermark (`delay` behind the newest point) passes them."""
    return (
        points.withWatermark("ts", delay)
        .groupBy("namespace", "metric", "resource_id", F.window("ts", period).alias("w"))
        .agg(dsum("value").alias("sum"), davg("value").alias("avg"), F.count(finite("value")).alias("cnt"))
        .select("namespace", "metric", "resource_id", F.col("w.start").alias("bucket_start"), "sum", "avg", "cnt")
    )


def start_ingest(stream: DataFrame, out_path: str, name: str, partition_by: str | None = None,
                 available_now: bool = False, processing_time: str = "1 minute") -> StreamingQuery:
    """Append a stream to a Parquet table with exactly-once file-sink semantics.
    The checkpoint lives under the session's shared `spark.checkpoint.dir`."""
    ckpt = f"{ensure_checkpoint_dir(stream.sparkSession).rstrip('/')}/streams/{name}"
    w = stream.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", ckpt)
    w = w.outputMode("append")
    if partition_by:
        w = w.partitionBy(partition_by)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time)
    return w.queryName(name).start()


def start_by_name(
    spark: SparkSession, base: str, schema: str, out_path: str, name: str, file_prefix: str = AWS_FILE_PREFIX
) -> StreamingQuery:
    """SRC-3 as a stream: export files as they arrive, whatever the order and choice of their columns.

    A batch is a list of new files (the stream reads their names alone).  Its
    files are read by name, like those of one export, and written under
    `batch=<number>`, which a repeated batch replaces.
    """
    files = (
        spark.readStream.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", f"{file_prefix}*.gz")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .load(base)
        .select("path")
    )

    def unite(batch: DataFrame, number: int) -> None:
        # the names of a trigger's files, which Spark's own file source lists on the driver as well
        paths = sorted(batch.where(F.element_at(F.split("path", "/"), -2).rlike(AWS_RUN_FOLDER)).toArrow().column("path").to_pylist())
        if paths:
            rows = read_by_name(batch.sparkSession, paths, f"{file_prefix}*.gz", schema).withColumn("source_file", F.col(f"{FILE_ORDER}.file_path"))
            period = F.regexp_extract("source_file", f"{AWS_PARTITION_PREFIX}([^/]+)/", 1)
            rows.drop(FILE_ORDER).withColumn("BILLING_PERIOD", period).write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    ckpt = f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}"
    return files.writeStream.foreachBatch(unite).option("checkpointLocation", ckpt).trigger(availableNow=True).queryName(name).start()
