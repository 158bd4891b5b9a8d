"""Streaming ingest of export files and incremental metric buckets."""

import datetime as dt
import gzip
import os
import tempfile

from costlens.streaming.ingest import billing_stream, metric_buckets_stream, start_ingest

RUN = "2024-05-01T10_00_00.000Z-0123abcd-0123-4567-89ab-0123456789ab"


def _gz(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with gzip.open(path, "wt") as f:
        f.write(text)


def test_billing_stream_appends_new_files_once(spark):
    base = tempfile.mkdtemp(prefix="costlens-stream-in-")
    out = tempfile.mkdtemp(prefix="costlens-stream-out-")
    schema = "line_item_product_code string, line_item_blended_cost double"
    _gz(f"{base}/BILLING_PERIOD=2024-05/{RUN}/daily_costs-00001.csv.gz", "line_item_product_code,line_item_blended_cost\nA,1\n")
    _gz(f"{base}/BILLING_PERIOD=2024-05/junk/daily_costs-00001.csv.gz", "line_item_product_code,line_item_blended_cost\nX,9\n")
    name = "billing_" + os.path.basename(out).replace("-", "_")
    q = start_ingest(billing_stream(spark, base, schema), out, name, "BILLING_PERIOD", available_now=True)
    q.awaitTermination(120)
    _gz(f"{base}/BILLING_PERIOD=2024-06/{RUN}/daily_costs-00001.csv.gz", "line_item_product_code,line_item_blended_cost\nB,2\n")
    q = start_ingest(billing_stream(spark, base, schema), out, name, "BILLING_PERIOD", available_now=True)
    q.awaitTermination(120)
    got = sorted((r["BILLING_PERIOD"], r["line_item_product_code"]) for r in spark.read.parquet(out).collect())
    assert got == [("2024-05", "A"), ("2024-06", "B")]


def test_metric_buckets_stream_matches_batch(spark):
    src = tempfile.mkdtemp(prefix="costlens-pts-")
    rows = [("fx", "cpu", 1, dt.datetime(2024, 1, 1, h, m), float(h + m)) for h in range(5) for m in (0, 30)]
    spark.createDataFrame(rows, "namespace string, metric string, resource_id long, ts timestamp, value double") \
        .write.mode("overwrite").parquet(src)
    schema = spark.read.parquet(src).schema
    stream = spark.readStream.schema(schema).parquet(src)
    q = (metric_buckets_stream(stream, "1 hour", "0 seconds").writeStream.format("memory")
         .queryName("buckets_test").outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = {r["bucket_start"].hour: r["sum"] for r in spark.sql("select * from buckets_test").collect()}
    # the last bucket stays open until a later point moves the watermark past it
    assert {h: float(2 * h + 30) for h in range(4)}.items() <= got.items()
