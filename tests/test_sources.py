"""Reader / writer round trips in a scratch folder (SRC-1..7, SNK-1..3)."""

import datetime as dt
import gzip
import os
import tempfile



from costlens.sources import billing as B

RUN_OK = "2024-05-01T10_00_00.000Z-0123abcd-0123-4567-89ab-0123456789ab"
RUN_BAD = "not-a-run-folder"


def _write_gz(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with gzip.open(path, "wt") as f:
        f.write(text)


def test_aws_layout_and_union(spark):
    base = tempfile.mkdtemp(prefix="costlens-aws-")
    csv = "line_item_product_code,line_item_blended_cost\nAmazonEC2,1.5\n"
    _write_gz(f"{base}/BILLING_PERIOD=2024-05/{RUN_OK}/daily_costs-00001.csv.gz", csv)
    _write_gz(f"{base}/BILLING_PERIOD=2024-06/{RUN_OK}/daily_costs-00001.csv.gz",
              "line_item_product_code,line_item_blended_cost,extra\nAmazonS3,2.5,x\n")
    _write_gz(f"{base}/BILLING_PERIOD=2024-05/{RUN_BAD}/daily_costs-00001.csv.gz", csv)
    _write_gz(f"{base}/BILLING_PERIOD=2024-05/{RUN_OK}/other-00002.csv.gz", csv)
    df = B.read_aws_billing(spark, base)
    rows = sorted((r["BILLING_PERIOD"], r["line_item_product_code"]) for r in df.collect())
    assert rows == [("2024-05", "AmazonEC2"), ("2024-06", "AmazonS3")]
    a = spark.createDataFrame([("x", 1.0)], "a string, b double")
    b = spark.createDataFrame([("y", "z")], "a string, c string")
    u = B.union_reports([a, b]).orderBy("a").collect()
    assert u[0]["c"] is None and u[1]["b"] is None


def test_gcp_prefix_and_report(spark):
    d = tempfile.mkdtemp(prefix="costlens-gcp-")
    for name in ("Report_A.csv", "Report_B.csv", "Other.csv"):
        with open(f"{d}/{name}", "w") as f:
            f.write("Date,Cost\n2024-01-01,1\n")
    assert B.read_gcp_billing(spark, d, "Report_").count() == 2
    assert B.read_report(spark, f"{d}/Other.csv").count() == 1


def test_clean_forecast_threshold_sinks(spark):
    out = tempfile.mkdtemp(prefix="costlens-out-")
    clean = spark.createDataFrame(
        [("aws", dt.date(2024, 1, 2), 2.0), ("aws", dt.date(2024, 1, 1), 1.0), ("gcp", dt.date(2024, 1, 1), 3.0)],
        "provider string, date date, cost double",
    )
    B.write_clean(clean, f"{out}/clean")
    back = spark.read.parquet(f"{out}/clean")
    assert back.count() == 3 and set(back.columns) == {"provider", "date", "cost"}
    fc = spark.createDataFrame([("S1", dt.date(2024, 1, 3), 1, 5.0), ("S2", dt.date(2024, 1, 3), 1, 6.0)],
                               "service string, date date, step int, forecast double")
    B.write_forecasts(fc, f"{out}/forecasts")
    assert B.read_forecasts(spark, f"{out}/forecasts").count() == 2
    th = spark.createDataFrame([("S1", 0.3, 100.0)], "service string, threshold double, accuracy double")
    B.append_thresholds(th, f"{out}/thresholds", "2024-01-01 00:00:00")
    th2 = spark.createDataFrame([("S1", 0.2, 100.0), ("S2", 1.5, 100.0)], "service string, threshold double, accuracy double")
    B.append_thresholds(th2, f"{out}/thresholds", "2024-02-01 00:00:00")
    hist = spark.read.parquet(f"{out}/thresholds")
    latest = {r["service"]: r["threshold"] for r in B.latest_thresholds(hist).collect()}
    assert latest == {"S1": 0.2, "S2": 1.5}
    wide = B.thresholds_wide(B.latest_thresholds(hist), ["S1", "S2", "S3"]).first()
    assert wide["S1"] == 0.2 and wide["S2"] == 1.5 and wide["S3"] is None

