"""Hand fixtures for edge cases (FIXTURES.md §3)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from costlens.functions import cpu_milli, mem_mib, to_number
from costlens.operators import anomaly as AN
from costlens.operators import clean as C
from costlens.operators import pivots as P
from costlens.operators.checks import aws as A
from costlens.operators.checks import gcp as G

AWS_SCHEMA = (
    "identity_time_interval string, line_item_product_code string, product_region_code string, "
    "product_servicecode string, product_location string, line_item_blended_cost double, "
    "discount_bundled_discount double, discount_total_discount double, ord int"
)


def _aws(spark, rows):
    return spark.createDataFrame(rows, AWS_SCHEMA)


def test_first_non_null_per_column_and_zero_cost_removed(spark):
    iv = "2024-01-01T00:00:00Z/2024-01-02T00:00:00Z"
    rows = [
        (iv, "EC2", "eu", "AmazonEC2", None, None, 0.0, 0.0, 1),
        (iv, "EC2", "eu", "AmazonEC2", "B", 2.0, 0.0, 0.0, 2),
        (iv, "EC2", "eu", "AmazonEC2", "C", 3.0, 0.0, 0.0, 3),
        (iv, "S3", "eu", "AmazonS3", None, 5.0, 1.0, 1.0, 4),
        (iv, "S3", "eu", "AmazonS3", "X", 9.0, 0.0, 0.0, 5),
    ]
    out = {r["product_code"]: r for r in C.clean_aws(_aws(spark, rows), order=["ord"]).collect()}
    # EC2: cost null -> 0 (filled), first row wins -> cost 0 -> group removed
    assert "EC2" not in out
    # S3: first non-null location is X (row 5), cost from row 4 = 5 - (1 + 1)
    assert out["S3"]["location"] == "X" and out["S3"]["cost"] == 3.0
    assert out["S3"]["date"] == dt.date(2024, 1, 1)


def test_null_key_dropped(spark):
    iv = "2024-01-01T00:00:00Z/P1D"
    rows = [(iv, "EC2", None, "AmazonEC2", "A", 5.0, 0.0, 0.0, 1), (iv, "EC2", "us", "AmazonEC2", "A", 4.0, 0.0, 0.0, 2)]
    out = C.clean_aws(_aws(spark, rows), order=["ord"]).collect()
    assert [r["region"] for r in out] == ["us"]


def test_pivot_all_null_cell_is_zero_absent_cell_null(spark):
    df = spark.createDataFrame(
        [(dt.date(2024, 1, 1), "A", None), (dt.date(2024, 1, 2), "B", 2.0)], "date date, product_code string, cost double"
    ).withColumn("provider", F.lit("aws"))
    out = {r["date"]: r for r in P.cost_by_date_service(df, ["A", "B"]).collect()}
    assert out[dt.date(2024, 1, 1)]["A"] == 0.0 and out[dt.date(2024, 1, 1)]["B"] is None
    assert out[dt.date(2024, 1, 2)]["B"] == 2.0


@pytest.mark.parametrize(
    "text,expected", [("1,234.5", None), (" 12 ", 12.0), ("1e3", 1000.0), ("", None), ("1d", None), ("-.5", -0.5)]
)
def test_tolerant_number(spark, text, expected):
    got = spark.createDataFrame([(text,)], "t string").select(to_number("t").alias("v")).first()["v"]
    assert got == expected


def test_gcp_null_cost_row_kept(spark):
    raw = spark.createDataFrame(
        [("2024-01-01", "Compute Engine", "10", "n/a", "1", 0.0, 0.0)],
        "`Date` string, `Service description` string, `Cost (€)` string, `Discounts (€)` string, "
        "`Promotions and others (€)` string, `Subtotal (€)` double, `Unrounded subtotal (€)` double",
    )
    out = C.clean_gcp(raw).collect()
    assert len(out) == 1 and out[0]["cost"] is None


def _scored(spark, scores):
    df = spark.createDataFrame([("s", float(x)) for x in scores], "service string, score double")
    return df.withColumn("anomaly", AN.anomaly_label("score"))


def test_threshold_start_at_or_above_zero_is_returned(spark):
    out = AN.calibrate_threshold(_scored(spark, [-0.2, -0.1, 0.1, 0.2, 0.3]), "service", {"s": 0.15}).first()
    assert out["threshold"] == 0.15 and out["accuracy"] == 150.0


def test_threshold_start_below_zero_runs_all_steps(spark):
    out = AN.calibrate_threshold(_scored(spark, [-0.2, -0.1, 0.1, 0.2, 0.3]), "service", {"s": -0.3}).first()
    t = -0.3
    for _ in range(100):
        t -= 0.0001
    assert out["threshold"] == t and out["accuracy"] == 0.0


def test_threshold_without_labels_has_null_ratio(spark):
    out = AN.calibrate_threshold(_scored(spark, [0.1, 0.1, 0.1]), "service", {"s": 0.5}).first()
    assert out["threshold"] == 0.5 and out["accuracy"] is None


def test_ages_at_the_limit_are_not_findings(spark):
    as_of = "2024-07-01 00:00:00"
    inst = spark.createDataFrame(
        [(1, dt.datetime(2024, 7, 1) - dt.timedelta(days=180)), (2, dt.datetime(2024, 7, 1) - dt.timedelta(days=181))],
        "instance_id long, launch_time timestamp_ntz",
    )
    assert [r["resource_id"] for r in A.old_instances(inst, as_of, 180).collect()] == ["2"]
    objs = spark.createDataFrame(
        [("b", "k1", 1, 1, True, "STANDARD", dt.datetime(2024, 7, 1) - dt.timedelta(days=30, hours=23)),
         ("b", "k2", 2, 1, True, None, dt.datetime(2024, 7, 1) - dt.timedelta(days=31, hours=1))],
        "bucket string, key string, version_id long, size long, is_latest boolean, storage_class string, "
        "last_modified timestamp_ntz",
    )
    assert [r["resource_id"] for r in A.stale_objects(objs, as_of, 30).collect()] == ["b/k2/2"]


def test_instance_without_datapoints(spark):
    as_of = "2024-01-31 00:00:00"
    pts = spark.createDataFrame(
        [("fx", "cpu", 1, dt.datetime(2024, 1, 30, 12), 5.0), ("fx", "mem", 1, dt.datetime(2024, 1, 30, 12), 5.0)],
        "namespace string, metric string, resource_id long, ts timestamp_ntz, value double",
    )
    members = spark.createDataFrame([("c", "ng", "asg", 1), ("c", "ng", "asg", 2)],
                                    "cluster string, nodegroup string, asg string, instance_id long")
    assert [r["resource_id"] for r in A.low_cpu(pts, as_of, 20, cpu_metric="cpu").collect()] == ["1"]
    assert [r["resource_id"] for r in A.unmonitored(members, pts, as_of, "cpu", "mem").collect()] == ["2"]
    inst = spark.createDataFrame([(1, True), (2, False)], "instance_id long, preemptible boolean")
    got = sorted(r["resource_id"] for r in G.underutilized(inst, pts, as_of, 0.1, cpu_metric="cpu").collect())
    assert got == ["2"]  # no data counts as 0 < 0.1


def test_quantities(spark):
    df = spark.createDataFrame([("500m", "128Mi"), ("2", "1Gi"), ("250000000n", "16384Ki")], "c string, m string")
    rows = df.select(cpu_milli("c").alias("c"), mem_mib("m").alias("m")).collect()
    assert [r["c"] for r in rows] == [500.0, 2000.0, 250.0]
    assert [r["m"] for r in rows] == [128.0, 1024.0, 16.0]


def test_longest_prefix_pool(spark):
    nodes = spark.createDataFrame([("pool-a-big-1",), ("pool-b-1",)], "node_name string")
    pools = spark.createDataFrame([("pool-", "e2-small"), ("pool-a-", "n1-standard-64"), ("pool-a-big", "e2-small")],
                                  "pool string, machine_type string")
    got = {r["node_name"]: r["pool"] for r in G.node_pool(nodes, pools).collect()}
    assert got == {"pool-a-big-1": "pool-a-big", "pool-b-1": "pool-"}


def test_foreign_targets_and_missing_logs(spark):
    members = spark.createDataFrame([("c1", 1), ("c2", 2)], "cluster string, instance_id long")
    targets = spark.createDataFrame([("lb", 1, "healthy"), ("lb", 3, "unhealthy"), ("lb", 2, "draining")],
                                    "lb string, target_id long, state string")
    assert [r["resource_id"] for r in A.foreign_targets(members, targets).collect()] == ["3"]
    assert [r["resource_id"] for r in A.unhealthy_targets(members, targets).collect()] == ["2"]
    logs = spark.createDataFrame([("/aws/eks/c1/cluster",), ("/aws/eks/c2/other",)], "name string")
    assert [r["resource_id"] for r in A.missing_cluster_logs(members, logs).collect()] == ["c2"]
