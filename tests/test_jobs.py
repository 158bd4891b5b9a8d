"""The batch job and the alert request end to end on the smallest test data."""

import tempfile

from pyspark.sql import functions as F

from costlens.operators.checks import aws as A
from costlens.plans.jobs import alert_job, cost_job
from costlens.plans.q_billing import AWS_ORDER
from costlens.sources.fixtures import Tables, service_map
from tests.conftest import SMOKE


def test_cost_then_alert_job(spark):
    t = Tables(spark, SMOKE)
    out = tempfile.mkdtemp(prefix="costlens-job-")
    res = cost_job(spark, out, t.cost_aws_raw, t.cost_gcp_raw, aws_order=AWS_ORDER,
                   default_start=0.0, run_ts="2024-01-01 00:00:00", forecaster="ar1")
    n_services = res["clean"].select("service").distinct().count()
    assert res["forecasts"].count() == 7 * n_services
    th = res["thresholds"]
    assert th.count() == n_services and th.filter(F.col("threshold") != 0.0).count() == 0
    findings = [A.old_snapshots(t.snapshots, "2001-08-02", 180), A.unused_addresses(t.addresses)]
    report = alert_job(spark, res["forecasts"], th, findings, service_map(spark))
    rows = report.collect()
    # thresholds are 0.0 (start >= 0 is returned), every forecast is above -> every mapped service alerts
    assert rows and {r["service"] for r in rows} <= {"AmazonEC2", "AmazonVPC"}
    assert all(r["prompt"] for r in rows)


def test_default_cost_job_keeps_every_service(spark):
    """Reference starts and the default forecaster; billing names map to the names that have a start."""
    aws = spark.createDataFrame(
        [(f"2024-01-{d:02d}T00:00:00Z/x", code, "eu", name, "loc", 1.0 + d / 10, 0.0, 0.0)
         for d in range(1, 21) for code, name in (("AmazonEC2", "AmazonEC2"), ("kms", "awskms"), ("new", "AmazonNew"))],
        "identity_time_interval string, line_item_product_code string, product_region_code string, "
        "product_servicecode string, product_location string, line_item_blended_cost double, "
        "discount_bundled_discount double, discount_total_discount double",
    )
    gcp = spark.createDataFrame(
        [(f"2024-01-{d:02d}", name, str(c + d), "0", "0") for d in range(1, 21)
         for name, c in (("Compute Engine", 1), ("Kubernetes Engine", 2), ("Networking", 3)) for c in (c, c + 100)],
        ["Date", "Service description", "Cost (€)", "Discounts (€)", "Promotions and others (€)"],
    )
    res = cost_job(spark, tempfile.mkdtemp(prefix="costlens-job-"), aws, gcp, run_ts="2024-01-01 00:00:00")
    services = {"AmazonEC2", "AWSKMS", "AmazonNew", "ComputeEngine", "KubernetesEngine", "Networking"}
    th = {r["service"]: r["threshold"] for r in res["thresholds"].collect()}
    assert set(th) == services and th["AmazonNew"] is None and th["ComputeEngine"] is not None
    assert {r["service"] for r in res["forecasts"].select("service").distinct().collect()} == services
    from costlens.operators import alerts as AL

    alerts = {r["service"]: r for r in AL.overspend(res["forecasts"], res["thresholds"]).collect()}
    assert set(alerts) == services and alerts["AmazonNew"]["overspending"] is False


def test_row_ids_are_unique(spark):
    from costlens.plans.q_models import _cost_rows

    rows = _cost_rows(Tables(spark, SMOKE))
    assert rows.select("row_id").distinct().count() == rows.count()


def test_alert_job_builds_only_the_alerting_services_checks(spark):
    t = Tables(spark, SMOKE)
    fc = spark.createDataFrame([("AmazonEC2", None, 1, 5.0), ("AmazonVPC", None, 1, 1.0)],
                               "service string, date date, step int, forecast double")
    th = spark.createDataFrame([("AmazonEC2", 2.0, 1), ("AmazonVPC", 2.0, 1)], "service string, threshold double, run_ts int")
    called = []

    def build(name, make):
        return lambda: (called.append(name), make())[1]

    checks = {
        "AmazonEC2": build("AmazonEC2", lambda: A.old_snapshots(t.snapshots, "2001-08-02", 180)),
        "AmazonVPC": build("AmazonVPC", lambda: A.unused_addresses(t.addresses)),
    }
    rows = alert_job(spark, fc, th, checks).collect()
    assert called == ["AmazonEC2"] and {r["service"] for r in rows} == {"AmazonEC2"}
    quiet = th.withColumn("threshold", F.lit(9.0))
    assert alert_job(spark, fc, quiet, checks).count() == 0 and called == ["AmazonEC2"]
