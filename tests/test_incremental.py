"""Header survey, incremental cleaning, repeated runs, the by-name stream, and odd values."""

import gzip
import math
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from costlens.functions import davg, dsum
from costlens.operators import clean as C
from costlens.operators import metrics as M
from costlens.operators import topology as TP
from costlens.sources import billing as B
from costlens.streaming import ingest as I

RUN = "2024-05-01T10_00_00.000Z-0123abcd-0123-4567-89ab-0123456789ab"
LATER = "2024-06-01T10_00_00.000Z-0123abcd-0123-4567-89ab-0123456789ab"
NAMES = ["identity_time_interval", "line_item_product_code", "product_region_code", "product_servicecode", "product_location",
         "line_item_blended_cost", "discount_bundled_discount", "discount_total_discount"]


def export(base, period, run, lines, header=None, name="daily_costs-00001.csv.gz"):
    header = header or NAMES
    folder = f"{base}/BILLING_PERIOD={period}/{run}"
    os.makedirs(folder, exist_ok=True)
    with gzip.open(f"{folder}/{name}", "wt") as f:
        f.write(",".join(header) + "\n")
        for line in lines:
            f.write(",".join(str(line.get(c, "")) for c in header) + "\n")


def line(day, cost, region="eu", code="EC2"):
    return {"identity_time_interval": f"{day}T00:00:00Z/P1D", "line_item_product_code": code, "product_region_code": region,
            "product_servicecode": code, "product_location": "x", "line_item_blended_cost": cost,
            "discount_bundled_discount": 0.0, "discount_total_discount": 0.0}


def jobs_of(spark, fn):
    name = f"count-{id(fn)}"
    spark.sparkContext.setJobGroup(name, name)
    fn()
    spark.sparkContext.setJobGroup("", "")
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_survey_takes_as_many_jobs_for_many_files(spark):
    found = []
    for files in (4, 48):
        base = tempfile.mkdtemp(prefix="costlens-survey-")
        for i in range(files):
            names = NAMES if i % 2 else list(reversed(NAMES))
            export(base, f"2024-{i % 12 + 1:02}", RUN, [line("2024-01-01", i)], names, f"daily_costs-00001-{i}.csv.gz")
        assert sorted({r.header for r in B.headers(spark, f"{base}/*/*").collect()}) == sorted([",".join(NAMES), ",".join(reversed(NAMES))])
        found.append(jobs_of(spark, lambda b=base: B.read_aws_billing(spark, b)))
        got = B.read_aws_billing(spark, base)
        assert got.agg(F.sum("line_item_blended_cost")).first()[0] == files * (files - 1) / 2
        assert {r[0] for r in got.select("line_item_product_code").distinct().collect()} == {"EC2"}
    assert found[0] == found[1]


def test_survey_stops_after_the_first_line(spark):
    base = tempfile.mkdtemp(prefix="costlens-long-")
    export(base, "2024-01", RUN, [line("2024-01-01", i) for i in range(20_000)])
    assert [r.header for r in B.headers(spark, f"{base}/*/*").collect()] == [",".join(NAMES)]


def test_survey_sends_no_line_to_python_and_reads_each_file_once(spark, monkeypatch, capsys):
    base = tempfile.mkdtemp(prefix="costlens-once-")
    for i in range(5):
        names = NAMES if i % 2 else list(reversed(NAMES))
        export(base, f"2024-{i + 1:02}", RUN, [line("2024-01-01", k) for k in range(30)], names)
    plain = B.headers
    plain(spark, f"{base}/*/*").explain()
    plan = capsys.readouterr().out
    assert "text" in plan and "Python" not in plan and "MapInArrow" not in plan, plan
    surveyed = spark.sparkContext.accumulator(0)

    def counted(*args):
        def count(batches):
            for batch in batches:
                surveyed.add(batch.num_rows)
                yield batch

        found = plain(*args)
        return found.mapInArrow(count, found.schema)

    monkeypatch.setattr(B, "headers", counted)
    assert B.read_aws_billing(spark, base).count() == 150
    assert surveyed.value == 5


def test_second_run_reads_only_the_new_period(spark):
    base, table, manifest = (tempfile.mkdtemp(prefix="costlens-inc-") for _ in range(3))
    manifest += "/m"
    seen = []

    def clean(df):
        seen.append({os.path.basename(os.path.dirname(os.path.dirname(f))) for f in df.inputFiles()})
        return C.clean_aws(df, period="BILLING_PERIOD")

    export(base, "2024-05", RUN, [line("2024-05-01", 1.0), line("2024-05-02", 2.0)])
    export(base, "2024-06", RUN, [line("2024-06-01", 4.0)])
    export(base, "2024-06", "copy", [line("2024-06-01", 99.0)])
    assert B.update_clean_aws(spark, base, table, manifest, clean) == ["2024-05", "2024-06"]
    before = {f: os.path.getmtime(f"{table}/BILLING_PERIOD=2024-05/{f}") for f in os.listdir(f"{table}/BILLING_PERIOD=2024-05")}
    export(base, "2024-06", LATER, [line("2024-06-02", 8.0), line("2024-06-01", 16.0)])
    assert B.update_clean_aws(spark, base, table, manifest, clean) == ["2024-06"]
    assert seen[-1] == {"BILLING_PERIOD=2024-06"}
    assert B.update_clean_aws(spark, base, table, manifest, clean) == []
    got = spark.read.parquet(table)
    assert sorted(r.cost for r in got.collect()) == [1.0, 2.0, 4.0, 8.0]  # the older run's line is the first
    assert before == {f: os.path.getmtime(f"{table}/BILLING_PERIOD=2024-05/{f}") for f in os.listdir(f"{table}/BILLING_PERIOD=2024-05")}
    whole = C.clean_aws(B.read_aws_billing(spark, base), period="BILLING_PERIOD")
    cols = ["date", "service", "cost"]
    assert sorted(map(tuple, whole.select(cols).collect())) == sorted(map(tuple, got.select(cols).collect()))


def test_a_repeated_run_leaves_one_row_a_service(spark):
    path = tempfile.mkdtemp(prefix="costlens-th-")
    th = spark.createDataFrame([("a", 1.0, 0.5), ("b", 2.0, 0.5)], "service string, threshold double, accuracy double")
    B.append_thresholds(th, path, "2024-01-01 00:00:00")
    for _ in range(2):
        B.append_thresholds(th.withColumn("threshold", F.col("threshold") + 1), path, "2024-01-02 00:00:00")
    rows = spark.read.parquet(path)
    assert rows.count() == 4
    assert {r.service: r.threshold for r in B.latest_thresholds(rows).collect()} == {"a": 2.0, "b": 3.0}


def test_stream_unites_files_by_name(spark):
    base, out = tempfile.mkdtemp(prefix="costlens-in-"), tempfile.mkdtemp(prefix="costlens-by-name-")
    export(base, "2024-05", RUN, [line("2024-05-01", 1.0)])
    export(base, "2024-06", RUN, [line("2024-06-01", 2.0)], list(reversed(NAMES)))
    export(base, "2024-07", RUN, [line("2024-07-01", 4.0)], [c for c in NAMES if c != "product_location"] + ["more"])
    export(base, "2024-07", "copy", [line("2024-07-01", 99.0)])
    run = lambda: I.start_by_name(spark, base, B.AWS_SCHEMA, out, f"by-name-{os.path.basename(out)}").awaitTermination(120)
    run()
    export(base, "2024-08", RUN, [line("2024-08-01", 8.0)], NAMES[3:] + NAMES[:3])
    run()
    run()
    got = spark.read.parquet(out).collect()
    assert sorted((r.BILLING_PERIOD, r.line_item_blended_cost, r.product_location) for r in got) == [
        ("2024-05", 1.0, "x"), ("2024-06", 2.0, "x"), ("2024-07", 4.0, None), ("2024-08", 8.0, "x")
    ]


def test_first_is_by_file_whatever_the_sizes(spark):
    base = tempfile.mkdtemp(prefix="costlens-order-")
    export(base, "2024-05", RUN, [line("2024-05-01", 1.0)], name="daily_costs-00001-a.csv.gz")
    long = [line("2024-05-01", 2.0), *[line("2024-05-03", 3.0, code=f"c{i}") for i in range(5000)]]
    export(base, "2024-05", RUN, long, name="daily_costs-00001-b.csv.gz")  # larger files are read first
    for raw in (
        B.read_aws_billing(spark, base),
        spark.read.option("header", True).schema(", ".join(f"{c} {'double' if 'cost' in c or 'discount' in c else 'string'}" for c in NAMES)).csv(f"{base}/*/*"),
    ):
        for some in (raw, raw.repartition(1) if C.FILE_ORDER in raw.columns else raw):
            got = C.clean_aws(some).where("product_code = 'EC2'").collect()
            assert [r.cost for r in got] == [1.0]


@pytest.mark.parametrize(
    "values,total,mean",
    [
        ([1.0, math.nan], 1.0, 1.0),
        ([1.0, math.inf, -math.inf, None], 1.0, 1.0),
        ([math.nan], None, None),
        ([1.0, 1e29], None, None),
        ([9e27, 9e27], None, None),
        ([4e-11, 1.0], 1.0, 0.5),
        ([6e-11, 6e-11], 2e-10, 1e-10),
        ([4e-7, 5e12], 5000000000000.0000004, 2500000000000.0000002),
    ],
)
def test_sums_of_odd_values(spark, values, total, mean):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    r = df.agg(dsum("x").alias("s"), davg("x").alias("a")).first()
    assert (r.s, r.a) == (total, mean)


def test_metric_report_survives_odd_values(spark):
    rows = [("n", "m", "a", f"2024-01-30 0{h}:00:00", v) for h, v in enumerate([1.0, math.nan, 1e29, 3.0, None])]
    rows += [("n", "m", "a", "2024-01-30 00:10:00", math.inf), ("n", "m", "b", "2024-01-30 00:00:00", 4e-11)]
    points = spark.createDataFrame(rows, "namespace string, metric string, resource_id string, t string, value double")
    points = points.select("namespace", "metric", "resource_id", F.col("t").cast("timestamp_ntz").alias("ts"), "value")
    want = {("a", 0): (1.0, 1.0, 1), ("a", 1): (None, None, 0), ("a", 2): (None, None, 1), ("a", 3): (3.0, 3.0, 1),
            ("a", 4): (None, None, 0), ("b", 0): (0.0, 0.0, 1)}
    for source in (points, M.metric_cube(points, "2024-01-31", "1 day")):
        got = {(r.resource_id, r.bucket_start.hour): (r["sum"], r["avg"], r["cnt"]) for r in M.metric_stats(source, "2024-01-31").collect()}
        assert got == want
        assert {r.resource_id: r.peak for r in M.peak(source, "2024-01-31").collect()} == {"a": 1e29, "b": 4e-11}


def test_odd_rows_of_inventories_and_dates(spark):
    groups = spark.createDataFrame([("c", "n", []), ("c", "k", ["g"])], "cluster string, nodegroup string, asgs array<string>")
    members = spark.createDataFrame([("g", "i")], "asg string, instance_id string")
    assert [r.instance_id for r in TP.cluster_instances(groups, members).collect()] == ["i"]
    base = tempfile.mkdtemp(prefix="costlens-dates-")
    export(base, "2024-05", RUN, [line("2024-05-01", 1.0), line("n/a", 2.0), line("2024-13-45", 3.0)])
    assert [r.cost for r in C.clean_aws(B.read_aws_billing(spark, base)).collect()] == [1.0]
    gcp = spark.createDataFrame([("2024-01-01", "s", "1", "0", "0"), ("yesterday", "s", "2", "0", "0")], "Date string, a string, b string, c string, d string")
    gcp = gcp.toDF("Date", "Service description", "Cost (€)", "Discounts (€)", "Promotions and others (€)")
    assert sorted((str(r.date), r.cost) for r in C.clean_gcp(gcp).collect()) == [("2024-01-01", 1.0), ("None", 2.0)]
