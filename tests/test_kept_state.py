"""Kept aggregate states of billing snapshots, kept metric cells by day, and statistics at many times in one pass."""

import datetime as dt
import math
import tempfile

import pytest
from pyspark.sql import functions as F

from costlens.operators import clean as C
from costlens.operators import metrics as M
from costlens.operators import report as RP
from costlens.plans import q_models as Q
from costlens.sources import billing as B
from costlens.sources.fixtures import Tables

SF = "/root/testdata/sf0.001"
RAW = (
    "id long, identity_time_interval string, line_item_product_code string, product_region_code string, "
    "product_servicecode string, product_location string, line_item_blended_cost double, "
    "discount_bundled_discount double, discount_total_discount double"
)
POINTS = "namespace string, metric string, resource_id string, ts timestamp_ntz, value double"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def raw(spark, lines):
    full = [(i, f"{day}T00:00:00Z/P1D", code, "eu", code, place, cost, 0.0, 0.0) for i, day, code, place, cost in lines]
    return spark.createDataFrame(full, RAW)


LINES = [
    (5, "2024-01-01", "EC2", "x", 5.0),
    (3, "2024-01-01", "EC2", None, 3.0),
    (4, "2024-01-01", "EC2", "y", None),
    (1, "2024-01-02", "EC2", None, 1e29),
    (2, "2024-01-02", "EC2", None, 2.0),
    (6, "2024-01-03", "S3", "x", math.nan),
    (7, "2024-01-03", "S3", "x", 7.5),
    (8, "not a day", "S3", "x", 8.0),
    (9, "2024-01-03", None, "x", 9.0),
]


@pytest.mark.parametrize("agg", ["first", "sum"])
@pytest.mark.parametrize("split", [0, 2, 4, 9])
def test_states_of_parts_equal_one_pass(spark, agg, split):
    whole = C.clean_aws(raw(spark, LINES), ["id"], agg)
    parts = (LINES[:split], LINES[split:])
    states = [C.aws_state(raw(spark, p), ["id"], agg) for p in parts]
    assert rows(C.clean_aws_state(states[0].unionByName(states[1]))) == rows(whole)


@pytest.mark.parametrize("agg", ["first", "sum"])
def test_kept_states_take_late_lines_repeats_and_compaction(spark, agg):
    base = tempfile.mkdtemp(prefix="costlens-states-")
    late, early = LINES[:4], LINES[4:]  # the second run holds earlier lines, too
    for run, part in (("1", late), ("2", early), ("2", early), ("1", late)):
        B.add_state(C.aws_state(raw(spark, part), ["id"], agg), f"{base}/a", run)
    want = rows(C.clean_aws(raw(spark, LINES), ["id"], agg))
    assert rows(C.clean_aws_state(B.read_states(spark, f"{base}/a"))) == want
    B.compact_states(B.read_states(spark, f"{base}/a"), C.AWS_KEYS, f"{base}/b")
    assert rows(C.clean_aws_state(B.read_states(spark, f"{base}/b"))) == want
    more = [(0, "2024-01-01", "EC2", "first", 0.5)]
    B.add_state(C.aws_state(raw(spark, more), ["id"], agg), f"{base}/b", "3")
    assert rows(C.clean_aws_state(B.read_states(spark, f"{base}/b"))) == rows(C.clean_aws(raw(spark, LINES + more), ["id"], agg))


def test_a_total_out_of_range_stays_null_when_merged(spark):
    big = [(1, "2024-01-01", "EC2", "x", 9e27), (2, "2024-01-01", "EC2", "x", 9e27)]
    states = [C.aws_state(raw(spark, p), ["id"], "sum") for p in (big, [(3, "2024-01-01", "EC2", "x", 1.0)])]
    keys = C.AWS_KEYS
    merged = C.finish_state(C.merge_states(states[0].unionByName(states[1]), keys), keys)
    assert merged.first()["line_item_blended_cost"] is None


def test_merging_states_is_one_partial_aggregate(spark):
    states = C.aws_state(Tables(spark, SF).cost_aws_raw, ["l_orderkey", "l_linenumber"])
    path = tempfile.mkdtemp(prefix="costlens-states-")
    B.add_state(states, path, "1")
    plan = C.clean_aws_state(B.read_states(spark, path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_min_by" in plan and "Window" not in plan


# ------------------------------------------------------------------ cells by day
STATS = [("1 day", "1 hour"), ("60 minutes", "1 day"), ("7 days", "1 day"), ("1 day", "300 seconds")]


def test_store_answers_as_the_points_do(spark):
    points = Tables(spark, SF).metric_points
    store = M.CellStore(spark, tempfile.mkdtemp(prefix="costlens-cells-"))
    for as_of in ["2024-01-20", "2024-01-21", "2024-01-25 13:07:00", "2024-01-30 21:59:41"]:
        store.add(points, as_of)
        cube = store.cube(points, as_of)
        for lookback, period in STATS:
            want = rows(M.metric_stats(points, as_of, lookback, period))
            assert rows(M.metric_stats(cube, as_of, lookback, period)) == want, (as_of, lookback)
        assert rows(M.peak(cube, as_of, "1 day")) == rows(M.peak(points, as_of, "1 day"))
        assert rows(M.window_rows(cube, as_of, "7 days", ["metric"])) == rows(M.window_rows(points, as_of, "7 days", ["metric"]))


def test_a_new_day_reads_that_day_only(spark):
    points = Tables(spark, SF).metric_points
    store = M.CellStore(spark, tempfile.mkdtemp(prefix="costlens-cells-"))
    assert len(store.add(points, "2024-01-20")) == 7
    day = points.where((F.col("ts") >= "2024-01-20") & (F.col("ts") < "2024-01-21"))
    assert store.add(day, "2024-01-21") == ["2024-01-20"]
    assert store.add(day, "2024-01-21") == []
    cube = store.cube(points.where("false"), "2024-01-21")  # whole days: nothing of the points is needed
    assert rows(M.metric_stats(cube, "2024-01-21", "7 days", "1 hour")) == rows(
        M.metric_stats(points, "2024-01-21", "7 days", "1 hour")
    )
    plan = cube.window("2024-01-21", "1 day")._jdf.queryExecution().executedPlan().toString()
    assert "events.parquet" not in plan


def test_days_never_added_and_late_points(spark):
    points = Tables(spark, SF).metric_points
    store = M.CellStore(spark, tempfile.mkdtemp(prefix="costlens-cells-"))
    on_time = points.where("hour(ts) < 20 or ts < '2024-01-19'")
    store.add(on_time, "2024-01-20", "2 days")
    assert store.add(points, "2024-01-20", "2 days", again=1) == ["2024-01-19"]
    store.add(points, "2024-01-23", "1 day")  # leaves a gap of two days
    assert store.days() == ["2024-01-18", "2024-01-19", "2024-01-22"]
    for as_of in ("2024-01-23", "2024-01-22 06:30:00"):
        got = M.metric_stats(store.cube(points, as_of), as_of, "7 days", "1 hour")
        assert rows(got) == rows(M.metric_stats(points, as_of, "7 days", "1 hour"))


def test_an_empty_store_and_no_points(spark):
    points = spark.createDataFrame([], POINTS)
    store = M.CellStore(spark, tempfile.mkdtemp(prefix="costlens-cells-"))
    assert len(store.add(points, "2024-01-20")) == 7
    assert rows(M.metric_stats(store.cube(points, "2024-01-20 00:10:00"), "2024-01-20 00:10:00")) == []
    with pytest.raises(ValueError):
        M.CellStore(spark, store.path, 7).add(points, "2024-01-20")


def test_the_report_reads_the_store(spark):
    t = Tables(spark, SF)
    as_of = Q.fixture_setup().as_of
    store = M.CellStore(spark, tempfile.mkdtemp(prefix="costlens-cells-"))
    store.add(t.metric_points, as_of)
    services = ["AmazonCloudWatch", "AmazonEC2"]
    cubes = (M.metric_cube(t.metric_points, as_of), store.cube(t.metric_points, as_of))
    made = [rows(RP.findings(t, cube, Q.fixture_setup(), services)) for cube in cubes]
    assert made[0] and made[0] == made[1]


# ------------------------------------------------------------------ many times
TIMES = [f"2024-01-{d} 00:00:00" for d in range(22, 29)]


@pytest.mark.parametrize("lookback,period", [("2 days", "1 hour"), ("7 days", "1 day"), ("1 day", "300 seconds")])
def test_many_times_equal_single_runs(spark, lookback, period):
    points = Tables(spark, SF).metric_points
    got = rows(M.resource_stats_at(points, TIMES, lookback, period).withColumn("as_of", F.col("as_of").cast("string")))
    want = []
    for t in TIMES:
        one = M.resource_stat(M.metric_stats(points, t, lookback, period))
        want += rows(one.select(*M.KEYS, F.lit(t).alias("as_of"), "avg_of_avg", "total", "buckets"))
    assert got == sorted(want, key=repr)


def test_many_times_from_kept_cells(spark):
    points = Tables(spark, SF).metric_points
    kept = M.cells(points, 300)
    assert rows(M.resource_stats_at(kept, TIMES)) == rows(M.resource_stats_at(points, TIMES))


def test_many_times_take_odd_values(spark):
    at = dt.datetime(2024, 1, 1)
    hour = dt.timedelta(hours=1)
    data = [("n", "m", "a", at + i * hour, v) for i, v in enumerate([1.0, math.nan, 1e29, 4e-10, math.inf, 6.0])]
    data += [("n", "m", "b", at, None), ("n", None, "c", at, 2.0), ("n", "m", None, at, 3.0)]
    points = spark.createDataFrame(data, POINTS)
    times = [at + i * hour for i in range(8)]
    got = rows(M.resource_stats_at(points, times, "2 hours", "1 hour").withColumn("as_of", F.col("as_of").cast("string")))
    want = []
    for t in times:
        one = M.resource_stat(M.metric_stats(points, t, "2 hours", "1 hour"))
        want += rows(one.select(*M.KEYS, F.lit(str(t)).alias("as_of"), "avg_of_avg", "total", "buckets"))
    assert got == sorted(want, key=repr)
    assert M.resource_stats_at(points.where("false"), times).count() == 0


def test_many_times_take_one_scan_and_two_shuffles(spark):
    points = Tables(spark, SF).metric_points
    plan = M.resource_stats_at(points, TIMES)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == plan.count("events.parquet") == 1
    assert plan.count("Exchange hashpartitioning") == 2


def test_times_off_the_period_are_refused(spark):
    points = Tables(spark, SF).metric_points
    for times, lookback in (([], "1 day"), (["2024-01-01 00:30:00"], "1 day"), (TIMES, "90 minutes")):
        with pytest.raises(ValueError):
            M.resource_stats_at(points, times, lookback, "1 hour")
