"""Physical-plan shape: filters and column pruning reach the Parquet scan."""

import re

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    spark = df.sparkSession
    old = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")  # untruncated scan metadata
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", old)


def _scan_schemas(plan: str, table: str) -> list[str]:
    out = []
    for line in plan.splitlines():
        if f"{table}.parquet" in line:
            m = re.search(r"ReadSchema: (struct<[^>]*>)", line)
            if m:
                out.append(m.group(1))
    return out


def test_metric_window_and_name_pushed_to_scan(spark):
    plan = _plan(E.queries()["ec2_1_low_cpu"](spark, SF))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(ts,", plan)
    assert re.search(r"PushedFilters: \[[^\]]*LessThan\(ts,", plan)
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(event_type,view\)", plan)
    # only the columns the check needs are read from the events table
    for schema in _scan_schemas(plan, "events"):
        assert "payload" not in schema and schema.count(":") <= 4, schema


def test_clean_aws_reads_only_used_lineitem_columns(spark):
    plan = _plan(E.queries()["cln12_clean_aws"](spark, SF))
    schemas = _scan_schemas(plan, "lineitem")
    assert schemas and all("l_comment" not in s and "l_shipinstruct" not in s for s in schemas)


def test_cube_windows_filter_the_checkpointed_cells(spark):
    from costlens.operators import metrics as M
    from costlens.sources.fixtures import Tables

    cube = M.metric_cube(Tables(spark, SF).metric_points, "2024-01-31", "7 days")
    plan = _plan(M.metric_stats(cube, "2024-01-31", "1 day", "1 hour", ["view"]))
    assert "events.parquet" not in plan and "cell_start" in plan


def test_forest_rows_are_not_shuffled_for_per_service_tables(spark):
    """Counts and offsets of the services are broadcast behind a checked count, even with automatic broadcasts off."""
    from pyspark.sql import functions as F

    from costlens.operators import anomaly as AN

    rows = spark.range(4000).select(
        F.when(F.col("id") % 3 == 0, "a").otherwise("hot").alias("service"), F.col("id").alias("row_id"), F.rand(1).alias("cost"), F.rand(2).alias("raw")
    )
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (
            AN.iforest_fit(rows, "service", "cost", "row_id"),
            AN.with_decision(rows, "service", "raw"),
            AN.calibrate_threshold(AN.with_decision(rows, "service", "raw"), "service"),
        ):
            plan = _plan(df)
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_cube_is_read_by_column_and_metric(spark):
    from costlens.operators import metrics as M
    from costlens.sources.fixtures import Tables

    cube = M.metric_cube(Tables(spark, SF).metric_points, "2024-01-31", "7 days")
    plan = _plan(M.peak(cube, "2024-01-31", "1 day", ["view"]))
    assert re.search(r"PushedFilters: \[[^\]]*(EqualTo|In)\(metric,", plan)
    assert "vsum" not in re.search(r"ReadSchema: (struct<[^>]*>)", plan).group(1)


def test_clean_table_is_rebalanced_by_size(spark, tmp_path):
    import os

    from costlens.sources import billing as B

    rows = spark.range(100).selectExpr("'aws' as provider", "date_add(date'2024-01-01', cast(id % 30 as int)) as date", "1.0 as cost")
    B.write_clean(rows, str(tmp_path / "clean"))
    for folder, _, names in os.walk(tmp_path / "clean"):
        for n in names:
            if n.endswith(".parquet"):
                dates = [r.date for r in spark.read.parquet(f"{folder}/{n}").collect()]
                assert dates == sorted(dates)
