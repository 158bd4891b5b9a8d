"""Billing exports, thresholds and forecasts: readers and writers.

All readers are lazy Spark scans; folder conventions of the cloud exports are
expressed as path globs, partition discovery and a metadata-column filter, so
file listing and pruning happen in Spark, not in a driver-side loop.
"""

from __future__ import annotations

import csv
import datetime as dt
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from costlens.operators.clean import FILE_ORDER, merge_states
from costlens.session import folder_exists, materialize

# The AWS export layout — partition folder prefix, the run-folder
# name pattern (timestamp + UUID) and the data file name prefix.
AWS_PARTITION_PREFIX = "BILLING_PERIOD="
AWS_RUN_FOLDER = (
    r"^\d{4}-\d{2}-\d{2}T\d{2}_\d{2}_\d{2}\.\d{3}Z-[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}$"
)
AWS_FILE_PREFIX = "daily_costs-00001"


# Columns and types that the cleaning reads; amounts of the GCP export are text (CLN-7).
AWS_SCHEMA = (
    "identity_time_interval string, line_item_product_code string, product_region_code string, "
    "product_servicecode string, product_location string, product_to_location string, "
    "product_to_region_code string, line_item_blended_cost double, discount_bundled_discount double, "
    "discount_total_discount double"
)
GCP_SCHEMA = (
    "Date string, `Service description` string, `Cost (€)` string, `Discounts (€)` string, "
    "`Promotions and others (€)` string"
)


def _struct(schema: T.StructType | str) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def _listed(spark: SparkSession, pattern: str, name: str) -> DataFrame:
    """(path) of the files under `pattern` whose name matches the glob `name`: a listing, no content is read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", name).load(pattern).select("path")


def _folder(path, up: int):
    """The name of the folder `up` levels above a file."""
    return F.element_at(F.split(path, "/"), -1 - up)


def headers(spark: SparkSession, pattern: str | Sequence[str], name: str = "*") -> DataFrame:
    """(path, header) of the files under `pattern` whose name matches: one job, however many files there are.

    A task has one file and keeps its first line.  (Its session has settings
    of its own, by which a file fills a partition.)  No line is sent to
    Python: a function that returns after the first line doesn't end the scan,
    and sending each of the others costs ten times what reading it does.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.files.openCostInBytes", str(1 << 40))
    own.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 40))
    lines = own.read.option("pathGlobFilter", name).text([pattern] if isinstance(pattern, str) else list(pattern))
    lines = lines.where("_metadata.file_block_start = 0")
    lines = lines.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("header"))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # in the partition
    return lines.withColumn("place", place).where("place = 0").select("path", "header")


def _columns(spark: SparkSession, header: str) -> list[str]:
    """The names in a header line, as the CSV reader takes them."""
    parsed = next(csv.reader([header]))
    return [c if c else f"_c{i}" for i, c in enumerate(parsed)]


def read_by_name(
    spark: SparkSession,
    pattern: str | Sequence[str],
    name: str,
    schema: T.StructType | str,
    base: str | None = None,
    keep: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """CSV files with a header, columns matched by name (Spark maps a given schema by position).

    `keep`: a condition on the path of a file.  Columns that a file lacks
    become null, those that `schema` doesn't name are not read.  No files: an
    empty table.  The headers are surveyed once, by one job, and grouped.  Files
    with one header in common are read by `pattern`; of several headers, each
    one's files are read together, and their paths reach the driver, as any
    list of files that Spark reads does.  `__file_order` orders the lines.
    """
    want = _struct(schema)
    found = headers(spark, pattern, name)
    found = materialize(found.where(keep(F.col("path"))) if keep is not None else found)  # a row per file
    kinds = found.groupBy("header").agg(F.count(F.lit(1)).alias("files")).toArrow().column("header").to_pylist()
    whole = [pattern] if isinstance(pattern, str) else list(pattern)
    groups: list[tuple[str, Sequence[str]]] = [(kinds[0], whole)] if len(kinds) == 1 else []
    if len(kinds) > 1:
        paths = found.groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("paths")).toArrow().to_pylist()
        groups = sorted((r["header"], r["paths"]) for r in paths)
    types = {f.name: f.dataType for f in want}
    parts = []
    for line, files in groups:
        header = _columns(spark, line)
        layout = T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in header])
        r = spark.read.option("header", True).option("enforceSchema", False).option("pathGlobFilter", name).schema(layout)
        df = (r.option("basePath", base) if base else r).csv(list(files))
        if keep is not None:
            df = df.where(keep(F.col("_metadata.file_path")))
        extra = [c for c in df.columns if c not in header]  # partition columns
        cols = [F.col(f"`{f.name}`") if f.name in header else F.lit(None).cast(f.dataType).alias(f.name) for f in want]
        place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("id"))
        parts.append(df.select(*cols, *extra, place.alias(FILE_ORDER)))
    if not parts:
        none = spark.createDataFrame([], want)
        return none.withColumn(FILE_ORDER, F.lit(None).cast("struct<file_path:string,file_block_start:bigint,id:bigint>"))
    return union_reports(parts)


def _is_run(path: Column) -> Column:
    return _folder(path, 1).rlike(AWS_RUN_FOLDER)


def read_aws_billing(
    spark: SparkSession,
    base: str,
    schema: T.StructType | str | None = None,
    file_prefix: str = AWS_FILE_PREFIX,
    periods: Sequence[str] | None = None,
) -> DataFrame:
    """SRC-1: `base/BILLING_PERIOD=*/<run folder>/daily_costs-00001*.gz` CSVs, columns by name.

    `BILLING_PERIOD` becomes a partition column; run folders that do not
    match the timestamp+UUID pattern are left out.  `schema` names the columns
    to read (the billing columns by default); `file_prefix` is the data file
    name prefix (the export's by default); `periods`: only these are listed
    and read."""
    base = base.rstrip("/")
    which = "*" if periods is None else "{" + ",".join(periods) + "}"
    pattern = f"{base}/{AWS_PARTITION_PREFIX}{which}/*"
    return read_by_name(spark, pattern, f"{file_prefix}*.gz", AWS_SCHEMA if schema is None else schema, base, _is_run)


def read_gcp_billing(spark: SparkSession, folder: str, prefix: str, schema=None) -> DataFrame:
    """SRC-2: GCP CSV exports whose file name starts with `prefix`, columns by name."""
    return read_by_name(spark, folder, f"{prefix}*.csv", GCP_SCHEMA if schema is None else schema)


def update_clean_aws(
    spark: SparkSession,
    base: str,
    table: str,
    manifest: str,
    clean: Callable[[DataFrame], DataFrame],
    schema: T.StructType | str | None = None,
    file_prefix: str = AWS_FILE_PREFIX,
) -> list[str]:
    """SRC-1 + SNK-1 by increments: cleans the billing periods that have a run folder the manifest doesn't name.

    The listing of run folders is anti-joined with the manifest (period, run).
    Only the periods found are read, cleaned by `clean` (raw rows of one or
    more periods, with BILLING_PERIOD, to clean rows with it) and put in place
    of their partitions of `table`; then their runs are added to the manifest.
    A job that is lost before that is simply repeated.  Returns the periods
    (a few months; the runs stay in Spark).
    """
    files = _listed(spark, f"{base.rstrip('/')}/{AWS_PARTITION_PREFIX}*/*", f"{file_prefix}*.gz").where(_is_run(F.col("path")))
    period = F.substring_index(_folder(F.col("path"), 2), "=", -1)
    runs = files.select(period.alias("period"), _folder(F.col("path"), 1).alias("run")).distinct()
    if folder_exists(spark, manifest):
        runs = runs.join(spark.read.schema("period string, run string").parquet(manifest), ["period", "run"], "left_anti")
    runs = materialize(runs)
    periods = sorted(runs.select("period").distinct().toArrow().column("period").to_pylist())
    if periods:
        rows = clean(read_aws_billing(spark, base, schema, file_prefix, periods))
        rows = rows.withColumn("BILLING_PERIOD", F.col("BILLING_PERIOD").cast("string"))
        _replace_partitions(rows, table, ["BILLING_PERIOD"])
        runs.write.mode("append").parquet(manifest)
    return periods


def add_state(state: DataFrame, table: str, run_id: str) -> None:
    """CLN-4 by increments: keeps one snapshot's state (`clean.group_state`) as the partition `run_id` of `table`.

    A repeated run replaces its own partition, so no line counts twice.  A
    snapshot without groups adds nothing."""
    _replace_partitions(state.withColumn("run_id", F.lit(run_id)), table, ["run_id"])


def read_states(spark: SparkSession, table: str) -> DataFrame:
    """The states of all runs kept in `table`, to be merged (`clean.merge_states`, `clean.clean_aws_state`)."""
    return spark.read.parquet(table).drop("run_id")


def compact_states(states: DataFrame, keys: Sequence[str], table: str, run_id: str = "merged") -> None:
    """Many runs' states as one run of another table, which later runs are then added to.

    The old table stays as it is until the caller drops it, so a job lost on
    the way loses nothing and counts nothing twice."""
    add_state(merge_states(states, keys), table, run_id)


def _replace_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Writes `df` in place of the partitions it has rows of; the others stay."""
    even = df.hint("rebalance", *[F.col(c) for c in by])
    even.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def union_reports(dfs: Sequence[DataFrame]) -> DataFrame:
    """SRC-3: concatenate reports by column name; missing columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def read_report(spark: SparkSession, path: str, schema=None, fmt: str = "csv") -> DataFrame:
    """SRC-4: one merged or clean report (CSV with header, or Parquet)."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    r = spark.read.option("header", True)
    r = r.schema(schema) if schema is not None else r
    return r.csv(path)


def write_clean(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """SNK-1 (+ CLN-10): write the clean table partitioned by provider, each
    file sorted by date (a per-partition sort, not a global range shuffle).
    Rebalanced, so that tasks and files follow the size and not the number of
    providers."""
    even = df.hint("rebalance").sortWithinPartitions("provider", "date")
    w = even.write.mode(mode).partitionBy("provider")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)


def append_thresholds(thresholds: DataFrame, path: str, run_ts=None, run_id: str | None = None) -> None:
    """SNK-2: one threshold row per service for this run, next to those of the other runs.

    `run_id` (the time of the run by default) names the run's partition, which
    is replaced as a whole: a repeated run leaves one row per service."""
    now = dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")
    ts = str(now if run_ts is None else run_ts)
    rows = thresholds.select("service", F.col("threshold").cast("double"), "accuracy")
    rows = rows.withColumn("run_ts", F.lit(ts).cast("timestamp"))
    _replace_partitions(rows.withColumn("run_id", F.lit(ts if run_id is None else run_id)), path, ["run_id"])


def write_forecasts(forecasts: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK-3: all services' forecasts in one table partitioned by service."""
    forecasts.repartition("service").write.mode(mode).partitionBy("service").parquet(path)


def read_forecasts(spark: SparkSession, path: str) -> DataFrame:
    """SRC-5: every service's forecasts in one read of the partitioned table."""
    return spark.read.parquet(path)


def latest_thresholds(history: DataFrame, order: Sequence[str] = ("run_ts",)) -> DataFrame:
    """SRC-6: the last threshold per service (`max_by` over the run order)."""
    key = F.struct(*[F.col(c) for c in order])
    return history.groupBy("service").agg(F.max_by("threshold", key).alias("threshold"))


def thresholds_wide(latest: DataFrame, services: Sequence[str]) -> DataFrame:
    """SRC-7: one row, one column per service (explicit pivot values)."""
    return latest.groupBy().pivot("service", list(services)).agg(F.first("threshold"))
