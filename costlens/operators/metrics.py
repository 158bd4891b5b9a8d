"""Metric aggregation: what the cloud metric APIs compute.

Input is the long table `metric_points(namespace, metric, resource_id, ts, value)`.
Every statistic is a filter on the `[as_of - lookback, as_of)` window (pushed
to the scan) followed by one hash aggregate keyed by resource and time
bucket — partial aggregation happens map-side, so a resource with a third of
all points costs one partial row per task, not a third of the data in one task.
"""

from __future__ import annotations

import datetime as _dt
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from costlens.functions import davg, dsum, exact, finite, lit_ts
from costlens.functions.columns import MONEY
from costlens.session import folder_exists, scratch_folder

KEYS = ("namespace", "metric", "resource_id")


def in_window(points: DataFrame, as_of, lookback: str, ts: str = "ts") -> DataFrame:
    """Rows with `as_of - lookback <= ts < as_of` (D14)."""
    end = lit_ts(as_of)
    start = end - F.expr(f"INTERVAL {lookback}")
    return points.filter((F.col(ts) >= start) & (F.col(ts) < end))


def only_metrics(points: DataFrame, metrics: Sequence[str] | str | None) -> DataFrame:
    if metrics is None:
        return points
    if isinstance(metrics, str):
        metrics = [metrics]
    return points.filter(F.col("metric").isin(list(metrics)))


# ------------------------------------------------------------------ shared cube
_UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def seconds(span: str) -> int:
    """'7 days' / '60 minutes' / '300 seconds' -> whole seconds."""
    m = re.fullmatch(r"\s*(\d+)\s+(second|minute|hour|day|week)s?\s*", span.lower())
    if not m:
        raise ValueError(f"unsupported time span: {span!r}")
    return int(m.group(1)) * _UNIT_SECONDS[m.group(2)]


def _epoch_seconds(as_of) -> float:
    if isinstance(as_of, _dt.datetime):
        t = as_of
    elif isinstance(as_of, _dt.date):
        t = _dt.datetime(as_of.year, as_of.month, as_of.day)
    else:
        t = _dt.datetime.fromisoformat(str(as_of))
    if t.tzinfo is not None:
        t = t.astimezone(_dt.timezone.utc).replace(tzinfo=None)
    return (t - _dt.datetime(1970, 1, 1)).total_seconds()


@dataclass(frozen=True)
class MetricCube:
    """Metric points of one window pre-aggregated into cells, shared by many checks.

    Cells are `grain`-second buckets aligned to the epoch, each split once at
    the offset of `as_of`, so every window `[as_of - k·grain, as_of)` and every
    epoch-aligned period that is a multiple of `grain` is a union of whole
    cells.  Sums are kept as exact decimals, so statistics re-aggregated from
    the cube equal the ones computed from the raw points."""

    df: DataFrame  # KEYS, cell_start, vsum (decimal), vfit, vcnt (values in the sum's range, finite values), nrows, vmax
    as_of: object
    lookback_s: int
    grain_s: int

    def window(self, as_of, lookback: str) -> DataFrame:
        """Cells inside `[as_of - lookback, as_of)`."""
        lb = seconds(lookback)
        if _epoch_seconds(as_of) != _epoch_seconds(self.as_of):
            raise ValueError("metric cube was built for another as_of")
        if lb > self.lookback_s or lb % self.grain_s:
            raise ValueError(f"window {lookback!r} is not covered by the metric cube")
        end = lit_ts(as_of)
        start = end - F.expr(f"INTERVAL {lb} SECONDS")
        return self.df.filter((F.col("cell_start") >= start) & (F.col("cell_start") < end))

    def check_period(self, period: str) -> None:
        if seconds(period) % self.grain_s:
            raise ValueError(f"period {period!r} is not a multiple of the cube grain")


def cells(points: DataFrame, grain_seconds: int, cut: int = 0) -> DataFrame:
    """Points aggregated (map-side combined) into `grain_seconds` cells, each split at `cut` seconds if that isn't 0."""
    b = F.window("ts", f"{grain_seconds} seconds").start
    at = b + F.expr(f"INTERVAL {cut} SECONDS")
    cell = F.when(F.col("ts") >= at, at).otherwise(b) if cut else b
    return points.groupBy(*KEYS, cell.alias("cell_start")).agg(
        F.try_sum(exact("value")).alias("vsum"),
        F.count(exact("value")).alias("vfit"),
        F.count(finite("value")).alias("vcnt"),
        F.count(F.lit(1)).alias("nrows"),
        F.max(finite("value")).alias("vmax"),
    )


def metric_cube(
    points: DataFrame,
    as_of,
    lookback: str = "7 days",
    grain_seconds: int = 300,
    metrics: Sequence[str] | str | None = None,
    materialize: bool = True,
) -> MetricCube:
    """One scan and one (map-side combined) aggregate of the metric points of
    the widest window; the checks of a report then read the cube instead of
    scanning the raw points once each.  The cube is written to the session's
    shared checkpoint folder (`checkpoint()`), which also cuts its lineage."""
    lb = seconds(lookback)
    if lb % grain_seconds:
        raise ValueError("lookback must be a multiple of the grain")
    off = int(_epoch_seconds(as_of)) % grain_seconds
    df = cells(only_metrics(in_window(points, as_of, lookback), metrics), grain_seconds, off)
    if materialize:
        # Parquet, sorted by metric: a check reads only its columns and the row groups of its metrics.
        path = scratch_folder(df.sparkSession, "cube")
        df.sortWithinPartitions("metric", "cell_start").write.parquet(path)
        df = df.sparkSession.read.schema(df.schema).parquet(path)
    return MetricCube(df, as_of, lb, grain_seconds)


def _moment(epoch_seconds: float) -> _dt.datetime:
    return _dt.datetime(1970, 1, 1) + _dt.timedelta(seconds=epoch_seconds)


@dataclass(frozen=True)
class CellStore:
    """Cells of whole days kept on disk, so that the next report reads the new days only.

    `path/cells` holds a partition per day, its cells aligned to the epoch;
    `path/days` names the days that are done.  A day is written before it is
    named, and written again in place if the job is lost in between.  Points
    are taken to be complete once their day is over; `again` reads the last
    days once more where they come late.
    """

    spark: SparkSession
    path: str
    grain_s: int = 300

    def days(self) -> list[str]:
        """The days kept, as ISO text (one short string per day of history)."""
        if not folder_exists(self.spark, f"{self.path}/days"):
            return []
        kept = self.spark.read.schema("day string").parquet(f"{self.path}/days").distinct()
        return sorted(kept.toArrow().column("day").to_pylist())

    def add(self, points: DataFrame, as_of, lookback: str = "7 days", again: int = 0) -> list[str]:
        """Adds the whole days of `[as_of - lookback, as_of)` that aren't kept, and the last `again` ones in any case.

        One scan of these days' points, by ranges of `ts` that reach the scan;
        returns the days read."""
        if 86400 % self.grain_s:
            raise ValueError("a day must be a multiple of the grain")
        first, last = self._whole_days(as_of, lookback)
        kept = set(self.days())
        days = [first + i for i in range(last - first)]
        days = [d for d in days if _iso(d) not in kept or d >= last - again]
        if days:
            rows = cells(points.where(_ranges([(d * 86400, (d + 1) * 86400) for d in days])), self.grain_s)
            rows = rows.withColumn("day", F.to_date("cell_start"))
            even = rows.hint("rebalance", F.col("day")).sortWithinPartitions("day", "metric", "cell_start")
            w = even.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day")
            w.parquet(f"{self.path}/cells")
            new = [(_iso(d),) for d in days if _iso(d) not in kept]
            if new:
                self.spark.createDataFrame(new, "day string").coalesce(1).write.mode("append").parquet(f"{self.path}/days")
        return [_iso(d) for d in days]

    def cube(self, points: DataFrame, as_of, lookback: str = "7 days") -> MetricCube:
        """The `metric_cube` of a window: kept cells, and from `points` what no kept day holds whole.

        These are the hours of `as_of`'s own day, days that were never added
        and the part of a cell at the window's start; they are aggregated once
        and written to a scratch folder."""
        lb = seconds(lookback)
        if lb % self.grain_s:
            raise ValueError("lookback must be a multiple of the grain")
        end = _epoch_seconds(as_of)
        start, head = end - lb, -(-(end - lb) // self.grain_s) * self.grain_s
        kept = [int(_epoch_seconds(d)) for d in self.days()]
        kept = [d for d in kept if d + 86400 > head and d + 86400 <= end]
        gaps, at = [], start
        for d in kept:
            gaps.append((at, max(d, head)))
            at = d + 86400
        gaps = [(a, b) for a, b in gaps + [(at, end)] if a < b]
        parts = []
        schema = cells(points, self.grain_s).schema
        if kept:
            days = [F.lit(str(_moment(d).date())).cast("date") for d in kept]
            stored = self.spark.read.schema(schema.add("day", "date")).parquet(f"{self.path}/cells")
            parts.append(stored.where(F.col("day").isin(days) & (F.col("cell_start") >= lit_ts(_moment(head)))).drop("day"))
        if gaps:
            off = int(end) % self.grain_s
            edge = cells(points.where(_ranges(gaps)), self.grain_s, off)
            path = scratch_folder(self.spark, "edge")
            edge.sortWithinPartitions("metric", "cell_start").write.parquet(path)
            parts.append(self.spark.read.schema(edge.schema).parquet(path))
        df = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return MetricCube(df, as_of, lb, self.grain_s)

    def _whole_days(self, as_of, lookback: str) -> tuple[int, int]:
        """Numbers of the first and one past the last whole day of the window."""
        end = _epoch_seconds(as_of)
        return int(-(-(end - seconds(lookback)) // 86400)), int(end // 86400)


def _iso(day: int) -> str:
    return _moment(day * 86400).date().isoformat()


def _ranges(spans: Sequence[tuple[float, float]], ts: str = "ts") -> Column:
    """Times in any of the `[from, to)` spans (epoch seconds, ascending); adjoining ones become one range."""
    joined: list[list[float]] = []
    for a, b in spans:
        if joined and joined[-1][1] == a:
            joined[-1][1] = b
        else:
            joined.append([a, b])
    conds = [(F.col(ts) >= lit_ts(_moment(a))) & (F.col(ts) < lit_ts(_moment(b))) for a, b in joined]
    return reduce(lambda x, y: x | y, conds)


def window_rows(points, as_of, lookback: str, keys: Sequence[str]) -> DataFrame:
    """Raw datapoint count per `keys` inside the window (from points or a cube)."""
    if isinstance(points, MetricCube):
        return points.window(as_of, lookback).groupBy(*keys).agg(F.sum("nrows").alias("n"))
    return in_window(points, as_of, lookback).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def peak(points, as_of, lookback: str = "1 day", metrics=None) -> DataFrame:
    """Largest raw datapoint per resource inside the window (from points or a cube)."""
    if isinstance(points, MetricCube):
        c = only_metrics(points.window(as_of, lookback), metrics)
        return c.groupBy("resource_id").agg(F.max("vmax").alias("peak"))
    p = only_metrics(in_window(points, as_of, lookback), metrics)
    return p.groupBy("resource_id").agg(F.max(finite("value")).alias("peak"))


def metric_stats(
    points,
    as_of,
    lookback: str = "1 day",
    period: str = "1 hour",
    metrics: Sequence[str] | str | None = None,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """MET-1 / MET-2: per metric and resource, `period` buckets of sum, average
    and count of the finite values over the last `lookback` -> `metric_stats` table
    (a bucket's sum and average are null if it holds a value of 1e28 or more).

    `points` is the raw point table or a `MetricCube` of it."""
    if isinstance(points, MetricCube):
        points.check_period(period)
        c = only_metrics(points.window(as_of, lookback), metrics)
        n = F.sum("vcnt")
        tot = F.when(F.sum("vfit") == n, F.try_sum("vsum").cast("double"))
        return (
            c.groupBy(*keys, F.window("cell_start", period).alias("w"))
            .agg(tot.alias("sum"), F.try_divide(tot, n.cast("double")).alias("avg"), n.alias("cnt"))
            .select(*keys, F.col("w.start").alias("bucket_start"), "sum", "avg", "cnt")
        )
    p = only_metrics(in_window(points, as_of, lookback), metrics)
    return (
        p.groupBy(*keys, F.window("ts", period).alias("w"))
        .agg(dsum("value").alias("sum"), davg("value").alias("avg"), F.count(finite("value")).alias("cnt"))
        .select(*keys, F.col("w.start").alias("bucket_start"), "sum", "avg", "cnt")
    )


def align_mean(points: DataFrame, as_of, lookback: str = "7 days", period: str = "1 hour", metrics=None):
    """MET-3: hourly mean over 7 days."""
    return metric_stats(points, as_of, lookback, period, metrics).select(*KEYS, "bucket_start", "avg")


def align_sum(points: DataFrame, as_of, lookback: str = "7 days", period: str = "1 day", metrics=None):
    """MET-4: daily sum over 7 days."""
    return metric_stats(points, as_of, lookback, period, metrics).select(*KEYS, "bucket_start", "sum")


def align_rate(points: DataFrame, as_of, lookback: str = "1 day", seconds: int = 300, metrics=None):
    """MET-5: per-second rate in `seconds` buckets over 1 day."""
    s = metric_stats(points, as_of, lookback, f"{seconds} seconds", metrics)
    return s.select(*KEYS, "bucket_start", (F.col("sum") / F.lit(float(seconds))).alias("rate"))


def raw_points(points: DataFrame, as_of, lookback: str = "1 day", metrics=None) -> DataFrame:
    """MET-6: raw points of some metrics inside the window."""
    return only_metrics(in_window(points, as_of, lookback), metrics)


def resource_stat(stats: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """MET-7: per resource, the (unweighted) average of bucket averages and the
    total of bucket sums."""
    return stats.groupBy(*keys).agg(
        davg("avg").alias("avg_of_avg"), dsum("sum").alias("total"), F.count(F.lit(1)).alias("buckets")
    )


def per_resource(
    points: DataFrame,
    as_of,
    metric_alias: dict[str, str],
    lookback: str = "1 day",
    period: str = "1 hour",
) -> DataFrame:
    """Stats of several metrics side by side, one row per resource.

    `metric_alias` maps a metric name to an output prefix; the result has
    `<prefix>_avg` (average of bucket averages), `<prefix>_total` (sum),
    `<prefix>_sum_avg` (sum of bucket averages),
    `<prefix>_max` (largest bucket average) and `<prefix>_buckets` for each
    metric.  One aggregate with conditional columns — no pivot discovery job.
    """
    st = metric_stats(points, as_of, lookback, period, list(metric_alias))
    aggs: list[Column] = []
    for m, a in metric_alias.items():
        is_m = F.col("metric") == m
        aggs += [
            davg(F.when(is_m, F.col("avg"))).alias(f"{a}_avg"),
            dsum(F.when(is_m, F.col("sum"))).alias(f"{a}_total"),
            dsum(F.when(is_m, F.col("avg"))).alias(f"{a}_sum_avg"),
            F.max(F.when(is_m, F.col("avg"))).alias(f"{a}_max"),
            F.max(F.when(is_m, F.col("sum"))).alias(f"{a}_max_sum"),
            F.count(F.when(is_m, F.lit(1))).alias(f"{a}_buckets"),
        ]
    return st.groupBy("resource_id").agg(*aggs)


def resource_stats_at(
    points,
    as_ofs: Sequence,
    lookback: str = "1 day",
    period: str = "1 hour",
    metrics: Sequence[str] | str | None = None,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """MET-7 at many times (D14): the rows `resource_stat(metric_stats(points, as_of, lookback, period))` has for each
    of `as_ofs`, with that time as `as_of`.  One scan and one bucket aggregate of the whole span.

    Buckets don't depend on `as_of` where it and the lookback are multiples of
    the period (anything else is refused).  A resource's buckets get running
    totals, and a window's statistic is the total at its end less the one at
    its start; a time is matched with the last bucket before it, so nothing
    is repeated per time but one row per resource.  Totals are exact decimals,
    so differences are too.  A resource without buckets in a window has no
    row there.  A total of the whole span beyond 1e28 makes the statistic null.

    `points` is the raw point table or cells of it (`cells`, a store's cells).
    """
    step, back = seconds(period), seconds(lookback)
    ends = sorted({_epoch_seconds(a) for a in as_ofs})
    if not ends:
        raise ValueError("no time is given")
    if back % step or any(e % step for e in ends):
        raise ValueError(f"times and lookback must be multiples of {period!r}")
    whole = f"{int(ends[-1] - ends[0]) + back} seconds"
    if "cell_start" in points.columns:
        points = MetricCube(points, _moment(ends[-1]), int(ends[-1] - ends[0]) + back, step)
    b = metric_stats(points, _moment(ends[-1]), whole, period, metrics, keys)
    w = Window.partitionBy(*keys).orderBy("bucket_start")
    parts = {"n": F.lit(1)}
    for c in ("avg", "sum"):
        parts[f"{c}_total"] = F.coalesce(exact(c), F.lit(0).cast(MONEY))
        parts[f"{c}_fit"] = F.when(exact(c).isNotNull(), 1).otherwise(0)
        parts[f"{c}_all"] = F.when(finite(c).isNotNull(), 1).otherwise(0)
    running = [F.try_sum(v).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(k) for k, v in parts.items()]
    b = b.select(*keys, "bucket_start", F.lead("bucket_start").over(w).alias("next"), *running)
    # a mark is a window's end (+1) or start (-1); it takes the totals of the last bucket before it
    marks = [(e, e, 1) for e in ends] + [(e - back, e, -1) for e in ends]
    mark = F.array(*[
        F.struct(lit_ts(_moment(at)).alias("at"), lit_ts(_moment(e)).alias("as_of"), F.lit(sign).alias("sign"))
        for at, e, sign in marks
    ])
    here = F.filter(
        mark, lambda m: (m["at"] > F.col("bucket_start")) & (F.col("next").isNull() | (m["at"] <= F.col("next")))
    )
    m = b.select(*keys, *parts, F.inline(here))
    diffs = []
    for k in parts:
        # as a sum, since the difference of two decimals would lose the last of ten places
        signed = F.when(F.col("sign") == 1, F.col(k)).otherwise(-F.col(k))
        diffs.append(F.when(F.count(k) == F.count(F.lit(1)), F.try_sum(signed)).alias(k))
    d = m.groupBy(*keys, "as_of").agg(*diffs).where(F.col("n") > 0)

    def total(c: str) -> Column:
        return F.when((F.col(f"{c}_fit") == F.col(f"{c}_all")) & (F.col(f"{c}_all") > 0), F.col(f"{c}_total").cast("double"))

    return d.select(
        *keys,
        "as_of",
        F.try_divide(total("avg"), F.col("avg_all").cast("double")).alias("avg_of_avg"),
        total("sum").alias("total"),
        F.col("n").alias("buckets"),
    )
