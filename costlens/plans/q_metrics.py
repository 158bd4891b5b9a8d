"""Registered queries: metric aggregation (MET-1..7) and topology joins (TOP-1..3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from costlens.operators import metrics as M
from costlens.operators import topology as TP
from costlens.plans.registry import davg_, dsum_, query, ts_
from costlens.plans.sqlparts import stats_sql, window_sql
from costlens.session import scratch_folder
from costlens.sources.fixtures import Tables

# The metric fixture covers 2024-01-01 .. 2024-01-30; "now" is the day after.
AS_OF = "2024-01-31 00:00:00"


def _stats_out(sql: str) -> str:
    return (
        f"select namespace, metric, resource_id, {ts_('bucket_start')} as bucket_start, sum, avg, cnt "
        f"from ({sql}) s"
    )


@query("met1_hourly_stats", "MET-1", ["metric_points"], _stats_out(stats_sql(AS_OF, "1 day", "1 hour")))
def met1_hourly_stats(spark, sf_dir):
    """Hourly sum / average / count per metric and resource over the last day."""
    return M.metric_stats(Tables(spark, sf_dir).metric_points, AS_OF, "1 day", "1 hour")


@query("met2_daily_buckets_last_hour", "MET-2", ["metric_points"], _stats_out(stats_sql(AS_OF, "60 minutes", "1 day")))
def met2_daily_buckets_last_hour(spark, sf_dir):
    """1-day buckets over the last 60 minutes."""
    return M.metric_stats(Tables(spark, sf_dir).metric_points, AS_OF, "60 minutes", "1 day")


@query(
    "met3_align_mean",
    "MET-3",
    ["metric_points"],
    f"select namespace, metric, resource_id, {ts_('bucket_start')} as bucket_start, avg "
    f"from ({stats_sql(AS_OF, '7 days', '1 hour')}) s",
)
def met3_align_mean(spark, sf_dir):
    """Hourly means over 7 days."""
    return M.align_mean(Tables(spark, sf_dir).metric_points, AS_OF)


@query(
    "met4_align_sum",
    "MET-4",
    ["metric_points"],
    f"select namespace, metric, resource_id, {ts_('bucket_start')} as bucket_start, sum "
    f"from ({stats_sql(AS_OF, '7 days', '1 day')}) s",
)
def met4_align_sum(spark, sf_dir):
    """Daily sums over 7 days."""
    return M.align_sum(Tables(spark, sf_dir).metric_points, AS_OF)


@query(
    "met5_align_rate",
    "MET-5",
    ["metric_points"],
    f"select namespace, metric, resource_id, {ts_('bucket_start')} as bucket_start, sum / 300.0 as rate "
    f"from ({stats_sql(AS_OF, '1 day', '300 seconds')}) s",
)
def met5_align_rate(spark, sf_dir):
    """Per-second rates in 300 s buckets over 1 day."""
    return M.align_rate(Tables(spark, sf_dir).metric_points, AS_OF)


@query(
    "met6_raw_points",
    "MET-6",
    ["metric_points"],
    f"select namespace, metric, resource_id, {ts_('ts')} as ts, value from metric_points "
    f"where {window_sql(AS_OF, '1 day')} and metric = 'signup'",
)
def met6_raw_points(spark, sf_dir):
    """Raw points of one metric in the last day."""
    return M.raw_points(Tables(spark, sf_dir).metric_points, AS_OF, "1 day", ["signup"])


@query(
    "met7_resource_stat",
    "MET-7",
    ["metric_points"],
    f"select namespace, metric, resource_id, {davg_('avg')} as avg_of_avg, {dsum_('sum')} as total, "
    f"count(*) as buckets from ({stats_sql(AS_OF, '1 day', '1 hour')}) s group by namespace, metric, resource_id",
)
def met7_resource_stat(spark, sf_dir):
    """Average of hourly averages and total of hourly sums per resource."""
    return M.resource_stat(M.metric_stats(Tables(spark, sf_dir).metric_points, AS_OF))


# Two reports from one store: the second adds a day; its time cuts a cell in two.
STORE_TIMES = ("2024-01-29 00:00:00", "2024-01-30 13:07:00")


@query(
    "met1_kept_cells",
    "MET-1 MET-2 MET-3 MET-4",
    ["metric_points"],
    " union all ".join(
        f"select '{t}' as as_of, namespace, metric, resource_id, {ts_('bucket_start')} as bucket_start, sum, avg, cnt "
        f"from ({stats_sql(t, '7 days', '1 hour')}) s{i}"
        for i, t in enumerate(STORE_TIMES)
    ),
)
def met1_kept_cells(spark, sf_dir):
    """Hourly statistics of 7 days at two times, from cells that are kept by day."""
    points = Tables(spark, sf_dir).metric_points
    store = M.CellStore(spark, scratch_folder(spark, "cells"))
    parts = []
    for t in STORE_TIMES:
        store.add(points, t)
        stats = M.metric_stats(store.cube(points, t), t, "7 days", "1 hour")
        parts.append(stats.select(F.lit(t).alias("as_of"), "*"))
    return parts[0].unionByName(parts[1])


WEEK = [f"2024-01-{d} 00:00:00" for d in range(25, 32)]


@query(
    "met7_week_of_reports",
    "MET-1 MET-7",
    ["metric_points"],
    " union all ".join(
        f"select namespace, metric, resource_id, '{t}.000000' as as_of, {davg_('avg')} as avg_of_avg, {dsum_('sum')} as total, "
        f"count(*) as buckets from ({stats_sql(t, '2 days', '1 hour')}) s{i} group by namespace, metric, resource_id"
        for i, t in enumerate(WEEK)
    ),
)
def met7_week_of_reports(spark, sf_dir):
    """Statistics per resource of the two days before each of seven report times, in one pass."""
    return M.resource_stats_at(Tables(spark, sf_dir).metric_points, WEEK, "2 days", "1 hour")


@query(
    "top1_cluster_instances",
    "TOP-1",
    ["topology"],
    "select cluster, nodegroup, asg, instance_id from topology",
)
def top1_cluster_instances(spark, sf_dir):
    """Cluster -> nodegroup -> first scaling group -> instances, as joins."""
    t = Tables(spark, sf_dir)
    return TP.cluster_instances(t.nodegroups, t.asg_members)


@query("top2_instance_volumes", "TOP-2", ["volumes"], "select instance_id, volume_id from volumes")
def top2_instance_volumes(spark, sf_dir):
    """Instance -> attached volumes, by exploding block-device mappings."""
    return TP.instance_volumes(Tables(spark, sf_dir).instance_devices)


@query(
    "top3_flatten_instances",
    "TOP-3",
    ["instances"],
    f"select cast(floor(instance_id / 10) as bigint) as reservation_id, instance_id, "
    f"{ts_('launch_time')} as launch_time, status, preemptible from instances",
)
def top3_flatten_instances(spark, sf_dir):
    """Reservations[].instances[] flattened to one row per instance."""
    return TP.flatten_instances(Tables(spark, sf_dir).reservations)
