"""GCP resource checks: Compute Engine, Kubernetes Engine, Networking.

Same contract as the AWS checks: whole inventories in, all findings out,
metric names as parameters, the reference's constants as defaults.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costlens.functions import cpu_milli, mem_mib
from costlens.operators.findings import flag
from costlens.operators.metrics import align_rate, in_window, peak, per_resource

GCE, GKE, NET = "ComputeEngine", "KubernetesEngine", "Networking"
GIB = float(2**30)

# Machine types the reference treats as high-performance.
HIGH_PERF_TYPES = ["n1-highcpu-32", "n1-highmem-64", "n1-standard-64", "n1-ultramem-40", "n1-ultramem-80"]

CPU_METRIC = "compute.googleapis.com/instance/cpu/utilization"
EGRESS_METRIC = "compute.googleapis.com/instance/network/sent_bytes_count"
READ_METRIC = "compute.googleapis.com/instance/disk/read_bytes_count"
WRITE_METRIC = "compute.googleapis.com/instance/disk/write_bytes_count"


# ------------------------------------------------------------------ Compute Engine
def _cpu(instances: DataFrame, points: DataFrame, as_of, cpu_metric: str) -> DataFrame:
    s = per_resource(points, as_of, {cpu_metric: "cpu"}, lookback="7 days", period="1 hour")
    j = instances.join(s, instances.instance_id == s.resource_id, "left")
    return j.withColumn("cpu", F.coalesce(F.col("cpu_avg"), F.lit(0.0)))


def underutilized(instances: DataFrame, points: DataFrame, as_of, limit: float = 0.1,
                  cpu_metric: str = CPU_METRIC) -> DataFrame:
    """GCE-1: mean of hourly CPU over 7 days below `limit`; no data counts as 0."""
    j = _cpu(instances, points, as_of, cpu_metric).filter(F.col("cpu") < limit)
    return flag(j, GCE, "GCE-1", 1, "instance_id", "cpu", limit)


def overutilized_preemptible(instances: DataFrame, points: DataFrame, as_of, limit: float = 0.5,
                             low: float = 0.1, cpu_metric: str = CPU_METRIC) -> DataFrame:
    """GCE-2: preemptible instance with mean CPU > `limit` (only if not flagged by GCE-1)."""
    j = _cpu(instances, points, as_of, cpu_metric)
    j = j.filter(~(F.col("cpu") < low) & (F.col("cpu") > limit) & F.col("preemptible"))
    return flag(j, GCE, "GCE-2", 2, "instance_id", "cpu", limit)


def egress_gb(instances: DataFrame, points: DataFrame, as_of, gb: float = 100,
              metric: str = EGRESS_METRIC) -> DataFrame:
    """GCE-3: sum of hourly mean egress over 7 days, in GiB, above `gb`."""
    s = per_resource(points, as_of, {metric: "eg"}, lookback="7 days", period="1 hour")
    j = instances.join(s, instances.instance_id == s.resource_id).withColumn("gib", F.col("eg_sum_avg") / F.lit(GIB))
    return flag(j.filter(F.col("gib") > gb), GCE, "GCE-3", 3, "instance_id", "gib", gb)


def low_disk_io(instances: DataFrame, points: DataFrame, as_of, gb: float = 1,
                read_metric: str = READ_METRIC, write_metric: str = WRITE_METRIC) -> DataFrame:
    """GCE-4: RUNNING instance whose daily-summed read + write bytes over 7 days are below `gb` GiB."""
    s = per_resource(points, as_of, {read_metric: "rd", write_metric: "wr"}, lookback="7 days", period="1 day")
    run = instances.filter(F.col("status") == "RUNNING")
    j = run.join(s, run.instance_id == s.resource_id, "left").withColumn(
        "gib",
        (F.coalesce(F.col("rd_total"), F.lit(0.0)) + F.coalesce(F.col("wr_total"), F.lit(0.0))) / F.lit(GIB),
    )
    return flag(j.filter(F.col("gib") < gb), GCE, "GCE-4", 4, "instance_id", "gib", gb)


def large_snapshots(snapshots: DataFrame, gb: float = 10) -> DataFrame:
    """GCE-5: snapshots larger than `gb` GB."""
    return flag(snapshots.filter(F.col("size_gb") > gb), GCE, "GCE-5", 5, "snapshot_id", "size_gb", gb)


# ------------------------------------------------------------------ Kubernetes Engine
def node_usage(nodes: DataFrame, pods: DataFrame) -> DataFrame:
    """GKE-1: node capacity and the sum of its pods' container requests
    (milli-cores, MiB); zero when a node has no pods.  Containers without
    requests contribute nothing."""
    req = (
        pods.select("node_name", F.explode("containers").alias("c"))
        .select("node_name", cpu_milli("c.requests.cpu").alias("cpu_m"), mem_mib("c.requests.memory").alias("mem_mib"))
        .groupBy("node_name")
        .agg(F.sum("cpu_m").alias("cpu_req_m"), F.sum("mem_mib").alias("mem_req_mib"))
    )
    cap = nodes.select("node_name", cpu_milli("cpu").alias("cpu_cap_m"), mem_mib("memory").alias("mem_cap_mib"))
    return cap.join(req, "node_name", "left").select(
        "node_name",
        "cpu_cap_m",
        "mem_cap_mib",
        F.coalesce("cpu_req_m", F.lit(0.0)).alias("cpu_req_m"),
        F.coalesce("mem_req_mib", F.lit(0.0)).alias("mem_req_mib"),
    )


def overprovisioned_nodes(usage: DataFrame, ratio: float = 0.5) -> DataFrame:
    """GKE-2: node whose cpu requests are below `ratio` of its capacity (both milli-cores, D13)."""
    u = usage.filter(F.col("cpu_req_m") < F.col("cpu_cap_m") * F.lit(ratio))
    return flag(u, GKE, "GKE-2", 2, "node_name", "cpu_req_m", None)


def node_pool(nodes: DataFrame, pools: DataFrame) -> DataFrame:
    """Match each node to the node pool whose name is its longest prefix.

    Every prefix of a node name is generated (names are short, so this is a
    bounded per-row explode) and equi-joined with the pool names; the longest
    match per node wins.  No theta join and no broadcast of an unbounded side."""
    prefixes = nodes.select(
        "node_name",
        F.explode(F.expr("transform(sequence(1, length(node_name)), i -> substr(node_name, 1, i))")).alias("pool"),
    )
    names = pools.select("pool").distinct()
    m = prefixes.join(names, "pool")
    best = m.groupBy("node_name").agg(F.max_by("pool", F.length("pool")).alias("pool"))
    return best


def idle_large_nodes(nodes: DataFrame, pools: DataFrame, usage: DataFrame,
                     types: Sequence[str] = tuple(HIGH_PERF_TYPES), limit: float = 0.2,
                     mem_limit: float | None = None) -> DataFrame:
    """GKE-3: node of a high-performance pool with cpu use below `limit` and
    memory use below `mem_limit` (default: the same limit)."""
    best = node_pool(nodes, pools)
    hp = pools.filter(F.col("machine_type").isin(list(types))).select("pool").distinct()
    j = best.join(hp, "pool", "left_semi").join(usage, "node_name")
    j = j.withColumn("cpu_use", F.col("cpu_req_m") / F.col("cpu_cap_m")).withColumn(
        "mem_use", F.col("mem_req_mib") / F.col("mem_cap_mib")
    )
    mem_limit = limit if mem_limit is None else mem_limit
    j = j.filter((F.col("cpu_use") < limit) & (F.col("mem_use") < mem_limit))
    return flag(j, GKE, "GKE-3", 3, "node_name", "cpu_use", limit)


def _any_point_over(points, as_of, metric, limit, check, rank, service=GKE):
    p = peak(points, as_of, "1 day", [metric])
    return flag(p.filter(F.col("peak") > limit), service, check, rank, "resource_id", "peak", limit)


def cluster_egress(points: DataFrame, as_of, limit: float = 1e9,
                   metric: str = "kubernetes.io/container/network/sent_bytes_count") -> DataFrame:
    """GKE-4: cluster with any egress point above `limit` in the last day."""
    return _any_point_over(points, as_of, metric, limit, "GKE-4", 4)


def cluster_logging(points: DataFrame, as_of, limit: float = 1e8,
                    log_metric: str = "logging.googleapis.com/byte_count",
                    mon_metric: str = "monitoring.googleapis.com/billing/bytes_ingested") -> DataFrame:
    """GKE-5: cluster with any log-bytes point, or any monitoring-bytes point, above `limit`."""
    return _any_point_over(points, as_of, log_metric, limit, "GKE-5a", 5).unionByName(
        _any_point_over(points, as_of, mon_metric, limit, "GKE-5b", 5)
    )


# ------------------------------------------------------------------ Networking
def _rate_over(points, as_of, metric, limit, check, rank):
    r = align_rate(points, as_of, "1 day", 300, [metric]).groupBy("resource_id").agg(F.max("rate").alias("peak"))
    return flag(r.filter(F.col("peak") > limit), NET, check, rank, "resource_id", "peak", limit)


def egress_rate(points: DataFrame, as_of, limit: float = 1e9,
                metric: str = "networking.googleapis.com/vm_flow/egress_bytes_count") -> DataFrame:
    """NET-1: any 300 s egress rate above `limit` (bytes/s), per resource."""
    return _rate_over(points, as_of, metric, limit, "NET-1", 1)


def ingress_rate(points: DataFrame, as_of, limit: float = 1e9,
                 metric: str = "networking.googleapis.com/vm_flow/ingress_bytes_count") -> DataFrame:
    """NET-2: any 300 s ingress rate above `limit` (bytes/s), per resource."""
    return _rate_over(points, as_of, metric, limit, "NET-2", 2)


def log_counts(log_entries: DataFrame, as_of, lookback: str = "1 day") -> DataFrame:
    """NET-3 (counts): entries per log name in the window."""
    return in_window(log_entries, as_of, lookback).groupBy("log_name").agg(F.count(F.lit(1)).alias("n"))


def excessive_logging(log_entries: DataFrame, as_of, limit: int = 300, lookback: str = "1 day") -> DataFrame:
    """NET-3: more than `limit` log entries in the window (one finding)."""
    t = log_counts(log_entries, as_of, lookback).agg(F.sum("n").alias("total")).filter(F.col("total") > limit)
    return flag(t, NET, "NET-3", 3, F.lit("project"), "total", limit)
