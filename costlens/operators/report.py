"""The report's findings as a library call (ALR-2, ALR-3): which rules read which source.

`findings` takes the inventories and a metric cube, and compiles the rules of
the services asked for.  Inventories that belong together are joined with the
resources' statistics once per inventory; the statistics are aggregated once
from the cube and stored, as several inventories are joined with them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costlens.functions import lit_ts, whole_days_between
from costlens.operators import topology as TP
from costlens.operators.checks import aws as A
from costlens.operators.checks import gcp as G
from costlens.operators.findings import FINDING_SCHEMA
from costlens.operators.metrics import MetricCube, in_window, metric_stats, window_rows
from costlens.operators.rules import Rule, compile_rules, resource_stats, stat_columns
from costlens.session import scratch_table

GIB = float(2**30)

# The statistics that rules read.
STATS = (
    "cpu_avg", "cpu_max", "cpu_buckets", "mem_avg", "mem_max", "mem_buckets", "nin_total", "nin_max", "nout_total", "nout_max",
    "rdops_avg", "wrops_avg", "idle_total", "pod_total", "node_total", "req_total", "nat_out_total", "nat_in_total",
    "vpn_in_total", "vpn_out_total", "flow_total", "gcpu_avg7", "geg_sumavg7", "grd_total7", "gwr_total7",
    "keg_peak", "klog_peak", "kmon_peak", "veg_rate", "vin_rate",
)


def _metrics() -> dict[str, str]:
    """Prefix of the statistics -> metric; the clouds' names."""
    return {
        "cpu": "CPUUtilization", "mem": "MemoryUtilization", "nin": "NetworkIn", "nout": "NetworkOut",
        "rdops": "VolumeReadOps", "wrops": "VolumeWriteOps", "idle": "VolumeIdleTime",
        "pod": "pod_number", "node": "node_count", "req": "AllRequests",
        "nat_out": "BytesOutToDestination", "nat_in": "BytesInFromSource",
        "vpn_in": "TunnelDataIn", "vpn_out": "TunnelDataOut", "flow": "IncomingBytes",
        "pk_in": "PacketsIn", "pk_out": "PacketsOut",
        "gcpu": G.CPU_METRIC, "geg": G.EGRESS_METRIC, "grd": G.READ_METRIC, "gwr": G.WRITE_METRIC,
        "keg": "kubernetes.io/container/network/sent_bytes_count",
        "klog": "logging.googleapis.com/byte_count", "kmon": "monitoring.googleapis.com/billing/bytes_ingested",
        "veg": "networking.googleapis.com/vm_flow/egress_bytes_count",
        "vin": "networking.googleapis.com/vm_flow/ingress_bytes_count",
    }


def _limits() -> dict[str, float]:
    """Check -> limit; the checks' defaults (fixed values, as in the check functions)."""
    return {
        "CW-1": 100, "CW-2": 100, "CW-3": 100, "CW-4": 100, "CW-4 minutes": 60, "EC2-1": 20, "EC2-2": 2**30, "EC2-3": 180,
        "EC2-4a": 100, "EC2-4b": 500, "EC2-5": 180, "EKS-1": 20, "EKS-1 memory": 20, "EKS-2": 1e9, "EKS-6": 80, "EKS-7": 1e9,
        "EKS-9": 10000, "EKS-11": 43200, "S3-1": 30, "S3-2": 0, "S3-4": 1, "S3-5": 10000, "VPC-1": 1e9, "VPC-3": 1e6,
        "VPC-4": 1e6, "VPC-5": 100, "VPC-10a": 50, "VPC-10b": 10, "VPC-11": 10, "VPC-12": 1e9, "CFG-1": 10, "CFG-4": 30,
        "KMS-1": 5, "KMS-2": 10, "KMS-4": 1, "GCE-1": 0.1, "GCE-2": 0.5, "GCE-2 low": 0.1, "GCE-3": 100, "GCE-4": 1, "GCE-5": 10,
        "GKE-2": 0.5, "GKE-3": 0.2, "GKE-3 memory": 0.2, "GKE-4": 1e9, "GKE-5": 1e8, "NET-1": 1e9, "NET-2": 1e9, "NET-3": 300,
    }


@dataclass
class Setup:
    """`as_of` of the metrics and logs; dates of the inventories where they differ; metric names, limits, advisor phrase."""

    as_of: object
    dates: dict[str, object] = field(default_factory=dict)  # check -> as_of
    metrics: dict[str, str] = field(default_factory=_metrics)
    limits: dict[str, float] = field(default_factory=_limits)
    phrase: str = "Low Utilization Amazon EC2 Instances"

    def at(self, check: str):
        return self.dates.get(check, self.as_of)


def rules(s: Setup) -> list[Rule]:
    """All rules of the report."""
    lim, c = s.limits, F.col
    days = lambda col, check: whole_days_between(col, lit_ts(s.at(check)))
    ago = lambda col, check: c(col) < lit_ts(s.at(check)) - F.expr(f"INTERVAL {int(lim[check])} days")
    over = lambda col, check: c(col) > lim[check]
    zero = lambda col: F.coalesce(c(col), F.lit(0.0))
    hot_in, nin, nout = F.coalesce(over("nin_total", "EC2-2"), F.lit(False)), c("nin_total"), c("nout_total")
    idle = F.coalesce((c("rdops_avg") < lim["EC2-4a"]) & (c("wrops_avg") < lim["EC2-4a"]), F.lit(False))
    many_in = F.coalesce(F.size("ip_permissions") > lim["VPC-10a"], F.lit(False))
    wide = lambda col: F.exists(col, lambda p: F.size(p["ip_ranges"]) > lim["VPC-11"])
    cpu, disk = zero("gcpu_avg7"), (zero("grd_total7") + zero("gwr_total7")) / F.lit(GIB)
    unused = F.lit(True)
    for target in ("network_interface_id", "instance_id", "nat_gateway_id", "peering_id"):
        unused = unused & c(target).isNull()
    is_key = lambda kind: c("kind") == kind
    account = [
        Rule("account", A.CW, "CW-1", 1, F.lit("account"), is_key("CW-1") & over("n", "CW-1"), "n", lim["CW-1"]),
        Rule("account", A.CW, "CW-2", 2, F.lit("account"), is_key("CW-2") & over("n", "CW-2"), "n", lim["CW-2"]),
        Rule("account", A.VPC, "VPC-5", 5, F.lit("account"), is_key("VPC-5") & over("n", "VPC-5"), "n", lim["VPC-5"]),
        Rule("account", A.CFG, "CFG-1", 1, F.lit("account"), is_key("CFG-1") & over("n", "CFG-1"), "n", lim["CFG-1"]),
        Rule("account", A.KMS, "KMS-1", 1, F.lit("account"), is_key("KMS-1") & over("n", "KMS-1"), "n", lim["KMS-1"]),
        Rule("account", G.NET, "NET-3", 3, F.lit("project"), is_key("NET-3") & over("n", "NET-3"), "n", lim["NET-3"]),
    ]
    per_hour = c("req_total") / F.lit(24.0)
    resource = [
        Rule("resource", A.EC2, "EC2-1", 1, "resource_id", c("cpu_avg") < lim["EC2-1"], "cpu_avg", lim["EC2-1"]),
        Rule("resource", A.EC2, "EC2-2a", 2, "resource_id", hot_in, nin, lim["EC2-2"]),
        Rule("resource", A.EC2, "EC2-2b", 2, "resource_id", ~hot_in & (nout > lim["EC2-2"]), nout, lim["EC2-2"]),
        Rule("resource", A.EKS, "EKS-9", 9, "resource_id", over("pod_total", "EKS-9"), "pod_total", lim["EKS-9"]),
        Rule("resource", A.EKS, "EKS-9", 10, "resource_id", over("node_total", "EKS-9"), "node_total", lim["EKS-9"]),
        Rule("resource", A.S3, "S3-5", 5, "resource_id", per_hour > lim["S3-5"], per_hour, lim["S3-5"]),
        Rule("resource", G.GKE, "GKE-4", 4, "resource_id", over("keg_peak", "GKE-4"), "keg_peak", lim["GKE-4"]),
        Rule("resource", G.GKE, "GKE-5a", 5, "resource_id", over("klog_peak", "GKE-5"), "klog_peak", lim["GKE-5"]),
        Rule("resource", G.GKE, "GKE-5b", 5, "resource_id", over("kmon_peak", "GKE-5"), "kmon_peak", lim["GKE-5"]),
        Rule("resource", G.NET, "NET-1", 1, "resource_id", over("veg_rate", "NET-1"), "veg_rate", lim["NET-1"]),
        Rule("resource", G.NET, "NET-2", 2, "resource_id", over("vin_rate", "NET-2"), "vin_rate", lim["NET-2"]),
    ]
    there = c("resource_id").isNotNull()
    silent = (zero("cpu_buckets") == 0) | (zero("mem_buckets") == 0)
    moved = (nin > lim["EKS-2"]) | (nout > lim["EKS-2"])
    most, hourly = F.greatest("nin_total", "nout_total"), F.greatest("nin_max", "nout_max")
    calm = (c("cpu_avg") < lim["EKS-1"]) & (c("mem_avg") < lim["EKS-1 memory"])
    member = [
        Rule("member", A.EKS, "EKS-1", 1, "instance_id", there & calm, "cpu_avg", lim["EKS-1"]),
        Rule("member", A.EKS, "EKS-2", 2, "instance_id", there & moved, most, lim["EKS-2"]),
        Rule("member", A.EKS, "EKS-5", 5, "instance_id", silent),
        Rule("member", A.EKS, "EKS-6a", 6, "instance_id", over("cpu_max", "EKS-6"), "cpu_max", lim["EKS-6"]),
        Rule("member", A.EKS, "EKS-6b", 6, "instance_id", over("mem_max", "EKS-6"), "mem_max", lim["EKS-6"]),
        Rule("member", A.EKS, "EKS-7", 7, "instance_id", hourly > lim["EKS-7"], hourly, lim["EKS-7"]),
    ]
    nat, vpn = zero("nat_out_total") + zero("nat_in_total"), zero("vpn_in_total") + zero("vpn_out_total")
    ops = F.greatest("rdops_avg", "wrops_avg")
    stats = [
        Rule("volume", A.EC2, "EC2-4a", 4, "volume_id", idle, ops, lim["EC2-4a"]),
        Rule("volume", A.EC2, "EC2-4b", 4, "volume_id", ~idle & over("size_gb", "EC2-4b"), "size_gb", lim["EC2-4b"]),
        Rule("attached", A.EKS, "EKS-11", 11, "volume_id", over("idle_total", "EKS-11"), "idle_total", lim["EKS-11"]),
        Rule("nat", A.VPC, "VPC-1", 1, "gateway_id", nat < lim["VPC-1"], nat, lim["VPC-1"]),
        Rule("vpn", A.VPC, "VPC-3", 3, "gateway_id", vpn < lim["VPC-3"], vpn, lim["VPC-3"]),
        Rule("packets", A.VPC, "VPC-4a", 4, "rid", (c("metric") == s.metrics["pk_in"]) & over("sum", "VPC-4"), "sum", lim["VPC-4"]),
        Rule("packets", A.VPC, "VPC-4b", 4, "rid", (c("metric") == s.metrics["pk_out"]) & over("sum", "VPC-4"), "sum", lim["VPC-4"]),
        Rule("flow", A.VPC, "VPC-12", 12, "gateway_id", over("flow_total", "VPC-12"), "flow_total", lim["VPC-12"]),
        Rule("gcp_instance", G.GCE, "GCE-1", 1, "instance_id", cpu < lim["GCE-1"], cpu, lim["GCE-1"]),
        Rule("gcp_instance", G.GCE, "GCE-2", 2, "instance_id", ~(cpu < lim["GCE-2 low"]) & (cpu > lim["GCE-2"]) & c("preemptible"), cpu, lim["GCE-2"]),
        Rule("gcp_instance", G.GCE, "GCE-3", 3, "instance_id", c("geg_sumavg7") / F.lit(GIB) > lim["GCE-3"], c("geg_sumavg7") / F.lit(GIB), lim["GCE-3"]),
        Rule("gcp_instance", G.GCE, "GCE-4", 4, "instance_id", (c("status") == "RUNNING") & (disk < lim["GCE-4"]), disk, lim["GCE-4"]),
    ]
    use, memory = c("cpu_req_m") / c("cpu_cap_m"), c("mem_req_mib") / c("mem_cap_mib")
    open_ = c("cidr_block") == "0.0.0.0/0"
    loose = c("instance_id").isNull() & c("network_interface_id").isNull() & c("association_id").isNull()
    old_object = F.concat_ws("/", "bucket", "key", c("version_id").cast("string"))
    standard = F.coalesce(c("storage_class"), F.lit("STANDARD")) == "STANDARD"
    inventory = [
        Rule("log_group", A.CW, "CW-3", 3, "log_group", over("n", "CW-3"), "n", lim["CW-3"]),
        Rule("series", A.CW, "CW-4", 4, F.concat_ws("/", "namespace", "metric"), over("n", "CW-4"), "n", lim["CW-4"]),
        Rule("instance", A.EC2, "EC2-3", 3, "instance_id", ago("launch_time", "EC2-3"), days("launch_time", "EC2-3"), lim["EC2-3"]),
        Rule("snapshot", A.EC2, "EC2-5", 5, "snapshot_id", ago("start_time", "EC2-5"), days("start_time", "EC2-5"), lim["EC2-5"]),
        Rule("target", A.EKS, "EKS-3", 3, "target_id", c("instance_id").isNull()),
        Rule("target", A.EKS, "EKS-4", 4, "target_id", c("instance_id").isNotNull() & c("unhealthy")),
        Rule("cluster", A.EKS, "EKS-8", 8, "cluster", c("logged").isNull()),
        Rule("object", A.S3, "S3-1", 1, old_object, standard & (days("last_modified", "S3-1") > lim["S3-1"]), days("last_modified", "S3-1"), lim["S3-1"]),
        Rule("upload", A.S3, "S3-2", 2, "bucket", over("n", "S3-2"), "n", lim["S3-2"]),
        Rule("key", A.S3, "S3-4", 4, "key", over("buckets", "S3-4"), "buckets", lim["S3-4"]),
        Rule("address", A.VPC, "VPC-2", 2, "public_ip", loose),
        Rule("route", A.VPC, "VPC-6", 6, "rid", unused),
        Rule("route", A.VPC, "VPC-7", 7, "rid", c("state") == "blackhole"),
        Rule("acl", A.VPC, "VPC-8", 8, "rid", (c("rule_action") == "allow") & open_),
        Rule("acl", A.VPC, "VPC-9", 9, "rid", c("egress") & open_),
        Rule("group", A.VPC, "VPC-10a", 10, "group_id", many_in, F.size("ip_permissions"), lim["VPC-10a"]),
        Rule("group", A.VPC, "VPC-10b", 10, "group_id", ~many_in & (F.size("ip_permissions_egress") > lim["VPC-10b"]), F.size("ip_permissions_egress"), lim["VPC-10b"]),
        Rule("group", A.VPC, "VPC-11a", 11, "group_id", wide("ip_permissions"), None, lim["VPC-11"]),
        Rule("group", A.VPC, "VPC-11b", 11, "group_id", wide("ip_permissions_egress"), None, lim["VPC-11"]),
        Rule("config_rule", A.CFG, "CFG-2", 2, "rule_name", (c("owner") == "CUSTOM_LAMBDA") & c("failed").isNull(), F.lit(0.0), 0),
        Rule("recorder", A.CFG, "CFG-3", 3, "name", ~c("recording")),
        Rule("delivery", A.CFG, "CFG-4", 4, "channel", days("last_success", "CFG-4") > lim["CFG-4"], days("last_success", "CFG-4"), lim["CFG-4"]),
        Rule("operation", A.KMS, "KMS-2", 2, "event_name", over("n", "KMS-2"), "n", lim["KMS-2"]),
        Rule("rotation", A.KMS, "KMS-4", 4, "key_id", over("rotations", "KMS-4"), "rotations", lim["KMS-4"]),
        Rule("advised", A.EC2, "ADV-1", 1, "resource_id", F.lit(True)),
        Rule("gcp_snapshot", G.GCE, "GCE-5", 5, "snapshot_id", over("size_gb", "GCE-5"), "size_gb", lim["GCE-5"]),
        Rule("k8s_node", G.GKE, "GKE-2", 2, "node_name", c("cpu_req_m") < c("cpu_cap_m") * F.lit(lim["GKE-2"]), "cpu_req_m"),
        Rule("k8s_node", G.GKE, "GKE-3", 3, "node_name", c("large").isNotNull() & (use < lim["GKE-3"]) & (memory < lim["GKE-3 memory"]), use, lim["GKE-3"]),
    ]
    return [*account, *resource, *member, *stats, *inventory]


def sources(t, cube: MetricCube, s: Setup, services: Sequence[str]) -> dict[str, Callable[[], DataFrame]]:
    """How each source is built from the inventories `t` (their names are attributes, as in FIXTURES.md)."""
    kept: dict[str, DataFrame] = {}
    lim = s.limits

    def once(name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in kept:
            kept[name] = scratch_table(make(), f"report-{name}")
        return kept[name]

    def stats() -> DataFrame:
        kept = once("stats", lambda: resource_stats(cube, s.as_of, s.metrics.values()))
        return stat_columns(kept, s.metrics, STATS)

    def members() -> DataFrame:
        made = lambda: TP.cluster_instances(t.nodegroups, t.asg_members).select("cluster", "instance_id").distinct()
        return once("members", made)

    def joined(df: DataFrame, key: str, how: str = "left") -> DataFrame:
        return df.join(stats(), df[key] == F.col("resource_id"), how)

    def counts() -> DataFrame:
        """(kind, n): rows of the inventories that are judged by their number."""
        of = {
            A.CW: [("CW-1", lambda: t.metric_points.select("namespace", "metric", "resource_id").distinct()), ("CW-2", lambda: t.log_groups)],
            A.VPC: [("VPC-5", lambda: t.gateways)],
            A.CFG: [("CFG-1", lambda: t.recorders)],
            A.KMS: [("KMS-1", lambda: t.keys.select("key_id").distinct())],
            G.NET: [("NET-3", lambda: in_window(t.log_entries, s.as_of, "1 day"))],
        }
        parts = [make().agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n")) for v in services for kind, make in of.get(v, [])]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out

    def targets() -> DataFrame:
        """Targets with the cluster instance they are, if any; EKS-3 and EKS-4 read one join."""
        unhealthy = F.bool_or(F.coalesce(F.col("state") != "healthy", F.lit(False))).alias("unhealthy")
        each = t.lb_targets.groupBy("target_id").agg(unhealthy)
        inst = members().select("instance_id").distinct()
        return each.join(inst, each.target_id == inst.instance_id, "left")

    def clusters() -> DataFrame:
        name = F.regexp_extract("name", A.LOG_GROUP_CLUSTER, 1)
        logged = t.log_groups.select(name.alias("logged")).where("logged <> ''").distinct()
        each = t.nodegroups.select("cluster").distinct()
        return each.join(logged, each.cluster == logged.logged, "left")

    def packets() -> DataFrame:
        sums = metric_stats(cube, s.as_of, "1 day", "1 hour", [s.metrics["pk_in"], s.metrics["pk_out"]])
        vpns = t.gateways
        sums = sums.join(vpns, sums.resource_id == vpns.gateway_id, "left_semi")
        hour = F.date_format("bucket_start", "yyyy-MM-dd HH:mm")
        return sums.withColumn("rid", F.concat_ws(" ", F.col("resource_id").cast("string"), hour))

    def attached() -> DataFrame:
        inst = members().select("instance_id").distinct()
        volumes = TP.instance_volumes(t.instance_devices).join(inst, "instance_id", "left_semi").select("volume_id").distinct()
        return joined(volumes, "volume_id", "inner")

    def routes() -> DataFrame:
        rid = F.concat_ws(":", F.col("table_id").cast("string"), F.col("destination").cast("string"))
        return A._routes(t.route_tables).withColumn("rid", rid)

    def config_rules() -> DataFrame:
        bad = t.evaluations.where("compliance = 'NON_COMPLIANT'").select(F.col("rule_name").alias("failed")).distinct()
        each = t.rules
        return each.join(bad, each.rule_name == bad.failed, "left")

    def k8s_nodes() -> DataFrame:
        use = G.node_usage(t.nodes, t.pods)
        large = t.pools.where(F.col("machine_type").isin(G.HIGH_PERF_TYPES)).select("pool").distinct()
        of = G.node_pool(t.nodes, t.pools).join(large, "pool", "left_semi").select("node_name", F.col("pool").alias("large"))
        return use.join(of, "node_name", "left")

    def replicated() -> DataFrame:
        each = t.objects.select("key", "bucket").distinct()
        return each.groupBy("key").agg(F.count(F.lit(1)).alias("buckets"))

    def advised() -> DataFrame:
        first = t.advisor_checks.where(F.col("name").contains(s.phrase)).agg(F.min("check_id").alias("check_id"))
        return t.advisor_flagged.join(first, "check_id")

    number = F.count(F.lit(1)).alias("n")
    return {
        "account": counts,
        "resource": stats,
        "member": lambda: joined(members(), "instance_id"),
        "volume": lambda: joined(t.volumes, "volume_id"),
        "attached": attached,
        "nat": lambda: joined(t.gateways, "gateway_id"),
        "vpn": lambda: joined(t.gateways, "gateway_id"),
        "flow": lambda: joined(t.gateways, "gateway_id", "inner"),
        "packets": packets,
        "gcp_instance": lambda: joined(t.instances, "instance_id"),
        "log_group": lambda: t.log_streams.groupBy("log_group").agg(number),
        "series": lambda: window_rows(cube, s.as_of, f"{int(lim['CW-4 minutes'])} minutes", ["namespace", "metric"]),
        "instance": lambda: t.instances,
        "snapshot": lambda: t.snapshots,
        "gcp_snapshot": lambda: t.snapshots,
        "target": targets,
        "cluster": clusters,
        "object": lambda: t.objects,
        "upload": lambda: t.uploads.groupBy("bucket").agg(number),
        "key": replicated,
        "address": lambda: t.addresses,
        "route": routes,
        "acl": lambda: A._entries(t.acls),
        "group": lambda: t.security_groups,
        "config_rule": config_rules,
        "recorder": lambda: t.recorders,
        "delivery": lambda: t.deliveries,
        "operation": lambda: A.operation_counts(t.audit_events, s.as_of),
        "rotation": lambda: A.rotation_counts(t.audit_events, s.as_of),
        "advised": advised,
        "k8s_node": k8s_nodes,
    }


def findings(t, cube: MetricCube, setup: Setup, services: Sequence[str]) -> DataFrame:
    """The findings of the checks of `services` (canonical names), a branch per source."""
    asked = [r for r in rules(setup) if r.service in set(services)]
    if not asked:
        return cube.df.sparkSession.createDataFrame([], FINDING_SCHEMA)
    return compile_rules(sources(t, cube, setup, list(services)), asked)
