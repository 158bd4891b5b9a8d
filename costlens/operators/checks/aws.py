"""AWS resource checks: CloudWatch, EC2, EKS, S3, VPC, Config, KMS, Advisor.

Each check takes whole inventories / metric tables and returns *all* findings
(D9, D10).  Metric names default to the cloud's names and are parameters, so
exported tables with other names (or test stand-ins) plug in unchanged.
Limits default to the reference's constants; comparisons are strict.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costlens.functions import dsum, lit_ts, whole_days_between
from costlens.operators.findings import flag
from costlens.operators.metrics import in_window, metric_stats, per_resource, window_rows

CW, EC2, EKS, S3, VPC, CFG, KMS = (
    "AmazonCloudWatch",
    "AmazonEC2",
    "AmazonEKS",
    "AmazonS3",
    "AmazonVPC",
    "AWSConfig",
    "AWSKMS",
)


def _count_over(df: DataFrame, limit) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit)


def _days_ago(as_of, days: int):
    return lit_ts(as_of) - F.expr(f"INTERVAL {int(days)} days")


# ------------------------------------------------------------------ CloudWatch
def excessive_metrics(metric_list: DataFrame, limit: int = 100) -> DataFrame:
    """CW-1: more than `limit` listed metrics (one account-level finding)."""
    return flag(_count_over(metric_list, limit), CW, "CW-1", 1, F.lit("account"), "n", limit)


def excessive_log_groups(log_groups: DataFrame, limit: int = 100) -> DataFrame:
    """CW-2: more than `limit` log groups."""
    return flag(_count_over(log_groups, limit), CW, "CW-2", 2, F.lit("account"), "n", limit)


def excessive_log_streams(log_streams: DataFrame, limit: int = 100) -> DataFrame:
    """CW-3: log groups holding more than `limit` streams, per group."""
    g = log_streams.groupBy("log_group").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit)
    return flag(g, CW, "CW-3", 3, "log_group", "n", limit)


def high_data_points(points: DataFrame, as_of, minutes: int = 60, limit: int = 100) -> DataFrame:
    """CW-4: metrics with more than `limit` raw datapoints in the last `minutes` (D12)."""
    g = window_rows(points, as_of, f"{int(minutes)} minutes", ["namespace", "metric"]).filter(F.col("n") > limit)
    return flag(g, CW, "CW-4", 4, F.concat_ws("/", "namespace", "metric"), "n", limit)


# ------------------------------------------------------------------ EC2
def low_cpu(points: DataFrame, as_of, limit: float = 20, cpu_metric: str = "CPUUtilization") -> DataFrame:
    """EC2-1: average of hourly CPU averages over 1 day below `limit`.
    Instances without datapoints are not judged."""
    s = per_resource(points, as_of, {cpu_metric: "cpu"}).filter(F.col("cpu_avg") < limit)
    return flag(s, EC2, "EC2-1", 1, "resource_id", "cpu_avg", limit)


def high_transfer(
    points: DataFrame,
    as_of,
    limit: float = 2**30,
    in_metric: str = "NetworkIn",
    out_metric: str = "NetworkOut",
) -> DataFrame:
    """EC2-2: total NetworkIn over 1 day > limit, else total NetworkOut > limit."""
    s = per_resource(points, as_of, {in_metric: "nin", out_metric: "nout"})
    inbound = s.filter(F.col("nin_total") > limit)
    outbound = s.filter(~(F.coalesce(F.col("nin_total") > limit, F.lit(False))) & (F.col("nout_total") > limit))
    return flag(inbound, EC2, "EC2-2a", 2, "resource_id", "nin_total", limit).unionByName(
        flag(outbound, EC2, "EC2-2b", 2, "resource_id", "nout_total", limit)
    )


def old_instances(instances: DataFrame, as_of, days: int = 180) -> DataFrame:
    """EC2-3: launched more than `days` days before `as_of`."""
    d = instances.filter(F.col("launch_time") < _days_ago(as_of, days)).withColumn(
        "age_days", whole_days_between("launch_time", lit_ts(as_of))
    )
    return flag(d, EC2, "EC2-3", 3, "instance_id", "age_days", days)


def unoptimized_volumes(
    volumes: DataFrame,
    points: DataFrame,
    as_of,
    ops: float = 100,
    size: int = 500,
    read_metric: str = "VolumeReadOps",
    write_metric: str = "VolumeWriteOps",
) -> DataFrame:
    """EC2-4: avg read ops < ops and avg write ops < ops (a, observed: the larger of both), else size > `size` GB (b)."""
    s = per_resource(points, as_of, {read_metric: "rd", write_metric: "wr"})
    v = volumes.join(s, volumes.volume_id == s.resource_id, "left")
    idle = F.coalesce((F.col("rd_avg") < ops) & (F.col("wr_avg") < ops), F.lit(False))
    low = v.filter(idle).withColumn("ops", F.greatest("rd_avg", "wr_avg"))
    return flag(low, EC2, "EC2-4a", 4, "volume_id", "ops", ops).unionByName(
        flag(v.filter(~idle & (F.col("size_gb") > size)), EC2, "EC2-4b", 4, "volume_id", "size_gb", size)
    )


def old_snapshots(snapshots: DataFrame, as_of, days: int = 180) -> DataFrame:
    """EC2-5: snapshot started more than `days` days before `as_of`."""
    d = snapshots.filter(F.col("start_time") < _days_ago(as_of, days)).withColumn(
        "age_days", whole_days_between("start_time", lit_ts(as_of))
    )
    return flag(d, EC2, "EC2-5", 5, "snapshot_id", "age_days", days)


# ------------------------------------------------------------------ EKS
def _member_stats(members: DataFrame, points: DataFrame, as_of, metric_alias: dict, how: str = "inner"):
    inst = members.select("cluster", "instance_id").distinct()
    s = per_resource(points, as_of, metric_alias)
    return inst.join(s, inst.instance_id == s.resource_id, how)


def idle_cluster_instances(
    members: DataFrame,
    points: DataFrame,
    as_of,
    cpu: float = 20,
    mem: float = 20,
    cpu_metric: str = "CPUUtilization",
    mem_metric: str = "MemoryUtilization",
) -> DataFrame:
    """EKS-1: cluster instance with average CPU < cpu and average memory < mem (both present)."""
    j = _member_stats(members, points, as_of, {cpu_metric: "cpu", mem_metric: "mem"})
    j = j.filter((F.col("cpu_avg") < cpu) & (F.col("mem_avg") < mem))
    return flag(j, EKS, "EKS-1", 1, "instance_id", "cpu_avg", cpu)


def cluster_transfer(
    members: DataFrame,
    points: DataFrame,
    as_of,
    limit: float = 1e9,
    in_metric: str = "NetworkIn",
    out_metric: str = "NetworkOut",
) -> DataFrame:
    """EKS-2: cluster instance with total in or total out over 1 day > limit."""
    j = _member_stats(members, points, as_of, {in_metric: "nin", out_metric: "nout"})
    j = j.filter((F.col("nin_total") > limit) | (F.col("nout_total") > limit)).withColumn(
        "peak", F.greatest("nin_total", "nout_total")
    )
    return flag(j, EKS, "EKS-2", 2, "instance_id", "peak", limit)


def foreign_targets(members: DataFrame, targets: DataFrame) -> DataFrame:
    """EKS-3: load-balancer targets that belong to no cluster (left anti join)."""
    inst = members.select("instance_id").distinct()
    t = targets.select("target_id").distinct()
    j = t.join(inst, t.target_id == inst.instance_id, "left_anti")
    return flag(j, EKS, "EKS-3", 3, "target_id")


def unhealthy_targets(members: DataFrame, targets: DataFrame) -> DataFrame:
    """EKS-4: cluster member registered as a target in a state other than healthy."""
    inst = members.select("instance_id").distinct()
    t = targets.filter(F.col("state") != "healthy").select("target_id").distinct()
    j = t.join(inst, t.target_id == inst.instance_id, "left_semi")
    return flag(j, EKS, "EKS-4", 4, "target_id")


def unmonitored(
    members: DataFrame,
    points: DataFrame,
    as_of,
    cpu_metric: str = "CPUUtilization",
    mem_metric: str = "MemoryUtilization",
) -> DataFrame:
    """EKS-5: cluster instance with no CPU or no memory datapoints in the last day."""
    j = _member_stats(members, points, as_of, {cpu_metric: "cpu", mem_metric: "mem"}, "left")
    j = j.filter((F.coalesce("cpu_buckets", F.lit(0)) == 0) | (F.coalesce("mem_buckets", F.lit(0)) == 0))
    return flag(j, EKS, "EKS-5", 5, "instance_id")


def overutilized(
    members: DataFrame,
    points: DataFrame,
    as_of,
    limit: float = 80,
    cpu_metric: str = "CPUUtilization",
    mem_metric: str = "MemoryUtilization",
) -> DataFrame:
    """EKS-6: any hourly CPU average > limit; any hourly memory average > limit."""
    j = _member_stats(members, points, as_of, {cpu_metric: "cpu", mem_metric: "mem"})
    return flag(j.filter(F.col("cpu_max") > limit), EKS, "EKS-6a", 6, "instance_id", "cpu_max", limit).unionByName(
        flag(j.filter(F.col("mem_max") > limit), EKS, "EKS-6b", 6, "instance_id", "mem_max", limit)
    )


def hourly_transfer(
    members: DataFrame,
    points: DataFrame,
    as_of,
    limit: float = 1e9,
    in_metric: str = "NetworkIn",
    out_metric: str = "NetworkOut",
) -> DataFrame:
    """EKS-7: any hourly average network in or out > limit."""
    j = _member_stats(members, points, as_of, {in_metric: "nin", out_metric: "nout"})
    j = j.withColumn("peak", F.greatest("nin_max", "nout_max")).filter(F.col("peak") > limit)
    return flag(j, EKS, "EKS-7", 7, "instance_id", "peak", limit)


LOG_GROUP_CLUSTER = r"^/aws/eks/([^/]+)/cluster"


def missing_cluster_logs(clusters: DataFrame, log_groups: DataFrame) -> DataFrame:
    """EKS-8: cluster with no log group named `/aws/eks/<cluster>/cluster...`.

    Cluster names contain no `/`, so the prefix test is an equi-join on the
    name segment extracted from each log group — no theta join, no broadcast."""
    lg = log_groups.select(F.regexp_extract("name", LOG_GROUP_CLUSTER, 1).alias("lg_cluster")).filter(
        F.col("lg_cluster") != ""
    )
    c = clusters.select("cluster").distinct()
    j = c.join(lg, c.cluster == lg.lg_cluster, "left_anti")
    return flag(j, EKS, "EKS-8", 8, "cluster")


def cluster_counts(
    points: DataFrame,
    as_of,
    limit: float = 10000,
    pod_metric: str = "pod_number",
    node_metric: str = "node_count",
) -> DataFrame:
    """EKS-9: per cluster, podCount or nodeCount total over 1 day > limit."""
    s = per_resource(points, as_of, {pod_metric: "pod", node_metric: "node"})
    return flag(s.filter(F.col("pod_total") > limit), EKS, "EKS-9", 9, "resource_id", "pod_total", limit).unionByName(
        flag(s.filter(F.col("node_total") > limit), EKS, "EKS-9", 10, "resource_id", "node_total", limit)
    )


def volume_totals(
    points: DataFrame,
    as_of,
    read_metric: str = "VolumeReadBytes",
    write_metric: str = "VolumeWriteBytes",
    idle_metric: str = "VolumeIdleTime",
) -> DataFrame:
    """EKS-10: per volume, totals over 1 day of read bytes, write bytes, idle time."""
    s = metric_stats(points, as_of, "1 day", "1 hour", [read_metric, write_metric, idle_metric])
    tot = lambda m: dsum(F.when(F.col("metric") == m, F.col("sum")))
    return s.groupBy(F.col("resource_id").alias("volume_id")).agg(
        tot(read_metric).alias("read_bytes"), tot(write_metric).alias("write_bytes"), tot(idle_metric).alias("idle_time")
    )


def idle_volumes(
    members: DataFrame,
    attached: DataFrame,
    points: DataFrame,
    as_of,
    seconds: float = 43200,
    **metric_names,
) -> DataFrame:
    """EKS-11: volumes of cluster instances idle for more than `seconds` over 1 day.
    `attached` is TOP-2's (instance_id, volume_id)."""
    inst = members.select("instance_id").distinct()
    vols = attached.join(inst, "instance_id", "left_semi").select("volume_id").distinct()
    j = vols.join(volume_totals(points, as_of, **metric_names), "volume_id").filter(F.col("idle_time") > seconds)
    return flag(j, EKS, "EKS-11", 11, "volume_id", "idle_time", seconds)


# ------------------------------------------------------------------ S3
def stale_objects(objects: DataFrame, as_of, days: int = 30) -> DataFrame:
    """S3-1: STANDARD object (missing class = STANDARD) unmodified for more than `days` whole days."""
    age = whole_days_between("last_modified", lit_ts(as_of))
    o = objects.filter(F.coalesce(F.col("storage_class"), F.lit("STANDARD")) == "STANDARD").withColumn("age", age)
    o = o.filter(F.col("age") > days).withColumn("rid", F.concat_ws("/", "bucket", "key", F.col("version_id").cast("string")))
    return flag(o, S3, "S3-1", 1, "rid", "age", days)


def incomplete_uploads(uploads: DataFrame) -> DataFrame:
    """S3-2: buckets with any incomplete multipart upload."""
    g = uploads.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    return flag(g, S3, "S3-2", 2, "bucket", "n", 0)


def object_versions(objects: DataFrame) -> DataFrame:
    """S3-3: version listing per bucket and key."""
    return objects.groupBy("bucket", "key").agg(
        F.count(F.lit(1)).alias("versions"),
        F.sum("size").alias("total_size"),
        F.max(F.when(F.col("is_latest"), F.col("version_id"))).alias("latest_version"),
    )


def replicated_keys(objects: DataFrame, limit: int = 1) -> DataFrame:
    """S3-4: keys present in more than `limit` buckets.  Two-phase distinct:
    (key, bucket) pairs are deduplicated map-side first, so a hot key costs
    one row per bucket, not one per version."""
    kb = objects.select("key", "bucket").distinct()
    g = kb.groupBy("key").agg(F.count(F.lit(1)).alias("buckets")).filter(F.col("buckets") > limit)
    return flag(g, S3, "S3-4", 4, "key", "buckets", limit)


def excessive_requests(points: DataFrame, as_of, per_hour: float = 10000, metric: str = "AllRequests") -> DataFrame:
    """S3-5: 24-hour request total / 24 > `per_hour`, per bucket."""
    s = per_resource(points, as_of, {metric: "req"}).withColumn("per_hour", F.col("req_total") / F.lit(24.0))
    return flag(s.filter(F.col("per_hour") > per_hour), S3, "S3-5", 5, "resource_id", "per_hour", per_hour)


def log_stats(objects: DataFrame) -> DataFrame:
    """S3-6: total size and count of (log) objects, per bucket."""
    return objects.groupBy("bucket").agg(F.sum("size").alias("total_size"), F.count(F.lit(1)).alias("files"))


# ------------------------------------------------------------------ VPC
def _idle_by_total(resources: DataFrame, id_col: str, points: DataFrame, as_of, metrics, limit, check, rank):
    s = per_resource(points, as_of, {m: f"m{i}" for i, m in enumerate(metrics)})
    total = None
    for i in range(len(metrics)):
        t = F.coalesce(F.col(f"m{i}_total"), F.lit(0.0))
        total = t if total is None else total + t
    j = resources.join(s, resources[id_col] == s.resource_id, "left").withColumn("traffic", total)
    return flag(j.filter(F.col("traffic") < limit), VPC, check, rank, id_col, "traffic", limit)


def idle_nat(gateways: DataFrame, points: DataFrame, as_of, limit: float = 1e9,
             metrics: Sequence[str] = ("BytesOutToDestination", "BytesInFromSource")) -> DataFrame:
    """VPC-1: NAT gateway whose total traffic over 1 day is below `limit`."""
    return _idle_by_total(gateways, "gateway_id", points, as_of, list(metrics), limit, "VPC-1", 1)


def unused_addresses(addresses: DataFrame) -> DataFrame:
    """VPC-2: elastic IPs with no instance, no interface and no association."""
    a = addresses.filter(
        F.col("instance_id").isNull() & F.col("network_interface_id").isNull() & F.col("association_id").isNull()
    )
    return flag(a, VPC, "VPC-2", 2, "public_ip")


def idle_vpn(vpns: DataFrame, points: DataFrame, as_of, limit: float = 1e6,
             metrics: Sequence[str] = ("TunnelDataIn", "TunnelDataOut")) -> DataFrame:
    """VPC-3: VPN connection whose tunnel bytes over 1 day are below `limit`."""
    return _idle_by_total(vpns, "gateway_id", points, as_of, list(metrics), limit, "VPC-3", 3)


def vpn_packets(vpns: DataFrame, points: DataFrame, as_of, limit: float = 1e6,
                in_metric: str = "PacketsIn", out_metric: str = "PacketsOut") -> DataFrame:
    """VPC-4: hourly packet sums in or out above `limit`; one finding per bucket."""
    s = metric_stats(points, as_of, "1 day", "1 hour", [in_metric, out_metric])
    s = s.join(vpns, s.resource_id == vpns.gateway_id, "left_semi").filter(F.col("sum") > limit)
    rid = F.concat_ws(" ", F.col("resource_id").cast("string"), F.date_format("bucket_start", "yyyy-MM-dd HH:mm"))
    s = s.withColumn("rid", rid)
    return flag(s.filter(F.col("metric") == in_metric), VPC, "VPC-4a", 4, "rid", "sum", limit).unionByName(
        flag(s.filter(F.col("metric") == out_metric), VPC, "VPC-4b", 4, "rid", "sum", limit)
    )


def many_endpoints(endpoints: DataFrame, limit: int = 100) -> DataFrame:
    """VPC-5: more than `limit` endpoints."""
    return flag(_count_over(endpoints, limit), VPC, "VPC-5", 5, F.lit("account"), "n", limit)


def _routes(route_tables: DataFrame) -> DataFrame:
    return route_tables.select("table_id", F.posexplode("routes").alias("pos", "r")).select("table_id", "pos", "r.*")


def unused_routes(route_tables: DataFrame) -> DataFrame:
    """VPC-6: route with no interface, instance, NAT or peering target."""
    r = _routes(route_tables).filter(
        F.col("network_interface_id").isNull()
        & F.col("instance_id").isNull()
        & F.col("nat_gateway_id").isNull()
        & F.col("peering_id").isNull()
    )
    rid = F.concat_ws(":", F.col("table_id").cast("string"), F.col("destination").cast("string"))
    return flag(r.withColumn("rid", rid), VPC, "VPC-6", 6, "rid")


def blackhole_routes(route_tables: DataFrame) -> DataFrame:
    """VPC-7: routes in state `blackhole`."""
    r = _routes(route_tables).filter(F.col("state") == "blackhole")
    rid = F.concat_ws(":", F.col("table_id").cast("string"), F.col("destination").cast("string"))
    return flag(r.withColumn("rid", rid), VPC, "VPC-7", 7, "rid")


def _entries(acls: DataFrame) -> DataFrame:
    return acls.select("acl_id", F.explode("entries").alias("e")).select("acl_id", "e.*").withColumn(
        "rid", F.concat_ws(":", F.col("acl_id").cast("string"), F.col("rule_number").cast("string"))
    )


def open_acl_allow(acls: DataFrame) -> DataFrame:
    """VPC-8: ACL entry allowing 0.0.0.0/0, any direction."""
    e = _entries(acls).filter((F.col("rule_action") == "allow") & (F.col("cidr_block") == "0.0.0.0/0"))
    return flag(e, VPC, "VPC-8", 8, "rid")


def open_acl_egress(acls: DataFrame) -> DataFrame:
    """VPC-9: egress ACL entry with 0.0.0.0/0, any action."""
    e = _entries(acls).filter(F.col("egress") & (F.col("cidr_block") == "0.0.0.0/0"))
    return flag(e, VPC, "VPC-9", 9, "rid")


def many_rules(groups: DataFrame, ingress: int = 50, egress: int = 10) -> DataFrame:
    """VPC-10: security group with more than `ingress` ingress rules (a), else more than `egress` egress rules (b)."""
    g = groups.withColumn("n_in", F.size("ip_permissions")).withColumn("n_out", F.size("ip_permissions_egress"))
    many_in = F.coalesce(F.col("n_in") > ingress, F.lit(False))
    return flag(g.filter(many_in), VPC, "VPC-10a", 10, "group_id", "n_in", ingress).unionByName(
        flag(g.filter(~many_in & (F.col("n_out") > egress)), VPC, "VPC-10b", 10, "group_id", "n_out", egress)
    )


def many_cidrs(groups: DataFrame, limit: int = 10) -> DataFrame:
    """VPC-11: a rule with more than `limit` CIDR blocks (ingress; egress)."""
    big = lambda col: F.exists(col, lambda p: F.size(p["ip_ranges"]) > limit)
    return flag(groups.filter(big("ip_permissions")), VPC, "VPC-11a", 11, "group_id", None, limit).unionByName(
        flag(groups.filter(big("ip_permissions_egress")), VPC, "VPC-11b", 11, "group_id", None, limit)
    )


def flow_log_volume(flow_logs: DataFrame, points: DataFrame, as_of, limit: float = 1e9,
                    metric: str = "IncomingBytes") -> DataFrame:
    """VPC-12: flow-log group with more than `limit` incoming bytes over 1 day."""
    s = per_resource(points, as_of, {metric: "inb"})
    j = flow_logs.join(s, flow_logs.gateway_id == s.resource_id).filter(F.col("inb_total") > limit)
    return flag(j, VPC, "VPC-12", 12, "gateway_id", "inb_total", limit)


# ------------------------------------------------------------------ Config
def many_resources(resources: DataFrame, limit: int = 10) -> DataFrame:
    """CFG-1: more than `limit` recorded resources."""
    return flag(_count_over(resources, limit), CFG, "CFG-1", 1, F.lit("account"), "n", limit)


def idle_custom_rules(rules: DataFrame, evaluations: DataFrame) -> DataFrame:
    """CFG-2: CUSTOM_LAMBDA rules with zero NON_COMPLIANT evaluations."""
    nc = evaluations.filter(F.col("compliance") == "NON_COMPLIANT").select("rule_name")
    r = rules.filter(F.col("owner") == "CUSTOM_LAMBDA").join(nc, "rule_name", "left_anti")
    return flag(r, CFG, "CFG-2", 2, "rule_name", F.lit(0.0), 0)


def stopped_recorders(recorders: DataFrame) -> DataFrame:
    """CFG-3: configuration recorders that are not recording."""
    return flag(recorders.filter(~F.col("recording")), CFG, "CFG-3", 3, "name")


def stale_delivery(deliveries: DataFrame, as_of, days: int = 30) -> DataFrame:
    """CFG-4: more than `days` whole days since the last successful delivery, per channel."""
    d = deliveries.withColumn("age", whole_days_between("last_success", lit_ts(as_of))).filter(F.col("age") > days)
    return flag(d, CFG, "CFG-4", 4, "channel", "age", days)


# ------------------------------------------------------------------ KMS
# The nine key-service operations the reference counts.
KMS_OPERATIONS = [
    "Encrypt",
    "Decrypt",
    "GenerateDataKey",
    "GenerateDataKeyWithoutPlaintext",
    "ReEncrypt",
    "DescribeKey",
    "CreateKey",
    "ScheduleKeyDeletion",
    "CancelKeyDeletion",
]


def many_keys(keys: DataFrame, limit: int = 5) -> DataFrame:
    """KMS-1: more than `limit` listed keys (key_id), whether they are in use or not."""
    return flag(_count_over(keys.select("key_id").distinct(), limit), KMS, "KMS-1", 1, F.lit("account"), "n", limit)


def operation_counts(audit_events: DataFrame, as_of, ops: Sequence[str] = tuple(KMS_OPERATIONS), hours: int = 24):
    """KMS-2 (counts): events of each named operation in the last `hours`, zeros included."""
    spark = audit_events.sparkSession
    names = spark.createDataFrame([(o,) for o in ops], "event_name string")
    ev = in_window(audit_events, as_of, f"{int(hours)} hours").groupBy("event_name").agg(
        F.count(F.lit(1)).alias("n")
    )
    return names.join(ev, "event_name", "left").select("event_name", F.coalesce("n", F.lit(0)).alias("n"))


def busy_operations(audit_events: DataFrame, as_of, ops: Sequence[str] = tuple(KMS_OPERATIONS),
                    hours: int = 24, limit: int = 10) -> DataFrame:
    """KMS-2: operations with more than `limit` events in the window."""
    c = operation_counts(audit_events, as_of, ops, hours).filter(F.col("n") > limit)
    return flag(c, KMS, "KMS-2", 2, "event_name", "n", limit)


def rotation_counts(audit_events: DataFrame, as_of, days: int = 365, rotate_event: str = "RotateKey") -> DataFrame:
    """KMS-3: rotations per key in the last `days`."""
    e = in_window(audit_events, as_of, f"{int(days)} days").filter(F.col("event_name") == rotate_event)
    return e.groupBy("key_id").agg(F.count(F.lit(1)).alias("rotations"))


def frequent_rotation(audit_events: DataFrame, as_of, days: int = 365, limit: int = 1, **kw) -> DataFrame:
    """KMS-4: keys rotated more than `limit` times in the last `days`."""
    r = rotation_counts(audit_events, as_of, days, **kw).filter(F.col("rotations") > limit)
    return flag(r, KMS, "KMS-4", 4, "key_id", "rotations", limit)


# ------------------------------------------------------------------ Advisor
def advisor_flagged(checks: DataFrame, flagged: DataFrame, phrase: str = "Low Utilization Amazon EC2 Instances"):
    """ADV-1: resources flagged by the first advisor check whose name contains `phrase`.

    "First" = smallest check id among matches (the listing order is not
    reproducible); found by an aggregate, then an equi-join."""
    first = checks.filter(F.col("name").contains(phrase)).agg(F.min("check_id").alias("check_id"))
    j = flagged.join(first, "check_id")
    return flag(j, EC2, "ADV-1", 1, "resource_id")
