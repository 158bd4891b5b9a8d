"""Registered queries: every resource check over the fixtures.

Metric stand-ins of the fixture (FIXTURES.md): cpu = `view`, memory =
`click`, in = `purchase`, out = `signup`, other = `error`.  Values are 0-490,
so limits are scaled to the fixture; the library defaults stay the
reference's constants.
"""

from __future__ import annotations

from costlens.operators import topology as TP
from costlens.operators.checks import aws as A
from costlens.operators.checks import gcp as G
from costlens.operators.findings import flag_sql
from costlens.plans.registry import dsum_, query
from costlens.plans.sqlparts import cpu_milli_sql, mem_mib_sql, per_resource_sql, whole_days_sql, window_sql
from costlens.sources.fixtures import Tables

AS_OF = "2024-01-31 00:00:00"  # metric fixture
CPU, MEM, IN, OUT, OTHER = "view", "click", "purchase", "signup", "error"


def members(t: Tables):
    return TP.cluster_instances(t.nodegroups, t.asg_members)


MEMBERS_SQL = "(select distinct cluster, instance_id from topology)"


def _pr(alias, lookback="1 day", period="1 hour"):
    return f"({per_resource_sql(AS_OF, alias, lookback, period)})"


# ------------------------------------------------------------------ CloudWatch
@query(
    "cw1_excessive_metrics",
    "CW-1",
    ["metric_points"],
    f"select {flag_sql('AmazonCloudWatch', 'CW-1', 1, chr(39) + 'account' + chr(39), 'n', 100)} from "
    "(select count(*) as n from (select distinct namespace, metric, resource_id from metric_points) d) c where n > 100",
)
def cw1_excessive_metrics(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return A.excessive_metrics(t.metric_points.select("namespace", "metric", "resource_id").distinct(), 100)


@query(
    "cw2_excessive_log_groups",
    "CW-2",
    ["log_groups"],
    f"select {flag_sql('AmazonCloudWatch', 'CW-2', 2, chr(39) + 'account' + chr(39), 'n', 2)} from "
    "(select count(*) as n from log_groups) c where n > 2",
)
def cw2_excessive_log_groups(spark, sf_dir):
    return A.excessive_log_groups(Tables(spark, sf_dir).log_groups, 2)


@query(
    "cw3_excessive_log_streams",
    "CW-3",
    ["log_streams"],
    f"select {flag_sql('AmazonCloudWatch', 'CW-3', 3, 'log_group', 'n', 10)} from "
    "(select log_group, count(*) as n from log_streams group by log_group) c where n > 10",
)
def cw3_excessive_log_streams(spark, sf_dir):
    return A.excessive_log_streams(Tables(spark, sf_dir).log_streams, 10)


@query(
    "cw4_high_data_points",
    "CW-4",
    ["metric_points"],
    f"select {flag_sql('AmazonCloudWatch', 'CW-4', 4, chr(39) + chr(39) + ' || namespace || ' + chr(39) + '/' + chr(39) + ' || metric', 'n', 50)} "
    f"from (select namespace, metric, count(*) as n from metric_points where {window_sql(AS_OF, '1440 minutes')} "
    "group by namespace, metric) c where n > 50",
)
def cw4_high_data_points(spark, sf_dir):
    return A.high_data_points(Tables(spark, sf_dir).points, AS_OF, minutes=1440, limit=50)


# ------------------------------------------------------------------ EC2
@query(
    "ec2_1_low_cpu",
    "EC2-1 MET-1 MET-7",
    ["metric_points"],
    f"select {flag_sql('AmazonEC2', 'EC2-1', 1, 'resource_id', 'cpu_avg', 100)} from {_pr({CPU: 'cpu'})} s "
    "where cpu_avg < 100",
)
def ec2_1_low_cpu(spark, sf_dir):
    return A.low_cpu(Tables(spark, sf_dir).points, AS_OF, 100, cpu_metric=CPU)


@query(
    "ec2_2_high_transfer",
    "EC2-2",
    ["metric_points"],
    f"select {flag_sql('AmazonEC2', 'EC2-2a', 2, 'resource_id', 'nin_total', 200)} from {_pr({IN: 'nin', OUT: 'nout'})} s "
    "where nin_total > 200 union all "
    f"select {flag_sql('AmazonEC2', 'EC2-2b', 2, 'resource_id', 'nout_total', 200)} from {_pr({IN: 'nin', OUT: 'nout'})} s "
    "where not coalesce(nin_total > 200, false) and nout_total > 200",
)
def ec2_2_high_transfer(spark, sf_dir):
    return A.high_transfer(Tables(spark, sf_dir).points, AS_OF, 200, in_metric=IN, out_metric=OUT)


@query(
    "ec2_3_old_instances",
    "EC2-3",
    ["instances"],
    f"select {flag_sql('AmazonEC2', 'EC2-3', 3, 'instance_id', whole_days_sql('launch_time', chr(39) + '1995-12-01' + chr(39) + '::timestamp'), 180)} "
    "from instances where launch_time < timestamp '1995-12-01' - interval 180 day",
)
def ec2_3_old_instances(spark, sf_dir):
    return A.old_instances(Tables(spark, sf_dir).instances, "1995-12-01", 180)


@query(
    "ec2_4_unoptimized_volumes",
    "EC2-4",
    ["volumes", "metric_points"],
    f"with v4 as (select v.*, rd_avg, wr_avg, coalesce(rd_avg < 100 and wr_avg < 100, false) as idle from volumes v "
    f"left join {_pr({IN: 'rd', OUT: 'wr'})} s on v.volume_id = s.resource_id) "
    f"select {flag_sql('AmazonEC2', 'EC2-4a', 4, 'volume_id', 'greatest(rd_avg, wr_avg)', 100)} from v4 where idle "
    f"union all select {flag_sql('AmazonEC2', 'EC2-4b', 4, 'volume_id', 'size_gb', 200)} from v4 "
    "where not idle and size_gb > 200",
)
def ec2_4_unoptimized_volumes(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return A.unoptimized_volumes(t.volumes, t.points, AS_OF, 100, 200, read_metric=IN, write_metric=OUT)


@query(
    "ec2_5_old_snapshots",
    "EC2-5",
    ["snapshots"],
    f"select {flag_sql('AmazonEC2', 'EC2-5', 5, 'snapshot_id', whole_days_sql('start_time', chr(39) + '2001-08-02' + chr(39) + '::timestamp'), 180)} "
    "from snapshots where start_time < timestamp '2001-08-02' - interval 180 day",
)
def ec2_5_old_snapshots(spark, sf_dir):
    return A.old_snapshots(Tables(spark, sf_dir).snapshots, "2001-08-02", 180)


# ------------------------------------------------------------------ EKS
@query(
    "eks1_idle_cluster_instances",
    "EKS-1 TOP-1",
    ["topology", "metric_points"],
    f"select {flag_sql('AmazonEKS', 'EKS-1', 1, 'instance_id', 'cpu_avg', 100)} from {MEMBERS_SQL} m "
    f"join {_pr({CPU: 'cpu', MEM: 'mem'})} s on m.instance_id = s.resource_id where cpu_avg < 100 and mem_avg < 100",
)
def eks1_idle_cluster_instances(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return A.idle_cluster_instances(members(t), t.points, AS_OF, 100, 100, cpu_metric=CPU, mem_metric=MEM)


@query(
    "eks2_cluster_transfer",
    "EKS-2",
    ["topology", "metric_points"],
    f"select {flag_sql('AmazonEKS', 'EKS-2', 2, 'instance_id', 'greatest(nin_total, nout_total)', 200)} "
    f"from {MEMBERS_SQL} m join {_pr({IN: 'nin', OUT: 'nout'})} s on m.instance_id = s.resource_id "
    "where nin_total > 200 or nout_total > 200",
)
def eks2_cluster_transfer(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return A.cluster_transfer(members(t), t.points, AS_OF, 200, in_metric=IN, out_metric=OUT)


@query(
    "eks3_foreign_targets",
    "EKS-3",
    ["topology", "lb_targets"],
    f"select {flag_sql('AmazonEKS', 'EKS-3', 3, 'target_id')} from (select distinct target_id from lb_targets) t "
    "where not exists (select 1 from topology m where m.instance_id = t.target_id)",
)
def eks3_foreign_targets(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return A.foreign_targets(members(t), t.lb_targets)


@query(
    "eks4_unhealthy_targets",
    "EKS-4",
    ["topology", "lb_targets"],
    f"select {flag_sql('AmazonEKS', 'EKS-4', 4, 'target_id')} from "
    "(select distinct target_id from lb_targets where state <> 'healthy') t "
    "where exists (select 1 from topology m where m.instance_id = t.target_id)",
)
def eks4_unhealthy_targets(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return A.unhealthy_targets(members(t), t.lb_targets)


@query(
    "eks5_unmonitored",
    "EKS-5",
    ["topology", "metric_points"],
    f"select {flag_sql('AmazonEKS', 'EKS-5', 5, 'instance_id')} from {MEMBERS_SQL} m "
    f"left join {_pr({CPU: 'cpu', MEM: 'mem'})} s on m.instance_id = s.resource_id "
    "where coalesce(cpu_buckets, 0) = 0 or coalesce(mem_buckets, 0) = 0",
)
def eks5_unmonitored(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return A.unmonitored(members(t), t.points, AS_OF, cpu_metric=CPU, mem_metric=MEM)


@query(
    "eks6_overutilized",
    "EKS-6",
    ["topology", "metric_points"],
    f"select {flag_sql('AmazonEKS', 'EKS-6a', 6, 'instance_id', 'cpu_max', 150)} from {MEMBERS_SQL} m "
    f"join {_pr({CPU: 'cpu', MEM: 'mem'})} s on m.instance_id = s.resource_id where cpu_max > 150 union all "
    f"select {flag_sql('AmazonEKS', 'EKS-6b', 6, 'instance_id', 'mem_max', 150)} from {MEMBERS_SQL} m "
    f"join {_pr({CPU: 'cpu', MEM: 'mem'})} s on m.instance_id = s.resource_id where mem_max > 150",
)
def eks6_overutilized(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return A.overutilized(members(t), t.points, AS_OF, 150, cpu_metric=CPU, mem_metric=MEM)


@query(
    "eks7_hourly_transfer",
    "EKS-7",
    ["topology", "metric_points"],
    f"select {flag_sql('AmazonEKS', 'EKS-7', 7, 'instance_id', 'greatest(nin_max, nout_max)', 200)} "
    f"from {MEMBERS_SQL} m join {_pr({IN: 'nin', OUT: 'nout'})} s on m.instance_id = s.resource_id "
    "where greatest(nin_max, nout_max) > 200",
)
def eks7_hourly_transfer(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return A.hourly_transfer(members(t), t.points, AS_OF, 200, in_metric=IN, out_metric=OUT)


@query(
    "eks8_missing_cluster_logs",
    "EKS-8",
    ["topology", "log_groups"],
    f"select {flag_sql('AmazonEKS', 'EKS-8', 8, 'cluster')} from (select distinct cluster from topology) c "
    "where not exists (select 1 from log_groups g where starts_with(g.name, '/aws/eks/' || c.cluster || '/cluster'))",
)
def eks8_missing_cluster_logs(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return A.missing_cluster_logs(members(t), t.log_groups)


@query(
    "eks9_cluster_counts",
    "EKS-9",
    ["metric_points"],
    f"select {flag_sql('AmazonEKS', 'EKS-9', 9, 'resource_id', 'pod_total', 300)} from {_pr({CPU: 'pod', MEM: 'node'})} s "
    "where pod_total > 300 union all "
    f"select {flag_sql('AmazonEKS', 'EKS-9', 10, 'resource_id', 'node_total', 300)} from {_pr({CPU: 'pod', MEM: 'node'})} s "
    "where node_total > 300",
)
def eks9_cluster_counts(spark, sf_dir):
    return A.cluster_counts(Tables(spark, sf_dir).points, AS_OF, 300, pod_metric=CPU, node_metric=MEM)


def _vol_totals_sql():
    from costlens.plans.sqlparts import stats_sql

    tot = lambda m: dsum_(f"case when metric = '{m}' then sum end")
    return (
        f"select resource_id as volume_id, {tot(IN)} as read_bytes, {tot(OUT)} as write_bytes, "
        f"{tot(OTHER)} as idle_time from ({stats_sql(AS_OF, '1 day', '1 hour', [IN, OUT, OTHER])}) s "
        "group by resource_id"
    )


@query("eks10_volume_totals", "EKS-10", ["metric_points"], _vol_totals_sql())
def eks10_volume_totals(spark, sf_dir):
    return A.volume_totals(Tables(spark, sf_dir).points, AS_OF, IN, OUT, OTHER)


@query(
    "eks11_idle_volumes",
    "EKS-11 TOP-2",
    ["topology", "volumes", "metric_points"],
    f"select {flag_sql('AmazonEKS', 'EKS-11', 11, 'v.volume_id', 'idle_time', 100)} from "
    "(select distinct volume_id from volumes where instance_id in (select instance_id from topology)) v "
    f"join ({_vol_totals_sql()}) s on s.volume_id = v.volume_id where idle_time > 100",
)
def eks11_idle_volumes(spark, sf_dir):
    t = Tables(spark, sf_dir)
    attached = TP.instance_volumes(t.instance_devices)
    return A.idle_volumes(
        members(t), attached, t.points, AS_OF, 100, read_metric=IN, write_metric=OUT, idle_metric=OTHER
    )


# ------------------------------------------------------------------ S3
@query(
    "s3_1_stale_objects",
    "S3-1",
    ["objects"],
    f"select {flag_sql('AmazonS3', 'S3-1', 1, 'concat_ws(' + chr(39) + '/' + chr(39) + ', bucket, key, cast(version_id as varchar))', whole_days_sql('last_modified', chr(39) + '2024-02-15' + chr(39) + '::timestamp'), 30)} "
    f"from objects where coalesce(storage_class, 'STANDARD') = 'STANDARD' "
    f"and {whole_days_sql('last_modified', chr(39) + '2024-02-15' + chr(39) + '::timestamp')} > 30",
)
def s3_1_stale_objects(spark, sf_dir):
    return A.stale_objects(Tables(spark, sf_dir).objects, "2024-02-15", 30)


@query(
    "s3_2_incomplete_uploads",
    "S3-2",
    ["uploads"],
    f"select {flag_sql('AmazonS3', 'S3-2', 2, 'bucket', 'n', 0)} from (select bucket, count(*) as n from uploads group by bucket) u",
)
def s3_2_incomplete_uploads(spark, sf_dir):
    return A.incomplete_uploads(Tables(spark, sf_dir).uploads)


@query(
    "s3_3_object_versions",
    "S3-3",
    ["objects"],
    "select bucket, key, count(*) as versions, cast(sum(size) as bigint) as total_size, "
    "max(case when is_latest then version_id end) as latest_version from objects group by bucket, key",
)
def s3_3_object_versions(spark, sf_dir):
    return A.object_versions(Tables(spark, sf_dir).objects)


@query(
    "s3_4_replicated_keys",
    "S3-4",
    ["objects"],
    f"select {flag_sql('AmazonS3', 'S3-4', 4, 'key', 'buckets', 1)} from "
    "(select key, count(distinct bucket) as buckets from objects group by key) k where buckets > 1",
)
def s3_4_replicated_keys(spark, sf_dir):
    return A.replicated_keys(Tables(spark, sf_dir).objects, 1)


@query(
    "s3_5_excessive_requests",
    "S3-5",
    ["metric_points"],
    f"select {flag_sql('AmazonS3', 'S3-5', 5, 'resource_id', 'req_total / 24.0', 1)} from {_pr({OTHER: 'req'})} s "
    "where req_total / 24.0 > 1",
)
def s3_5_excessive_requests(spark, sf_dir):
    return A.excessive_requests(Tables(spark, sf_dir).points, AS_OF, 1, metric=OTHER)


@query(
    "s3_6_log_stats",
    "S3-6",
    ["objects"],
    "select bucket, cast(sum(size) as bigint) as total_size, count(*) as files from objects group by bucket",
)
def s3_6_log_stats(spark, sf_dir):
    return A.log_stats(Tables(spark, sf_dir).objects)


# ------------------------------------------------------------------ VPC
def _idle_total_sql(check, rank, metrics, limit):
    alias = {m: f"m{i}" for i, m in enumerate(metrics)}
    total = " + ".join(f"coalesce(m{i}_total, 0.0)" for i in range(len(metrics)))
    return (
        f"select {flag_sql('AmazonVPC', check, rank, 'gateway_id', total, limit)} from gateways g "
        f"left join {_pr(alias)} s on g.gateway_id = s.resource_id where {total} < {limit}"
    )


@query("vpc1_idle_nat", "VPC-1", ["gateways", "metric_points"], _idle_total_sql("VPC-1", 1, [IN, OUT], 100))
def vpc1_idle_nat(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return A.idle_nat(t.gateways, t.points, AS_OF, 100, metrics=(IN, OUT))


@query(
    "vpc2_unused_addresses",
    "VPC-2",
    ["addresses"],
    f"select {flag_sql('AmazonVPC', 'VPC-2', 2, 'public_ip')} from addresses "
    "where instance_id is null and network_interface_id is null and association_id is null",
)
def vpc2_unused_addresses(spark, sf_dir):
    return A.unused_addresses(Tables(spark, sf_dir).addresses)


@query("vpc3_idle_vpn", "VPC-3", ["gateways", "metric_points"], _idle_total_sql("VPC-3", 3, [CPU, MEM], 300))
def vpc3_idle_vpn(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return A.idle_vpn(t.gateways, t.points, AS_OF, 300, metrics=(CPU, MEM))


def _vpn_packets_sql():
    from costlens.plans.sqlparts import stats_sql

    rid = "cast(resource_id as varchar) || ' ' || strftime(bucket_start, '%Y-%m-%d %H:%M')"
    base = (
        f"from ({stats_sql(AS_OF, '1 day', '1 hour', [IN, OUT])}) s "
        "where resource_id in (select gateway_id from gateways) and sum > 100"
    )
    return (
        f"select {flag_sql('AmazonVPC', 'VPC-4a', 4, rid, 'sum', 100)} {base} and metric = '{IN}' union all "
        f"select {flag_sql('AmazonVPC', 'VPC-4b', 4, rid, 'sum', 100)} {base} and metric = '{OUT}'"
    )


@query("vpc4_vpn_packets", "VPC-4", ["gateways", "metric_points"], _vpn_packets_sql())
def vpc4_vpn_packets(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return A.vpn_packets(t.gateways, t.points, AS_OF, 100, in_metric=IN, out_metric=OUT)


@query(
    "vpc5_many_endpoints",
    "VPC-5",
    ["gateways"],
    f"select {flag_sql('AmazonVPC', 'VPC-5', 5, chr(39) + 'account' + chr(39), 'n', 100)} from "
    "(select count(*) as n from gateways) c where n > 100",
)
def vpc5_many_endpoints(spark, sf_dir):
    return A.many_endpoints(Tables(spark, sf_dir).gateways, 100)


_ROUTE_ID = "cast(table_id as varchar) || ':' || cast(destination as varchar)"


@query(
    "vpc6_unused_routes",
    "VPC-6",
    ["routes_flat"],
    f"select {flag_sql('AmazonVPC', 'VPC-6', 6, _ROUTE_ID)} from routes_flat where network_interface_id is null "
    "and instance_id is null and nat_gateway_id is null and peering_id is null",
)
def vpc6_unused_routes(spark, sf_dir):
    return A.unused_routes(Tables(spark, sf_dir).route_tables)


@query(
    "vpc7_blackhole_routes",
    "VPC-7",
    ["routes_flat"],
    f"select {flag_sql('AmazonVPC', 'VPC-7', 7, _ROUTE_ID)} from routes_flat where state = 'blackhole'",
)
def vpc7_blackhole_routes(spark, sf_dir):
    return A.blackhole_routes(Tables(spark, sf_dir).route_tables)


_ACL_ID = "cast(acl_id as varchar) || ':' || cast(rule_number as varchar)"


@query(
    "vpc8_open_acl_allow",
    "VPC-8",
    ["acl_flat"],
    f"select {flag_sql('AmazonVPC', 'VPC-8', 8, _ACL_ID)} from acl_flat "
    "where rule_action = 'allow' and cidr_block = '0.0.0.0/0'",
)
def vpc8_open_acl_allow(spark, sf_dir):
    return A.open_acl_allow(Tables(spark, sf_dir).acls)


@query(
    "vpc9_open_acl_egress",
    "VPC-9",
    ["acl_flat"],
    f"select {flag_sql('AmazonVPC', 'VPC-9', 9, _ACL_ID)} from acl_flat where egress and cidr_block = '0.0.0.0/0'",
)
def vpc9_open_acl_egress(spark, sf_dir):
    return A.open_acl_egress(Tables(spark, sf_dir).acls)


@query(
    "vpc10_many_rules",
    "VPC-10",
    ["sg_flat"],
    "with g10 as (select group_id, count(*) filter (where ingress) as n_in, "
    "count(*) filter (where not ingress) as n_out from sg_flat group by group_id) "
    f"select {flag_sql('AmazonVPC', 'VPC-10a', 10, 'group_id', 'n_in', 5)} from g10 where n_in > 5 union all "
    f"select {flag_sql('AmazonVPC', 'VPC-10b', 10, 'group_id', 'n_out', 5)} from g10 where n_in <= 5 and n_out > 5",
)
def vpc10_many_rules(spark, sf_dir):
    return A.many_rules(Tables(spark, sf_dir).security_groups, 5, 5)


@query(
    "vpc11_many_cidrs",
    "VPC-11",
    ["sg_flat"],
    f"select {flag_sql('AmazonVPC', 'VPC-11a', 11, 'group_id', 'null', 40)} from sg_flat "
    "group by group_id having bool_or(ingress and n_cidr > 40) union all "
    f"select {flag_sql('AmazonVPC', 'VPC-11b', 11, 'group_id', 'null', 40)} from sg_flat "
    "group by group_id having bool_or(not ingress and n_cidr > 40)",
)
def vpc11_many_cidrs(spark, sf_dir):
    return A.many_cidrs(Tables(spark, sf_dir).security_groups, 40)


@query(
    "vpc12_flow_log_volume",
    "VPC-12",
    ["gateways", "metric_points"],
    f"select {flag_sql('AmazonVPC', 'VPC-12', 12, 'gateway_id', 'inb_total', 100)} from gateways g "
    f"join {_pr({IN: 'inb'})} s on g.gateway_id = s.resource_id where inb_total > 100",
)
def vpc12_flow_log_volume(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return A.flow_log_volume(t.gateways, t.points, AS_OF, 100, metric=IN)


# ------------------------------------------------------------------ Config
@query(
    "cfg1_many_resources",
    "CFG-1",
    ["recorders"],
    f"select {flag_sql('AWSConfig', 'CFG-1', 1, chr(39) + 'account' + chr(39), 'n', 10)} from "
    "(select count(*) as n from recorders) c where n > 10",
)
def cfg1_many_resources(spark, sf_dir):
    return A.many_resources(Tables(spark, sf_dir).recorders, 10)


@query(
    "cfg2_idle_custom_rules",
    "CFG-2",
    ["rules", "evaluations"],
    f"select {flag_sql('AWSConfig', 'CFG-2', 2, 'rule_name', '0.0', 0)} from rules r where owner = 'CUSTOM_LAMBDA' "
    "and not exists (select 1 from evaluations e where e.rule_name = r.rule_name and compliance = 'NON_COMPLIANT')",
)
def cfg2_idle_custom_rules(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return A.idle_custom_rules(t.rules, t.evaluations)


@query(
    "cfg3_stopped_recorders",
    "CFG-3",
    ["recorders"],
    f"select {flag_sql('AWSConfig', 'CFG-3', 3, 'name')} from recorders where not recording",
)
def cfg3_stopped_recorders(spark, sf_dir):
    return A.stopped_recorders(Tables(spark, sf_dir).recorders)


@query(
    "cfg4_stale_delivery",
    "CFG-4",
    ["deliveries"],
    f"select {flag_sql('AWSConfig', 'CFG-4', 4, 'channel', whole_days_sql('last_success', chr(39) + '2024-03-05' + chr(39) + '::timestamp'), 30)} "
    f"from deliveries where {whole_days_sql('last_success', chr(39) + '2024-03-05' + chr(39) + '::timestamp')} > 30",
)
def cfg4_stale_delivery(spark, sf_dir):
    return A.stale_delivery(Tables(spark, sf_dir).deliveries, "2024-03-05", 30)


# ------------------------------------------------------------------ KMS
@query(
    "kms1_many_keys",
    "KMS-1",
    ["keys"],
    f"select {flag_sql('AWSKMS', 'KMS-1', 1, chr(39) + 'account' + chr(39), 'n', 5)} from "
    "(select count(distinct key_id) as n from keys) c where n > 5",
)
def kms1_many_keys(spark, sf_dir):
    return A.many_keys(Tables(spark, sf_dir).keys, 5)


_OPS_VALUES = ", ".join(f"('{o}')" for o in A.KMS_OPERATIONS)
_OPS_COUNTS_SQL = (
    f"select o.event_name, coalesce(c.n, 0) as n from (values {_OPS_VALUES}) o(event_name) left join "
    f"(select event_name, count(*) as n from audit_events where {window_sql(AS_OF, '24 hours')} group by event_name) c "
    "on c.event_name = o.event_name"
)


@query("kms2_operation_counts", "KMS-2", ["audit_events"], _OPS_COUNTS_SQL)
def kms2_operation_counts(spark, sf_dir):
    return A.operation_counts(Tables(spark, sf_dir).audit_events, AS_OF)


@query(
    "kms2_busy_operations",
    "KMS-2",
    ["audit_events"],
    f"select {flag_sql('AWSKMS', 'KMS-2', 2, 'event_name', 'n', 10)} from ({_OPS_COUNTS_SQL}) c where n > 10",
)
def kms2_busy_operations(spark, sf_dir):
    return A.busy_operations(Tables(spark, sf_dir).audit_events, AS_OF, limit=10)


_ROT_SQL = (
    f"select key_id, count(*) as rotations from audit_events where {window_sql(AS_OF, '365 days')} "
    "and event_name = 'RotateKey' group by key_id"
)


@query("kms3_rotation_counts", "KMS-3", ["audit_events"], _ROT_SQL)
def kms3_rotation_counts(spark, sf_dir):
    return A.rotation_counts(Tables(spark, sf_dir).audit_events, AS_OF, 365)


@query(
    "kms4_frequent_rotation",
    "KMS-4",
    ["audit_events"],
    f"select {flag_sql('AWSKMS', 'KMS-4', 4, 'key_id', 'rotations', 1)} from ({_ROT_SQL}) r where rotations > 1",
)
def kms4_frequent_rotation(spark, sf_dir):
    return A.frequent_rotation(Tables(spark, sf_dir).audit_events, AS_OF, 365, 1)


# ------------------------------------------------------------------ Advisor
@query(
    "adv1_advisor_flagged",
    "ADV-1",
    ["advisor_checks", "advisor_flagged"],
    f"select {flag_sql('AmazonEC2', 'ADV-1', 1, 'resource_id')} from advisor_flagged f "
    "where f.check_id = (select min(check_id) from advisor_checks where contains(name, 'red widget'))",
)
def adv1_advisor_flagged(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return A.advisor_flagged(t.advisor_checks, t.advisor_flagged, "red widget")


# ------------------------------------------------------------------ Compute Engine
def _gce_cpu_sql():
    return (
        f"select i.*, coalesce(s.cpu_avg, 0.0) as cpu from instances i "
        f"left join {_pr({CPU: 'cpu'}, '7 days', '1 hour')} s on i.instance_id = s.resource_id"
    )


@query(
    "gce1_underutilized",
    "GCE-1 MET-3",
    ["instances", "metric_points"],
    f"select {flag_sql('ComputeEngine', 'GCE-1', 1, 'instance_id', 'cpu', 100)} from ({_gce_cpu_sql()}) j where cpu < 100",
)
def gce1_underutilized(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return G.underutilized(t.instances, t.points, AS_OF, 100, cpu_metric=CPU)


@query(
    "gce2_overutilized_preemptible",
    "GCE-2",
    ["instances", "metric_points"],
    f"select {flag_sql('ComputeEngine', 'GCE-2', 2, 'instance_id', 'cpu', 5)} from ({_gce_cpu_sql()}) j "
    "where not (cpu < 5) and cpu > 5 and preemptible",
)
def gce2_overutilized_preemptible(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return G.overutilized_preemptible(t.instances, t.points, AS_OF, 5, low=5, cpu_metric=CPU)


@query(
    "gce3_egress_gb",
    "GCE-3",
    ["instances", "metric_points"],
    f"select {flag_sql('ComputeEngine', 'GCE-3', 3, 'instance_id', 'eg_sum_avg / 1073741824.0', 2e-7)} "
    f"from instances i join {_pr({OUT: 'eg'}, '7 days', '1 hour')} s on i.instance_id = s.resource_id "
    "where eg_sum_avg / 1073741824.0 > 2e-7",
)
def gce3_egress_gb(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return G.egress_gb(t.instances, t.points, AS_OF, 2e-7, metric=OUT)


_IO = "(coalesce(rd_total, 0.0) + coalesce(wr_total, 0.0)) / 1073741824.0"


@query(
    "gce4_low_disk_io",
    "GCE-4 MET-4",
    ["instances", "metric_points"],
    f"select {flag_sql('ComputeEngine', 'GCE-4', 4, 'instance_id', _IO, 1e-6)} from instances i "
    f"left join {_pr({IN: 'rd', OUT: 'wr'}, '7 days', '1 day')} s on i.instance_id = s.resource_id "
    f"where status = 'RUNNING' and {_IO} < 1e-6",
)
def gce4_low_disk_io(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return G.low_disk_io(t.instances, t.points, AS_OF, 1e-6, read_metric=IN, write_metric=OUT)


@query(
    "gce5_large_snapshots",
    "GCE-5",
    ["snapshots"],
    f"select {flag_sql('ComputeEngine', 'GCE-5', 5, 'snapshot_id', 'size_gb', 10)} from snapshots where size_gb > 10",
)
def gce5_large_snapshots(spark, sf_dir):
    return G.large_snapshots(Tables(spark, sf_dir).snapshots, 10)


# ------------------------------------------------------------------ Kubernetes Engine
_USAGE_SQL = (
    f"select n.node_name, {cpu_milli_sql('n.cpu')} as cpu_cap_m, {mem_mib_sql('n.memory')} as mem_cap_mib, "
    "coalesce(r.cpu_req_m, 0.0) as cpu_req_m, coalesce(r.mem_req_mib, 0.0) as mem_req_mib from nodes n left join "
    f"(select node_name, sum({cpu_milli_sql('cpu_req')}) as cpu_req_m, sum({mem_mib_sql('mem_req')}) as mem_req_mib "
    "from containers group by node_name) r on r.node_name = n.node_name"
)


def usage(t: Tables):
    return G.node_usage(t.nodes, t.pods)


@query("gke1_node_usage", "GKE-1 GKE-6", ["nodes", "containers"], _USAGE_SQL)
def gke1_node_usage(spark, sf_dir):
    return usage(Tables(spark, sf_dir))


@query(
    "gke2_overprovisioned_nodes",
    "GKE-2",
    ["nodes", "containers"],
    f"select {flag_sql('KubernetesEngine', 'GKE-2', 2, 'node_name', 'cpu_req_m')} from ({_USAGE_SQL}) u "
    "where cpu_req_m < cpu_cap_m * 0.5",
)
def gke2_overprovisioned_nodes(spark, sf_dir):
    return G.overprovisioned_nodes(usage(Tables(spark, sf_dir)), 0.5)


_HP = ", ".join(f"'{x}'" for x in G.HIGH_PERF_TYPES)


@query(
    "gke3_idle_large_nodes",
    "GKE-3",
    ["nodes", "containers", "pools"],
    f"select {flag_sql('KubernetesEngine', 'GKE-3', 3, 'u.node_name', 'cpu_req_m / cpu_cap_m', 0.7)} from ({_USAGE_SQL}) u "
    "join (select n.node_name, arg_max(p.pool, length(p.pool)) as pool from nodes n join "
    "(select distinct pool from pools) p on starts_with(n.node_name, p.pool) group by n.node_name) b "
    "on b.node_name = u.node_name "
    f"where b.pool in (select pool from pools where machine_type in ({_HP})) "
    "and cpu_req_m / cpu_cap_m < 0.7 and mem_req_mib / mem_cap_mib < 3.0",
)
def gke3_idle_large_nodes(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return G.idle_large_nodes(t.nodes, t.pools, usage(t), limit=0.7, mem_limit=3.0)


@query(
    "gke6_quantity",
    "GKE-6",
    ["containers"],
    f"select pod, cpu_req, mem_req, {cpu_milli_sql('cpu_req')} as cpu_m, {mem_mib_sql('mem_req')} as mem_mib "
    "from containers",
)
def gke6_quantity(spark, sf_dir):
    from costlens.functions import cpu_milli, mem_mib

    c = Tables(spark, sf_dir).containers
    return c.select("pod", "cpu_req", "mem_req", cpu_milli("cpu_req").alias("cpu_m"), mem_mib("mem_req").alias("mem_mib"))


def _peak_sql(check, rank, metric, limit, service="KubernetesEngine"):
    return (
        f"select {flag_sql(service, check, rank, 'resource_id', 'peak', limit)} from "
        f"(select resource_id, max(value) as peak from metric_points where {window_sql(AS_OF, '1 day')} "
        f"and metric = '{metric}' group by resource_id) p where peak > {limit}"
    )


@query("gke4_cluster_egress", "GKE-4 MET-6", ["metric_points"], _peak_sql("GKE-4", 4, OUT, 200))
def gke4_cluster_egress(spark, sf_dir):
    return G.cluster_egress(Tables(spark, sf_dir).points, AS_OF, 200, metric=OUT)


@query(
    "gke5_cluster_logging",
    "GKE-5",
    ["metric_points"],
    _peak_sql("GKE-5a", 5, OTHER, 180) + " union all " + _peak_sql("GKE-5b", 5, MEM, 180),
)
def gke5_cluster_logging(spark, sf_dir):
    return G.cluster_logging(Tables(spark, sf_dir).points, AS_OF, 180, log_metric=OTHER, mon_metric=MEM)


# ------------------------------------------------------------------ Networking
def _rate_sql(check, rank, metric, limit):
    from costlens.plans.sqlparts import stats_sql

    return (
        f"select {flag_sql('Networking', check, rank, 'resource_id', 'peak', limit)} from "
        f"(select resource_id, max(sum / 300.0) as peak from ({stats_sql(AS_OF, '1 day', '300 seconds', [metric])}) s "
        f"group by resource_id) r where peak > {limit}"
    )


@query("net1_egress_rate", "NET-1 MET-5", ["metric_points"], _rate_sql("NET-1", 1, OUT, 0.5))
def net1_egress_rate(spark, sf_dir):
    return G.egress_rate(Tables(spark, sf_dir).points, AS_OF, 0.5, metric=OUT)


@query("net2_ingress_rate", "NET-2", ["metric_points"], _rate_sql("NET-2", 2, IN, 0.3))
def net2_ingress_rate(spark, sf_dir):
    return G.ingress_rate(Tables(spark, sf_dir).points, AS_OF, 0.3, metric=IN)


@query(
    "net3_excessive_logging",
    "NET-3",
    ["log_entries"],
    f"select {flag_sql('Networking', 'NET-3', 3, chr(39) + 'project' + chr(39), 'total', 300)} from "
    f"(select count(*) as total from log_entries where {window_sql(AS_OF, '1 day')}) t where total > 300",
)
def net3_excessive_logging(spark, sf_dir):
    return G.excessive_logging(Tables(spark, sf_dir).log_entries, AS_OF, 300)


@query(
    "net3_log_counts",
    "NET-3",
    ["log_entries"],
    f"select log_name, count(*) as n from log_entries where {window_sql(AS_OF, '1 day')} group by log_name",
)
def net3_log_counts(spark, sf_dir):
    return G.log_counts(Tables(spark, sf_dir).log_entries, AS_OF)

