"""Engine input tables derived from the driver's TPC-H-like test tables.

The reference reads billing CSVs and live cloud inventories that are not
shipped; `FIXTURES.md` defines how each engine input is derived from the
test tables.  `Tables` builds those inputs as lazy Spark plans (column
pruning and filters reach the parquet scans); `FIXTURE_SQL` holds the same
definitions as DuckDB SQL for the oracle side of the correctness check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEST_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


class Tables:
    """Lazy accessors for the test tables and the engine inputs built on them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._raw: dict[str, DataFrame] = {}

    # Parquet readers shared by every `Tables` of a session: listing files and
    # reading footers once per table, not once per query branch.
    _shared: dict[tuple, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._raw:
            key = (id(self.spark), self.sf_dir, name)
            if key not in Tables._shared:
                Tables._shared[key] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            self._raw[name] = Tables._shared[key]
        return self._raw[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in TEST_TABLES:
            return self.raw(name)
        raise AttributeError(name)

    # ------------------------------------------------------------ billing
    @property
    def cost_aws_raw(self) -> DataFrame:
        l, p, s, n, r = self.lineitem, self.part, self.supplier, self.nation, self.region
        j = (
            l.join(p, p.p_partkey == l.l_partkey)
            .join(s, s.s_suppkey == l.l_suppkey)
            .join(n, n.n_nationkey == s.s_nationkey)
            .join(r, r.r_regionkey == n.n_regionkey)
        )
        line7 = F.col("l_linenumber") == 7
        return j.select(
            F.concat(F.col("l_shipdate").cast("date").cast("string"), F.lit("T00:00:00Z/P1D")).alias(
                "identity_time_interval"
            ),
            F.col("p_type").alias("line_item_product_code"),
            F.col("p_type").alias("product_servicecode"),
            F.nullif(F.col("r_name"), F.lit("ASIA")).alias("product_region_code"),
            F.nullif(F.col("n_name"), F.lit("NATION_3")).alias("product_location"),
            F.when(line7, F.lit(0.0)).otherwise(F.col("l_extendedprice")).alias("line_item_blended_cost"),
            F.when(line7, F.lit(0.0))
            .when(F.col("l_discount") == 0.05, F.lit(None).cast("double"))
            .otherwise(F.col("l_extendedprice") * F.col("l_discount"))
            .alias("discount_bundled_discount"),
            F.when(line7, F.lit(0.0))
            .otherwise(F.col("l_extendedprice") * F.col("l_tax"))
            .alias("discount_total_discount"),
            "l_orderkey",
            "l_linenumber",
            "l_partkey",
            "l_suppkey",
        )

    @property
    def cost_gcp_raw(self) -> DataFrame:
        """GCP report, with the loader's renames applied (`d` -> `Date`, ...)."""
        o = self.orders
        k = F.col("o_orderkey")
        bad = F.when(k % 97 == 0, F.lit("1,234.5")).when(k % 89 == 0, F.lit("1d"))
        base = o.select(
            F.col("o_orderdate").cast("date").cast("string").alias("Date"),
            F.col("o_orderpriority").alias("Service description"),
            bad.otherwise(F.col("o_totalprice").cast("string")).alias("Cost (€)"),
            F.col("o_custkey").cast("string").alias("Discounts (€)"),
            (k % 50).cast("string").alias("Promotions and others (€)"),
            F.lit(0.0).alias("Subtotal (€)"),
            F.lit(0.0).alias("Unrounded subtotal (€)"),
        )
        dup = o.filter((k % 10 == 0) & (k % 97 != 0) & (k % 89 != 0)).select(
            F.col("o_orderdate").cast("date").cast("string").alias("Date"),
            F.col("o_orderpriority").alias("Service description"),
            F.col("o_totalprice").cast("string").alias("Cost (€)"),
            F.col("o_custkey").cast("string").alias("Discounts (€)"),
            (k % 50).cast("string").alias("Promotions and others (€)"),
            F.lit(0.0).alias("Subtotal (€)"),
            F.lit(0.0).alias("Unrounded subtotal (€)"),
        )
        return base.unionByName(dup)

    # ------------------------------------------------------------ metrics
    # A shared metric cube for (session, sf_dir), set while a report is planned
    # (`metric_cube_scope`): the windowed checks then read the cube instead of
    # scanning the points once each.
    _cubes: dict[tuple, object] = {}

    @property
    def points(self):
        """Metric input of the windowed checks: the scoped cube, else the points."""
        return Tables._cubes.get((id(self.spark), self.sf_dir), None) or self.metric_points

    @property
    def metric_points(self) -> DataFrame:
        return self.events.select(
            F.lit("fx").alias("namespace"),
            F.col("event_type").alias("metric"),
            F.col("user_id").alias("resource_id"),
            "ts",
            "value",
        )

    # ------------------------------------------------------------ inventories
    @property
    def topology(self) -> DataFrame:
        r, n, c = self.region, self.nation, self.customer
        return (
            r.join(n, n.n_regionkey == r.r_regionkey)
            .join(c, c.c_nationkey == n.n_nationkey)
            .select(
                F.col("r_name").alias("cluster"),
                F.col("n_name").alias("nodegroup"),
                F.concat(F.col("n_name"), F.lit("-asg")).alias("asg"),
                F.col("c_custkey").alias("instance_id"),
            )
        )

    @property
    def nodegroups(self) -> DataFrame:
        """Nested form of TOP-1 input: cluster -> nodegroup -> [scaling groups]."""
        t = self.topology
        return t.groupBy("cluster", "nodegroup").agg(F.array(F.first("asg")).alias("asgs"))

    @property
    def asg_members(self) -> DataFrame:
        """Scaling group -> instance edges, flat: a group may hold a third of all
        instances, so its members are never gathered into one array."""
        return self.topology.select("asg", "instance_id")

    @property
    def instances(self) -> DataFrame:
        c, o = self.customer, self.orders
        return (
            c.join(o, o.o_custkey == c.c_custkey)
            .groupBy("c_custkey", "c_acctbal", "c_mktsegment")
            .agg(F.min("o_orderdate").alias("launch_time"))
            .select(
                F.col("c_custkey").alias("instance_id"),
                "launch_time",
                F.when(F.col("c_acctbal") > 0, F.lit("RUNNING")).otherwise(F.lit("STOPPED")).alias("status"),
                (F.col("c_mktsegment") == "BUILDING").alias("preemptible"),
            )
        )

    @property
    def reservations(self) -> DataFrame:
        """Nested form of TOP-3 input: reservation -> [instance structs]."""
        return (
            self.instances.withColumn("reservation_id", F.floor(F.col("instance_id") / 10))
            .groupBy("reservation_id")
            .agg(
                F.collect_list(F.struct("instance_id", "launch_time", "status", "preemptible")).alias(
                    "instances"
                )
            )
        )

    @property
    def volumes(self) -> DataFrame:
        c = self.customer
        return c.select(
            F.col("c_custkey").alias("volume_id"),
            F.floor(F.col("c_custkey") / 3).alias("instance_id"),
            F.floor(F.abs(F.col("c_acctbal")) / 10).cast("int").alias("size_gb"),
        )

    @property
    def instance_devices(self) -> DataFrame:
        """Nested form of TOP-2 input: instance -> [block device mappings]."""
        return self.volumes.groupBy("instance_id").agg(
            F.collect_list(F.struct(F.struct(F.col("volume_id")).alias("ebs"))).alias("block_devices")
        )

    @property
    def snapshots(self) -> DataFrame:
        return self.orders.select(
            F.col("o_orderkey").alias("snapshot_id"),
            F.col("o_custkey").alias("volume_id"),
            F.col("o_orderdate").alias("start_time"),
            F.floor(F.col("o_totalprice") / 20000).cast("int").alias("size_gb"),
        )

    @property
    def log_streams(self) -> DataFrame:
        return self.conversations.select(
            (F.col("conv_id") % 50).alias("log_group"),
            F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("log_stream"),
        )

    @property
    def log_groups(self) -> DataFrame:
        r = self.region
        suffix = F.when(F.col("r_regionkey") < 3, F.lit("/cluster-x")).otherwise(F.lit("-legacy"))
        return r.select(F.concat(F.lit("/aws/eks/"), F.col("r_name"), suffix).alias("name"))

    @property
    def lb_targets(self) -> DataFrame:
        return self.orders.select(
            F.col("o_orderpriority").alias("lb"),
            # targets of low-priority balancers are machines of another account
            (F.col("o_custkey") + F.when(F.col("o_orderpriority") == "5-LOW", F.lit(1_000_000_000)).otherwise(F.lit(0))).alias(
                "target_id"
            ),
            F.when(F.col("o_orderstatus") == "F", F.lit("healthy")).otherwise(F.lit("unhealthy")).alias("state"),
        )

    @property
    def objects(self) -> DataFrame:
        d, e = self.documents, self.events
        return d.join(e, e.event_id == d.doc_id * 10, "left").select(
            F.col("source").alias("bucket"),
            F.md5(F.col("text")).alias("key"),
            F.col("doc_id").alias("version_id"),
            F.col("n_chars").alias("size"),
            (F.col("doc_id") % 2 == 0).alias("is_latest"),
            F.when(F.col("lang") == "en", F.lit("STANDARD"))
            .when(F.col("lang") == "de", F.lit(None).cast("string"))
            .otherwise(F.lit("GLACIER"))
            .alias("storage_class"),
            F.col("ts").alias("last_modified"),
        )

    @property
    def uploads(self) -> DataFrame:
        d, lb = self.documents, self.labels
        return (
            d.join(lb, lb.doc_id == d.doc_id)
            .filter(F.col("toxic") == 1)
            .select(F.col("source").alias("bucket"), d.doc_id.alias("upload_id"))
        )

    @property
    def gateways(self) -> DataFrame:
        return self.customer.select(F.col("c_custkey").alias("gateway_id"))

    @property
    def addresses(self) -> DataFrame:
        c = self.customer
        return c.select(
            F.col("c_name").alias("public_ip"),
            F.nullif(F.col("c_nationkey"), F.lit(3)).alias("instance_id"),
            F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("network_interface_id"),
            F.when(F.col("c_acctbal") > 5000, F.col("c_custkey")).alias("association_id"),
        )

    @property
    def routes_flat(self) -> DataFrame:
        l = self.lineitem
        return l.select(
            F.col("l_orderkey").alias("table_id"),
            F.col("l_partkey").alias("destination"),
            F.nullif(F.col("l_returnflag"), F.lit("N")).alias("network_interface_id"),
            F.when(F.col("l_linestatus") == "F", F.col("l_suppkey")).alias("instance_id"),
            F.when(F.col("l_tax") > 0.02, F.col("l_partkey")).alias("nat_gateway_id"),
            F.when(F.col("l_discount") > 0.02, F.lit(1)).alias("peering_id"),
            F.when(F.col("l_linenumber") == 1, F.lit("blackhole")).otherwise(F.lit("active")).alias("state"),
        )

    @property
    def route_tables(self) -> DataFrame:
        """Nested: table -> [route structs], the shape of a route-table export."""
        f = self.routes_flat
        return f.groupBy("table_id").agg(
            F.collect_list(F.struct(*[c for c in f.columns if c != "table_id"])).alias("routes")
        )

    @property
    def acl_flat(self) -> DataFrame:
        l = self.lineitem
        return l.select(
            F.col("l_orderkey").alias("acl_id"),
            F.col("l_linenumber").alias("rule_number"),
            (F.col("l_linestatus") == "F").alias("egress"),
            F.when(F.col("l_returnflag") == "A", F.lit("allow")).otherwise(F.lit("deny")).alias("rule_action"),
            F.when(F.col("l_tax") == 0, F.lit("0.0.0.0/0")).otherwise(F.lit("10.0.0.0/8")).alias("cidr_block"),
        )

    @property
    def acls(self) -> DataFrame:
        f = self.acl_flat
        return f.groupBy("acl_id").agg(
            F.collect_list(F.struct("rule_number", "egress", "rule_action", "cidr_block")).alias("entries")
        )

    @property
    def sg_flat(self) -> DataFrame:
        l = self.lineitem
        return l.select(
            F.col("l_orderkey").alias("group_id"),
            (F.col("l_linestatus") == "F").alias("ingress"),
            F.col("l_quantity").cast("int").alias("n_cidr"),
        )

    @property
    def security_groups(self) -> DataFrame:
        """Nested: group -> ingress / egress permission arrays, each with ip_ranges."""
        perm = F.struct(F.sequence(F.lit(1), F.col("n_cidr")).alias("ip_ranges"))
        return self.sg_flat.groupBy("group_id").agg(
            F.filter(F.collect_list(F.when(F.col("ingress"), perm)), lambda x: x.isNotNull()).alias(
                "ip_permissions"
            ),
            F.filter(F.collect_list(F.when(~F.col("ingress"), perm)), lambda x: x.isNotNull()).alias(
                "ip_permissions_egress"
            ),
        )

    @property
    def rules(self) -> DataFrame:
        return self.part.select(
            F.col("p_partkey").alias("rule_name"),
            F.when(F.col("p_type") == "PROMO", F.lit("CUSTOM_LAMBDA")).otherwise(F.lit("AWS")).alias("owner"),
        )

    @property
    def evaluations(self) -> DataFrame:
        l = self.lineitem
        nc = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 1)
        return l.select(
            F.col("l_partkey").alias("rule_name"),
            F.when(nc, F.lit("NON_COMPLIANT")).otherwise(F.lit("COMPLIANT")).alias("compliance"),
        )

    @property
    def recorders(self) -> DataFrame:
        return self.supplier.select(
            F.col("s_name").alias("name"), (F.col("s_acctbal") > 0).alias("recording")
        )

    @property
    def deliveries(self) -> DataFrame:
        return self.events.groupBy(F.col("user_id").alias("channel")).agg(F.max("ts").alias("last_success"))

    @property
    def audit_events(self) -> DataFrame:
        et = F.col("event_type")
        name = (
            F.when(et == "click", F.lit("Encrypt"))
            .when(et == "view", F.lit("Decrypt"))
            .when(et == "purchase", F.lit("DescribeKey"))
            .when(et == "signup", F.lit("RotateKey"))
            .otherwise(F.lit("Other"))
        )
        return self.events.select(name.alias("event_name"), F.col("user_id").alias("key_id"), "ts")

    @property
    def keys(self) -> DataFrame:
        return self.customer.select(F.col("c_custkey").alias("key_id"))

    @property
    def advisor_checks(self) -> DataFrame:
        return self.part.select(F.col("p_partkey").alias("check_id"), F.col("p_name").alias("name"))

    @property
    def advisor_flagged(self) -> DataFrame:
        return self.lineitem.select(
            F.col("l_partkey").alias("check_id"), F.col("l_orderkey").alias("resource_id")
        )

    @property
    def nodes(self) -> DataFrame:
        return self.nation.select(
            F.col("n_name").alias("node_name"), F.lit("4").alias("cpu"), F.lit("8388608Ki").alias("memory")
        )

    @property
    def containers(self) -> DataFrame:
        c, n = self.customer, self.nation
        no_req = F.col("c_custkey") % 7 == 0
        return c.join(n, n.n_nationkey == c.c_nationkey).select(
            F.col("n_name").alias("node_name"),
            F.col("c_custkey").alias("pod"),
            F.when(~no_req, F.concat((F.col("c_custkey") % 100).cast("string"), F.lit("m"))).alias("cpu_req"),
            F.when(~no_req, F.concat((F.col("c_custkey") % 1024).cast("string"), F.lit("Mi"))).alias("mem_req"),
        )

    @property
    def pods(self) -> DataFrame:
        """Nested: pod -> node name, [container structs with requests]."""
        return self.containers.groupBy("pod", "node_name").agg(
            F.collect_list(
                F.struct(F.struct(F.col("cpu_req").alias("cpu"), F.col("mem_req").alias("memory")).alias("requests"))
            ).alias("containers")
        )

    @property
    def pools(self) -> DataFrame:
        n = self.nation
        return n.select(
            F.expr("substr(n_name, 1, length(n_name) - 1)").alias("pool"),
            F.when(F.col("n_regionkey") < 2, F.lit("n1-standard-64")).otherwise(F.lit("e2-small")).alias(
                "machine_type"
            ),
        ).distinct()

    @property
    def log_entries(self) -> DataFrame:
        return self.events.select(F.col("event_type").alias("log_name"), "event_id", "ts")


# Fixed values of the fixture: billing service names of the test data mapped
# to the canonical service keys the checks report under.
SERVICE_MAP = [
    ("ECONOMY", "AmazonCloudWatch"),
    ("LARGE", "AmazonEC2"),
    ("MEDIUM", "AmazonEKS"),
    ("PROMO", "AmazonS3"),
    ("SMALL", "AmazonVPC"),
    ("STANDARD", "AWSConfig"),
    ("1-URGENT", "ComputeEngine"),
    ("2-HIGH", "KubernetesEngine"),
    ("3-MEDIUM", "Networking"),
    ("4-NOT SPECIFIED", "AWSKMS"),
]


class metric_cube_scope:
    """`with metric_cube_scope(spark, sf_dir, cube): ...` — plans built inside
    read the given `MetricCube` for their windowed metric statistics."""

    def __init__(self, spark: SparkSession, sf_dir: str, cube):
        self.key, self.cube = (id(spark), sf_dir.rstrip("/")), cube

    def __enter__(self):
        Tables._cubes[self.key] = self.cube
        return self.cube

    def __exit__(self, *exc):
        Tables._cubes.pop(self.key, None)
        return False


def service_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SERVICE_MAP, "service string, check_service string")


SERVICE_MAP_SQL = "(values " + ", ".join(f"('{a}', '{b}')" for a, b in SERVICE_MAP) + ") sm(service, check_service)"


# DuckDB definitions of the same inputs (oracle side).  Only the flat forms
# are needed: oracle queries use `unnest`-free SQL over these.
FIXTURE_SQL = {
    "cost_aws_raw": (
        "select concat(cast(cast(l_shipdate as date) as varchar),'T00:00:00Z/P1D') identity_time_interval, "
        "p_type line_item_product_code, p_type product_servicecode, nullif(r_name,'ASIA') product_region_code, "
        "nullif(n_name,'NATION_3') product_location, "
        "case when l_linenumber=7 then 0 else l_extendedprice end line_item_blended_cost, "
        "case when l_linenumber=7 then 0 when l_discount=0.05 then null else l_extendedprice*l_discount end "
        "discount_bundled_discount, "
        "case when l_linenumber=7 then 0 else l_extendedprice*l_tax end discount_total_discount, "
        "l_orderkey,l_linenumber,l_partkey,l_suppkey "
        "from lineitem join part on p_partkey=l_partkey join supplier on s_suppkey=l_suppkey "
        "join nation on n_nationkey=s_nationkey join region on r_regionkey=n_regionkey"
    ),
    "cost_gcp_raw": (
        'select "d" as "Date", svc as "Service description", cost as "Cost (€)", disc as "Discounts (€)", '
        'promo as "Promotions and others (€)", subtotal as "Subtotal (€)", subtotal as "Unrounded subtotal (€)" from ('
        "select cast(cast(o_orderdate as date) as varchar) d, o_orderpriority svc, "
        "case when o_orderkey%97=0 then '1,234.5' when o_orderkey%89=0 then '1d' else cast(o_totalprice as varchar) end cost, "
        "cast(o_custkey as varchar) disc, cast(o_orderkey%50 as varchar) promo, 0.0 subtotal from orders "
        "union all select cast(cast(o_orderdate as date) as varchar), o_orderpriority, cast(o_totalprice as varchar), "
        "cast(o_custkey as varchar), cast(o_orderkey%50 as varchar), 0.0 from orders "
        "where o_orderkey%10=0 and o_orderkey%97<>0 and o_orderkey%89<>0)"
    ),
    "metric_points": "select 'fx' namespace, event_type metric, user_id resource_id, ts, value from events",
    "topology": (
        "select r_name cluster, n_name nodegroup, concat(n_name,'-asg') asg, c_custkey instance_id "
        "from region join nation on n_regionkey=r_regionkey join customer on c_nationkey=n_nationkey"
    ),
    "instances": (
        "select c_custkey instance_id, min(o_orderdate) launch_time, "
        "case when c_acctbal>0 then 'RUNNING' else 'STOPPED' end status, c_mktsegment='BUILDING' preemptible "
        "from customer join orders on o_custkey=c_custkey group by c_custkey,c_acctbal,c_mktsegment"
    ),
    "volumes": (
        "select c_custkey volume_id, c_custkey//3 instance_id, cast(floor(abs(c_acctbal)/10) as int) size_gb "
        "from customer"
    ),
    "snapshots": (
        "select o_orderkey snapshot_id,o_custkey volume_id,o_orderdate start_time, "
        "cast(floor(o_totalprice/20000) as int) size_gb from orders"
    ),
    "log_streams": "select conv_id%50 log_group, concat(conv_id,'-',turn) log_stream from conversations",
    "log_groups": (
        "select concat('/aws/eks/',r_name,case when r_regionkey<3 then '/cluster-x' else '-legacy' end) name "
        "from region"
    ),
    "lb_targets": (
        "select o_orderpriority lb, "
        "o_custkey + case when o_orderpriority='5-LOW' then 1000000000 else 0 end target_id, "
        "case when o_orderstatus='F' then 'healthy' else 'unhealthy' end state from orders"
    ),
    "objects": (
        "select source bucket, md5(text) key, doc_id version_id, n_chars size, doc_id%2=0 is_latest, "
        "case lang when 'en' then 'STANDARD' when 'de' then null else 'GLACIER' end storage_class, "
        "ts last_modified from documents left join events on event_id=doc_id*10"
    ),
    "uploads": (
        "select source bucket, documents.doc_id upload_id from documents "
        "join labels on labels.doc_id=documents.doc_id where toxic=1"
    ),
    "gateways": "select c_custkey gateway_id from customer",
    "addresses": (
        "select c_name public_ip, nullif(c_nationkey,3) instance_id, nullif(c_mktsegment,'BUILDING') "
        "network_interface_id, case when c_acctbal>5000 then c_custkey end association_id from customer"
    ),
    "routes_flat": (
        "select l_orderkey table_id, l_partkey destination, nullif(l_returnflag,'N') network_interface_id, "
        "case when l_linestatus='F' then l_suppkey end instance_id, "
        "case when l_tax>0.02 then l_partkey end nat_gateway_id, case when l_discount>0.02 then 1 end peering_id, "
        "case when l_linenumber=1 then 'blackhole' else 'active' end state from lineitem"
    ),
    "acl_flat": (
        "select l_orderkey acl_id, l_linenumber rule_number, l_linestatus='F' egress, "
        "case when l_returnflag='A' then 'allow' else 'deny' end rule_action, "
        "case when l_tax=0 then '0.0.0.0/0' else '10.0.0.0/8' end cidr_block from lineitem"
    ),
    "sg_flat": (
        "select l_orderkey group_id, l_linestatus='F' ingress, cast(l_quantity as int) n_cidr from lineitem"
    ),
    "rules": (
        "select p_partkey rule_name, case when p_type='PROMO' then 'CUSTOM_LAMBDA' else 'AWS' end owner from part"
    ),
    "evaluations": (
        "select l_partkey rule_name, case when l_returnflag='R' and l_linestatus='F' and l_linenumber=1 "
        "then 'NON_COMPLIANT' else 'COMPLIANT' end compliance from lineitem"
    ),
    "recorders": "select s_name name, s_acctbal>0 recording from supplier",
    "deliveries": "select user_id channel, max(ts) last_success from events group by user_id",
    "audit_events": (
        "select case event_type when 'click' then 'Encrypt' when 'view' then 'Decrypt' "
        "when 'purchase' then 'DescribeKey' when 'signup' then 'RotateKey' else 'Other' end event_name, "
        "user_id key_id, ts from events"
    ),
    "keys": "select c_custkey key_id from customer",
    "advisor_checks": "select p_partkey check_id, p_name name from part",
    "advisor_flagged": "select l_partkey check_id, l_orderkey resource_id from lineitem",
    "nodes": "select n_name node_name, '4' cpu, '8388608Ki' memory from nation",
    "containers": (
        "select n_name node_name, c_custkey pod, case when c_custkey%7<>0 then concat(c_custkey%100,'m') end cpu_req, "
        "case when c_custkey%7<>0 then concat(c_custkey%1024,'Mi') end mem_req "
        "from customer join nation on n_nationkey=c_nationkey"
    ),
    "pools": (
        "select distinct substr(n_name,1,length(n_name)-1) pool, "
        "case when n_regionkey<2 then 'n1-standard-64' else 'e2-small' end machine_type from nation"
    ),
    "log_entries": "select event_type log_name, event_id, ts from events",
}


def with_fixtures(sql: str, names: list[str]) -> str:
    """Prefix an oracle query with CTEs for the fixture tables it reads."""
    ctes = ",\n".join(f"{n} AS ({FIXTURE_SQL[n]})" for n in names)
    body = sql.lstrip()
    if body[:5].lower() == "with ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
