"""Planning only the alerting services' checks gives the filtered full findings table."""

from pyspark.sql import functions as F

from costlens.operators import alerts as AL
from costlens.plans import q_models as QM

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_findings_of_selected_services(spark):
    svcs = ["AmazonS3", "Networking"]
    part = QM.all_findings(spark, SF, services=svcs)
    full = QM.all_findings(spark, SF).filter(F.col("service").isin(svcs))
    assert _rows(part) == _rows(full)
    assert {r["service"] for r in part.select("service").distinct().collect()} <= set(svcs)


def test_no_alerting_service_gives_empty_findings(spark):
    e = QM.all_findings(spark, SF, services=[])
    assert e.count() == 0 and e.columns == QM.all_findings(spark, SF, services=["AWSKMS"]).columns


def test_every_check_maps_to_a_service():
    for n in QM.FINDING_QUERIES:
        from costlens.plans.registry import REGISTRY

        assert AL.service_of_check(REGISTRY[n].ops[0]) in AL.PREFIX_SERVICE.values()


def test_compiled_rules_equal_the_check_functions(spark):
    got, want = _rows(QM.all_findings(spark, SF)), _rows(QM.union_of_checks(spark, SF))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert len({r[7] for r in got}) >= 40  # most problems occur


def test_every_problem_has_a_rule():
    from costlens.operators import report as RP
    from costlens.operators.findings import PROBLEMS

    made = RP.rules(QM.fixture_setup())
    assert {r.check for r in made} == set(PROBLEMS)
    assert {r.service for r in made} == set(AL.PREFIX_SERVICE.values())
    assert all(r.service == AL.service_of_check(r.check) for r in made)


def test_defaults_are_the_checks_defaults():
    """The library's limits without a setup are those of the check functions."""
    import inspect

    from costlens.operators import report as RP
    from costlens.operators.checks import aws as A
    from costlens.operators.checks import gcp as G

    lim = RP.Setup("2024-01-01").limits
    told = {
        "CW-1": A.excessive_metrics, "CW-2": A.excessive_log_groups, "CW-3": A.excessive_log_streams, "CW-4": A.high_data_points,
        "EC2-1": A.low_cpu, "EC2-2": A.high_transfer, "EKS-2": A.cluster_transfer, "EKS-6": A.overutilized, "EKS-7": A.hourly_transfer,
        "EKS-9": A.cluster_counts, "VPC-1": A.idle_nat, "VPC-3": A.idle_vpn, "VPC-4": A.vpn_packets, "VPC-5": A.many_endpoints,
        "VPC-11": A.many_cidrs, "VPC-12": A.flow_log_volume, "CFG-1": A.many_resources, "KMS-1": A.many_keys, "KMS-2": A.busy_operations,
        "KMS-4": A.frequent_rotation, "S3-4": A.replicated_keys, "GCE-1": G.underutilized, "GCE-2": G.overutilized_preemptible,
        "GKE-3": G.idle_large_nodes, "GKE-4": G.cluster_egress, "GKE-5": G.cluster_logging, "NET-1": G.egress_rate,
        "NET-2": G.ingress_rate, "NET-3": G.excessive_logging,
    }
    for check, fn in told.items():
        assert inspect.signature(fn).parameters["limit"].default == lim[check], check


def test_one_scan_per_source(spark):
    """A branch per source: the points are scanned once for the cube, an inventory once per source that reads it."""
    plan = QM.all_findings(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    from costlens.operators import report as RP

    made = RP.rules(QM.fixture_setup())
    sources = {r.source for r in made}
    assert plan.count("Generate inline") == len(sources) < 0.6 * len(made)
