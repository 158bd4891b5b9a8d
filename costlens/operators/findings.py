"""The `findings` table and the helper every check uses.

findings(service, check_name, rule_rank int, resource_id, problem,
         observed double, threshold double, prompt_id)

A check is a filter / join / aggregate over *all* resources at once; `flag`
turns its qualifying rows into findings.  Problem texts carry the resource id;
the numbers live in `observed` / `threshold` so texts never depend on how a
double is printed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINDING_COLUMNS = [
    "service",
    "check_name",
    "rule_rank",
    "resource_id",
    "problem",
    "observed",
    "threshold",
    "prompt_id",
]

FINDING_SCHEMA = (
    "service string, check_name string, rule_rank int, resource_id string, problem string, "
    "observed double, threshold double, prompt_id string"
)

# Canonical service keys (one key per service; the reference's writers and
# reader spell some differently, SURVEY 2.5).
SERVICES = [
    "AmazonCloudWatch",
    "AmazonEC2",
    "AmazonEKS",
    "AmazonS3",
    "AmazonVPC",
    "AWSConfig",
    "AWSKMS",
    "ComputeEngine",
    "KubernetesEngine",
    "Networking",
]

# Problem titles of the checks, as the reference words them,
# with `{id}` where the reference names the resource and without the numbers
# it prints (those are in `observed`).
PROBLEMS = {
    "CW-1": "Excessive Metrics Collection",
    "CW-2": "Excessive Number of Log Groups",
    "CW-3": "Excessive Number of Log Streams",
    "CW-4": "High Frequency Data Points",
    "EC2-1": "Instance {id} is potentially over-provisioned or underutilized.",
    "EC2-2a": "High Inbound Data Transfer",
    "EC2-2b": "High Outbound Data Transfer",
    "EC2-3": "Instance ID: {id}, old instance",
    "EC2-4a": "Volume ID: {id}, unoptimized volume",
    "EC2-4b": "Volume ID: {id}, unoptimized volume",
    "EC2-5": "Snapshot ID: {id}, old snapshot",
    "EKS-1": "Over-Provisioned and Idle Resources Detected",
    "EKS-2": "High Data Transfer Costs Detected in Amazon EKS",
    "EKS-3": "Instance {id} is not part of the cluster.",
    "EKS-4": "Instance {id} is not healthy in the load balancer.",
    "EKS-5": "Insufficient monitoring for instance {id}. Ensure CloudWatch agent is installed and configured.",
    "EKS-6a": "Instance {id} is overutilized for CPU.",
    "EKS-6b": "Instance is overutilized for memory.",
    "EKS-7": "High data transfer for instance {id}.",
    "EKS-8": "Insufficient logging for cluster {id}. Ensure CloudWatch logging is enabled.",
    "EKS-9": "High count for cluster {id}.",
    "EKS-11": "Volume {id} is idle for more than 12 hours.",
    "S3-1": "Inefficient Storage Class in {id}",
    "S3-2": "Incomplete Multipart Uploads in {id}",
    "S3-4": "Object replicated across buckets: {id}",
    "S3-5": "Excessive Requests in {id}",
    "VPC-1": "Inefficient Use of NAT Gateway {id}",
    "VPC-2": "Unused Elastic IP Addresses: {id}",
    "VPC-3": "Inefficient Use of VPN Connections in {id}",
    "VPC-4a": "High data transfer detected (IN) at {id}",
    "VPC-4b": "High data transfer detected (OUT) at {id}",
    "VPC-5": "High Number of Endpoints",
    "VPC-6": "Unused route: {id}",
    "VPC-7": "Blackhole route: {id}",
    "VPC-8": "Overly permissive rule: {id}",
    "VPC-9": "Overly permissive egress rule: {id}",
    "VPC-10a": "Security Group {id} has numerous rules:",
    "VPC-10b": "Security Group {id} has numerous rules:",
    "VPC-11a": "Security Group {id} has complex ingress CIDR blocks.",
    "VPC-11b": "Security Group {id} has complex egress CIDR blocks.",
    "VPC-12": "Excessive Traffic Monitoring in {id}",
    "CFG-1": "High Number of Resources in AWS Config",
    "CFG-2": "Inefficient Custom Rules in AWS Config",
    "CFG-3": "Configuration Recorder {id} is not recording.",
    "CFG-4": "Retention period exceeds the threshold of 30 days.",
    "KMS-1": "High Number of Customer Managed Keys",
    "KMS-2": "High Number of {id} Operations in the last 24 hours.",
    "KMS-4": "Key {id} has been rotated more than once in the past year.",
    "ADV-1": "Advisor flagged resource {id}",
    "GCE-1": "Instance: {id} is underutilized",
    "GCE-2": "Instance: {id} is overutilized",
    "GCE-3": "Instance: {id} has high data transfer egress",
    "GCE-4": "Instance: {id} has low disk usage",
    "GCE-5": "Snapshot: {id} is large",
    "GKE-2": "Node: {id} is over-provisioned",
    "GKE-3": "Node: {id} is an idle high-performance machine",
    "GKE-4": "High network egress detected in cluster: {id}",
    "GKE-5a": "Excessive logging detected in cluster: {id}",
    "GKE-5b": "Excessive monitoring detected in cluster: {id}",
    "NET-1": "High Egress Data Transfer",
    "NET-2": "High Ingress Data Transfer",
    "NET-3": "Excessive Logging",
}


def problem_text(template: str, resource_id: Column) -> Column:
    """ALR-6: render a problem title; `{id}` becomes the resource id."""
    parts = template.split("{id}")
    cols: list[Column] = [F.lit(parts[0])]
    for p in parts[1:]:
        cols += [resource_id, F.lit(p)]
    return F.concat(*cols)


def flag(
    df: DataFrame,
    service: str,
    check: str,
    rank: int,
    resource_id,
    observed=None,
    threshold=None,
    problem: str | None = None,
) -> DataFrame:
    """Turn qualifying rows into `findings` rows."""
    rid = (F.col(resource_id) if isinstance(resource_id, str) else resource_id).cast("string")
    obs = F.lit(None) if observed is None else (F.col(observed) if isinstance(observed, str) else observed)
    thr = F.lit(None) if threshold is None else (threshold if isinstance(threshold, Column) else F.lit(threshold))
    template = problem if problem is not None else PROBLEMS[check]
    base = check.rstrip("ab") if check[-1] in "ab" and check[-2].isdigit() else check
    return df.select(
        F.lit(service).alias("service"),
        F.lit(base).alias("check_name"),
        F.lit(rank).cast("int").alias("rule_rank"),
        rid.alias("resource_id"),
        problem_text(template, rid).alias("problem"),
        obs.cast("double").alias("observed"),
        thr.cast("double").alias("threshold"),
        F.lit(check).alias("prompt_id"),
    )


def union_findings(parts: list[DataFrame]) -> DataFrame:
    """ALR-3: every check's findings in one table.

    Unioned as a balanced tree so the plan is analysed O(n log n), not O(n²),
    when dozens of checks are combined."""
    parts = [p.select(*FINDING_COLUMNS) for p in parts]
    while len(parts) > 1:
        parts = [parts[i].union(parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


# --------------------------------------------------------------- oracle side
def problem_sql(template: str, id_sql: str) -> str:
    parts = template.split("{id}")
    out = [f"'{parts[0]}'"]
    for p in parts[1:]:
        out += [id_sql, f"'{p}'"]
    return " || ".join(out)


def flag_sql(service, check, rank, id_expr, obs_expr="null", thr="null", template=None) -> str:
    """Select list producing `findings` columns in DuckDB."""
    template = template if template is not None else PROBLEMS[check]
    base = check.rstrip("ab") if check[-1] in "ab" and check[-2].isdigit() else check
    rid = f"cast({id_expr} as varchar)"
    return (
        f"'{service}' as service, '{base}' as check_name, cast({rank} as integer) as rule_rank, "
        f"{rid} as resource_id, {problem_sql(template, rid)} as problem, "
        f"cast({obs_expr} as double) as observed, cast({thr} as double) as threshold, "
        f"'{check}' as prompt_id"
    )
