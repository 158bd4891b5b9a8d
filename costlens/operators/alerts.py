"""Alerts and the findings report.

The reference compares each service's forecast with its threshold and, for
an overspending service, runs that service's checks and asks for advice per
problem.  Here: forecasts ⨝ thresholds -> alerts; findings of every check in
one table, semi-joined with the alerting services; advice questions attached
from a fixed prompts table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costlens.operators.findings import FINDING_COLUMNS, PROBLEMS
from costlens.session import materialize


MAX_BROADCAST_SERVICES = 100_000


def overspend(forecasts: DataFrame, thresholds: DataFrame, service: str = "service") -> DataFrame:
    """ALR-1: a service overspends when any forecast row exceeds its threshold (strict).
    A service without a threshold stays, with a null threshold, and doesn't overspend.

    Both inputs hold one row per (service, step) / per service, so this is a
    join and an aggregate over services x horizon rows."""
    j = forecasts.join(thresholds.select(service, "threshold"), service, "left")
    over = F.coalesce(F.col("forecast") > F.col("threshold"), F.lit(False))
    return j.groupBy(service).agg(
        F.first("threshold").alias("threshold"),
        F.bool_or(over).alias("overspending"),
        F.max("forecast").alias("max_forecast"),
        F.min(F.when(over, F.col("date"))).alias("first_breach"),
    )


def alerting_services(alerts: DataFrame, service_map: DataFrame | None = None) -> list[str]:
    """Check services whose checks have to run: at most one name per service that has checks.

    The reference runs a service's checks only when it overspends; this short
    list lets the caller plan just those."""
    hot = alerts.filter(F.col("overspending")).select("service")
    if service_map is not None:
        hot = hot.join(service_map, "service").select(F.col("check_service").alias("service"))
    known = sorted(set(PREFIX_SERVICE.values()))
    names = hot.filter(F.col("service").isin(known)).distinct().limit(len(known)).toArrow()
    return sorted(names.column("service").to_pylist())


def findings_for(alerts: DataFrame, findings: DataFrame, service_map: DataFrame | None = None) -> DataFrame:
    """ALR-2: findings of overspending services only (left semi join).

    `service_map(service, check_service)` translates billing service names to
    the canonical service keys the checks use, when they differ."""
    hot = alerts.filter(F.col("overspending")).select("service")
    if service_map is not None:
        hot = hot.join(service_map, "service").select(F.col("check_service").alias("service"))
    # The set of alerting services is tiny (one row per service) but its plan
    # (clean -> daily series -> forecast) is not: materialise it once in the
    # shared checkpoint folder.
    hot = materialize(hot.distinct())
    # One row per alerting service; broadcast only behind a checked size (a
    # count of the checkpointed set), otherwise a plain join AQE can plan.
    if hot.count() <= MAX_BROADCAST_SERVICES:
        hot = F.broadcast(hot)
    # An inner join with the distinct service set is the semi join.  Written
    # as a semi join, the optimizer pushes it into every branch of a findings
    # union and never reaches a fixed point on a large union.
    return findings.join(hot, "service", "inner").select(*findings.columns)


def prompt_text(check: str, service: str) -> str:
    """Advice question for a problem type (sent to an external assistant by
    the reference; here it is data attached to each finding)."""
    title = PROBLEMS[check].replace("{id}", "a resource").rstrip(".:")
    return (
        f"How to fix '{title}' in {service}? Give details on how to identify the resources "
        f"involved and reduce the cost, and list best practices, tools or documentation that help."
    )


# Check -> service, used to build the prompts table.
# Check-id prefix -> the service whose overspend triggers it.
PREFIX_SERVICE = {
    "CW": "AmazonCloudWatch",
    "EC2": "AmazonEC2",
    "ADV": "AmazonEC2",
    "EKS": "AmazonEKS",
    "S3": "AmazonS3",
    "VPC": "AmazonVPC",
    "CFG": "AWSConfig",
    "KMS": "AWSKMS",
    "GCE": "ComputeEngine",
    "GKE": "KubernetesEngine",
    "NET": "Networking",
}


def service_of_check(check_id: str) -> str:
    """'EC2-4' / 'EKS-6a' -> the service the check belongs to."""
    return PREFIX_SERVICE[check_id.split("-", 1)[0]]


CHECK_SERVICE = {k: service_of_check(k) for k in PROBLEMS}


def prompts(spark) -> DataFrame:
    """Prompts table (prompt_id, prompt): one row per problem type — a fixed,
    bounded table (one row per check rule)."""
    rows = [(k, prompt_text(k, CHECK_SERVICE[k])) for k in PROBLEMS]
    return spark.createDataFrame(rows, "prompt_id string, prompt string")


def attach_prompt(findings: DataFrame, prompts_df: DataFrame) -> DataFrame:
    """ALR-5: attach the advice question of each finding's problem type.
    The prompts table has one row per rule (bounded), so it is broadcast."""
    return findings.join(F.broadcast(prompts_df), "prompt_id", "left")


def first_finding(findings: DataFrame) -> DataFrame:
    """ALR-4: the first finding per (service, check) — what the reference returns.

    An aggregate (`min_by` over a total order), not a window: a check with a
    third of all findings is combined map-side instead of sorted in one task."""
    order = F.struct("rule_rank", "resource_id", "prompt_id", "problem", "observed")
    payload = F.struct(*[c for c in FINDING_COLUMNS if c not in ("service", "check_name")])
    g = findings.groupBy("service", "check_name").agg(F.min_by(payload, order).alias("f"))
    return g.select("service", "check_name", "f.*").select(*FINDING_COLUMNS)


def report(findings: DataFrame, prompts_df: DataFrame) -> DataFrame:
    """ALR-3: one long report — every finding with its advice question."""
    return attach_prompt(findings, prompts_df)


def report_nested(findings: DataFrame, prompts_df: DataFrame) -> DataFrame:
    """ALR-3 (nested view): per service, the first finding of each check with
    its question.  Bounded lists: at most one entry per check rule."""
    f = attach_prompt(first_finding(findings), prompts_df)
    return f.groupBy("service").agg(
        F.sort_array(F.collect_list(F.struct("check_name", "resource_id", "problem", "prompt"))).alias("checks")
    )
