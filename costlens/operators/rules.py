"""Rules: checks as data, compiled to one pass over each source (ALR-2, ALR-3).

A rule names a source, what it judges there, and the condition, observed value
and limit.  All rules of a source become one projection: an array of findings,
of which those that fire are kept and unfolded.  So a source is scanned (and
joined or aggregated) once, however many rules read it, and a report's plan has
a branch per source, not per check.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costlens.functions import exact, finite, lit_ts
from costlens.operators.findings import FINDING_COLUMNS, PROBLEMS, problem_text, union_findings
from costlens.operators.metrics import KEYS, MetricCube


@dataclass(frozen=True)
class Rule:
    """`check`: the problem's id (`EC2-2a`); `service`: whose overspend asks for it."""

    source: str
    service: str
    check: str
    rank: int
    resource: Column | str
    when: Column
    observed: Column | str | None = None
    limit: float | None = None

    def finding(self) -> Column:
        """A struct of the finding's columns and whether the rule fires."""
        column = lambda c: F.col(c) if isinstance(c, str) else c
        rid = column(self.resource).cast("string")
        seen = F.lit(None) if self.observed is None else column(self.observed)
        base = self.check[:-1] if self.check[-1] in "ab" and self.check[-2].isdigit() else self.check
        return F.struct(
            F.lit(self.service).alias("service"),
            F.lit(base).alias("check_name"),
            F.lit(self.rank).cast("int").alias("rule_rank"),
            rid.alias("resource_id"),
            problem_text(PROBLEMS[self.check], rid).alias("problem"),
            seen.cast("double").alias("observed"),
            F.lit(self.limit).cast("double").alias("threshold"),
            F.lit(self.check).alias("prompt_id"),
            F.coalesce(self.when, F.lit(False)).alias("fires"),
        )


def judge(source: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """The findings of all `rules` in one pass over `source`."""
    made = F.array(*[r.finding() for r in rules])
    found = source.select(F.inline(F.filter(made, lambda f: f["fires"])))
    return found.select(*FINDING_COLUMNS)


def compile_rules(sources: Mapping[str, Callable[[], DataFrame]], rules: Iterable[Rule]) -> DataFrame:
    """The findings of all rules; a source is built if a rule reads it, once."""
    by: dict[str, list[Rule]] = {}
    for r in rules:
        by.setdefault(r.source, []).append(r)
    return union_findings([judge(sources[name](), some) for name, some in by.items()])


def resource_stats(cube: MetricCube, as_of, metrics: Iterable[str]) -> DataFrame:
    """(resource_id, stats): every statistic that rules read, from one pass over the cells of a cube.

    stats maps each of `metrics` to a struct; over the last day: avg (mean of
    hourly means), total, max (largest hourly mean), buckets (hours with
    points), rate (largest per-second rate in 300 s), peak (largest point);
    over seven days: avg7, sumavg7 (sum of hourly means) and total7 (of daily
    sums).

    Cells are dealt by resource once; the buckets of 300 s, hours and days and
    the resource are grouped in that order without another shuffle, and a
    resource has a bounded number of cells.
    """
    cells = cube.window(as_of, "7 days").where(F.col("metric").isin(sorted(set(metrics))))
    last = F.col("cell_start") >= lit_ts(as_of) - F.expr("INTERVAL 1 DAY")
    fit = lambda n, f, s: F.when(F.sum(n) == F.sum(f), F.try_sum(s))  # noqa: E731  a sum out of range is null
    one = lambda c: F.when(last, F.col(c))
    bucket = lambda c, span: F.window(c, span).start
    five = (
        cells.repartition("resource_id")
        .groupBy(*KEYS, bucket("cell_start", "300 seconds").alias("b"))
        .agg(
            F.try_sum("vsum").alias("s7"), F.sum("vfit").alias("f7"), F.sum("vcnt").alias("c7"),
            F.try_sum(one("vsum")).alias("s1"), F.sum(one("vfit")).alias("f1"), F.sum(one("vcnt")).alias("c1"),
            F.count(F.when(last, 1)).alias("n1"), F.max(one("vmax")).alias("peak"),
        )
        .withColumn("rate", F.when(F.col("f1") == F.col("c1"), F.col("s1").cast("double") / F.lit(300.0)))
    )
    hours = (
        five.groupBy(*KEYS, bucket("b", "1 hour").alias("b"))
        .agg(
            F.try_sum("s7").alias("s7"), F.sum("f7").alias("f7"), F.sum("c7").alias("c7"),
            fit("f1", "c1", "s1").cast("double").alias("sum1"), F.sum("c1").alias("c1"), F.sum("n1").alias("n1"),
            F.max("rate").alias("rate"), F.max("peak").alias("peak"),
        )
        .withColumn("avg1", F.try_divide("sum1", F.col("c1").cast("double")))
        .withColumn("avg7", F.try_divide(F.when(F.col("f7") == F.col("c7"), F.col("s7").cast("double")), F.col("c7").cast("double")))
    )
    days = hours.groupBy(*KEYS, bucket("b", "1 day").alias("b")).agg(
        fit("f7", "c7", "s7").cast("double").alias("day7"),
        F.try_sum(exact("avg1")).alias("a1"), F.count(finite("avg1")).alias("k1"), F.max("avg1").alias("m1"),
        F.try_sum(exact("sum1")).alias("t1"), F.count(F.when(F.col("n1") > 0, 1)).alias("n1"),
        F.try_sum(exact("avg7")).alias("a7"), F.count(finite("avg7")).alias("k7"),
        F.max("rate").alias("rate"), F.max("peak").alias("peak"),
    )
    total = lambda c: F.try_sum(c).cast("double")
    each = days.groupBy("resource_id", "metric").agg(
        F.struct(
            F.try_divide(total("a1"), F.sum("k1").cast("double")).alias("avg"),
            total("t1").alias("total"),
            F.max("m1").alias("max"),
            F.sum("n1").alias("buckets"),
            F.max("rate").alias("rate"),
            F.max("peak").alias("peak"),
            F.try_divide(total("a7"), F.sum("k7").cast("double")).alias("avg7"),
            total("a7").alias("sumavg7"),
            total(exact("day7")).alias("total7"),
        ).alias("of")
    )
    # a resource's metrics, at most those named
    return each.groupBy("resource_id").agg(F.map_from_entries(F.collect_list(F.struct("metric", "of"))).alias("stats"))


def stat_columns(stats: DataFrame, metrics: Mapping[str, str], wanted: Iterable[str]) -> DataFrame:
    """(resource_id, the `wanted` columns): `<prefix>_<statistic>` of the metric with that prefix."""
    told = [w.rsplit("_", 1) for w in wanted]
    return stats.select(
        "resource_id", *[F.col("stats").getItem(metrics[prefix])[what].alias(f"{prefix}_{what}") for prefix, what in told]
    )
