"""Wide views for the charts.

`groupBy(row).pivot(col, values).agg(sum)` — one hash aggregate with a
partial (map-side) step.  Pivot values are passed explicitly so Spark does
not run an extra distinct job to discover them and so the output schema is
stable; pass `values=None` to let Spark discover them.

Semantics kept from pandas `groupby().sum().unstack()`: null keys are
dropped, an absent cell is null, a present cell whose values are all null
sums to 0 (hence `coalesce(x, 0)` inside the sum).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costlens.functions import dsum


def pivot_sum(
    df: DataFrame, row: str, col: str, value: str, values: Sequence | None = None
) -> DataFrame:
    d = df.filter(F.col(row).isNotNull() & F.col(col).isNotNull())
    d = d.withColumn("__v", F.coalesce(F.col(value), F.lit(0.0)))
    g = d.groupBy(row)
    g = g.pivot(col, list(values)) if values is not None else g.pivot(col)
    return g.agg(dsum("__v"))


def per_service(df: DataFrame, keys: Sequence[str] = ("service",)) -> DataFrame:
    """GRP-1: the reference splits the clean table into one frame per service
    and processes them one by one; here the service is a grouping column and
    all services run in one job.  Returns per-service row counts and cost."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), dsum("cost").alias("cost"))


def cost_by_date_service(clean: DataFrame, services: Sequence[str] | None = None) -> DataFrame:
    """AGG-1: AWS cost by date x product code."""
    return pivot_sum(clean.filter(F.col("provider") == "aws"), "date", "product_code", "cost", services)


def cost_by_service_location(clean: DataFrame, locations: Sequence[str] | None = None) -> DataFrame:
    """AGG-2: AWS cost by product code x location."""
    return pivot_sum(clean.filter(F.col("provider") == "aws"), "product_code", "location", "cost", locations)


def cost_by_date_service_gcp(clean: DataFrame, services: Sequence[str] | None = None) -> DataFrame:
    """AGG-3: GCP cost by date x service."""
    return pivot_sum(clean.filter(F.col("provider") == "gcp"), "date", "service", "cost", services)


def forecast_by_date(forecasts: DataFrame, services: Sequence[str] | None = None) -> DataFrame:
    """AGG-4: forecasts by date x service — all services in one job."""
    return pivot_sum(forecasts, "date", "service", "forecast", services)
