"""The two end-to-end jobs of the reference, as Spark jobs.

`cost_job`  — billing exports -> clean table -> daily series -> anomaly
              thresholds (isolation forest + closed-form search) and 7-day
              forecasts for every service at once -> written tables.
`alert_job` — forecasts x latest thresholds -> alerting services -> findings
              of those services with advice questions.

The clean table is read back from its written copy (a lineage cut in the
shared output folder) so the forest, the search and the forecasts do not
recompute the cleaning, and a lost executor only repeats its own stage.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costlens.operators import alerts as AL
from costlens.operators import anomaly as AN
from costlens.operators import clean as C
from costlens.operators import forecast as FC
from costlens.operators.findings import FINDING_SCHEMA, union_findings
from costlens.session import materialize
from costlens.sources import billing as B


def cost_job(
    spark: SparkSession,
    out_dir: str,
    aws_raw: DataFrame | None = None,
    gcp_raw: DataFrame | None = None,
    aws_order=None,
    starts: Mapping[str, float] = AN.THRESHOLD_STARTS,
    default_start: float | None = None,
    run_ts: str | None = None,
    forecaster: str = "arima",
) -> dict[str, DataFrame]:
    """Run the batch job; returns the written tables re-read as DataFrames."""
    out = out_dir.rstrip("/")
    B.write_clean(C.cost_clean(aws_raw, gcp_raw, aws_order), f"{out}/clean")
    clean = spark.read.parquet(f"{out}/clean")

    rows = clean.filter(F.col("cost").isNotNull()).withColumn("row_id", C.row_id())
    scored = AN.isolation_forest(rows, "service", "cost", "row_id")
    th = AN.calibrate_threshold(scored, "service", starts, default_start=default_start)
    B.append_thresholds(th, f"{out}/thresholds", run_ts)

    series = FC.daily_series(clean)
    fc = FC.arima_forecasts(series) if forecaster == "arima" else FC.ar1_forecast(series)
    B.write_forecasts(fc, f"{out}/forecasts")
    return {
        "clean": clean,
        "thresholds": spark.read.parquet(f"{out}/thresholds"),
        "forecasts": B.read_forecasts(spark, f"{out}/forecasts"),
    }


def alert_job(
    spark: SparkSession,
    forecasts: DataFrame,
    threshold_history: DataFrame,
    findings: Sequence[DataFrame] | Mapping[str, Callable[[], DataFrame]],
    service_map: DataFrame | None = None,
) -> DataFrame:
    """Forecasts vs the latest threshold of each service; report the findings
    of overspending services with their advice questions.

    `findings`: findings tables, or a builder of the findings table for each
    service, of which only the alerting services' ones are called."""
    alerts = AL.overspend(forecasts, B.latest_thresholds(threshold_history))
    if isinstance(findings, Mapping):
        alerts = materialize(alerts)
        names = AL.alerting_services(alerts, service_map)
        empty = spark.createDataFrame([], FINDING_SCHEMA)
        built = [findings[n]() for n in names if n in findings]
        return AL.report(union_findings([empty, *built]), AL.prompts(spark))
    hot = AL.findings_for(alerts, union_findings(list(findings)), service_map)
    return AL.report(hot, AL.prompts(spark))
