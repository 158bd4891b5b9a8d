"""DuckDB text builders for the oracle side of the metric-based queries.

These mirror the engine's definitions (window `[as_of - lookback, as_of)`,
epoch-aligned buckets, exact decimal sums) so the comparison is exact.
"""

from __future__ import annotations

from costlens.plans.registry import davg_, dsum_


def window_sql(as_of: str, lookback: str, ts: str = "ts") -> str:
    return f"{ts} >= timestamp '{as_of}' - interval '{lookback}' and {ts} < timestamp '{as_of}'"


def metrics_in(metrics) -> str:
    if metrics is None:
        return "true"
    return "metric in (" + ", ".join(f"'{m}'" for m in metrics) + ")"


def stats_sql(as_of: str, lookback: str = "1 day", period: str = "1 hour", metrics=None) -> str:
    return f"""select namespace, metric, resource_id, time_bucket(interval '{period}', ts) as bucket_start,
       {dsum_('value')} as sum, {davg_('value')} as avg, count(value) as cnt
  from metric_points where {window_sql(as_of, lookback)} and {metrics_in(metrics)}
  group by namespace, metric, resource_id, time_bucket(interval '{period}', ts)"""


def per_resource_sql(as_of: str, alias: dict, lookback: str = "1 day", period: str = "1 hour") -> str:
    cols = []
    for m, a in alias.items():
        w = f"metric = '{m}'"
        cols += [
            f"{davg_(f'case when {w} then avg end')} as {a}_avg",
            f"{dsum_(f'case when {w} then sum end')} as {a}_total",
            f"{dsum_(f'case when {w} then avg end')} as {a}_sum_avg",
            f"max(case when {w} then avg end) as {a}_max",
            f"max(case when {w} then sum end) as {a}_max_sum",
            f"count(case when {w} then 1 end) as {a}_buckets",
        ]
    return (
        f"select resource_id, {', '.join(cols)} from ({stats_sql(as_of, lookback, period, list(alias))}) st "
        f"group by resource_id"
    )


def whole_days_sql(earlier: str, later: str) -> str:
    return f"floor((epoch_us({later}) - epoch_us({earlier})) / 86400000000.0)"


# Kubernetes quantity text -> base units (mirror of costlens.functions.quantity).
_FACTORS = [
    ("n", "1e-9"), ("u", "1e-6"), ("m", "1e-3"), ("", "1.0"), ("k", "1e3"), ("M", "1e6"), ("G", "1e9"),
    ("T", "1e12"), ("P", "1e15"), ("E", "1e18"), ("Ki", "1024.0"), ("Mi", "1048576.0"),
    ("Gi", "1073741824.0"), ("Ti", "1099511627776.0"), ("Pi", "1125899906842624.0"),
    ("Ei", "1152921504606846976.0"),
]


def quantity_sql(col: str) -> str:
    s = f"trim({col})"
    num = f"try_cast(regexp_extract({s}, '^([+-]?[0-9.]+(?:[eE][+-]?[0-9]+)?)', 1) as double)"
    suf = f"regexp_extract({s}, '^[+-]?[0-9.]+(?:[eE][+-]?[0-9]+)?([A-Za-z]*)$', 1)"
    cases = " ".join(f"when '{k}' then {v}" for k, v in _FACTORS)
    return f"({num} * (case {suf} {cases} end))"


def cpu_milli_sql(col: str) -> str:
    return f"round({quantity_sql(col)} * 1000.0, 6)"


def mem_mib_sql(col: str) -> str:
    return f"round({quantity_sql(col)} / 1048576.0, 6)"
