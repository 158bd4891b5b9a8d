"""Registered queries: anomaly thresholds, forecasts, alerts and the report
(ANO-*, TS-*, AGG-4, ALR-*, SRC-6/7)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from costlens.operators import alerts as AL
from costlens.operators import anomaly as AN
from costlens.operators import clean as C
from costlens.operators import forecast as FC
from costlens.operators import pivots as P
from costlens.operators import report as RP
from costlens.operators.findings import union_findings
from costlens.plans.q_billing import AWS_ORDER, AWS_SERVICES, CLEAN_AWS_SQL, CLEAN_GCP_SQL, GCP_SERVICES, aws_clean, gcp_clean
from costlens.functions import dsum
from costlens.plans.registry import REGISTRY, d_, dsum_, query
from costlens.session import materialize, scratch_folder
from costlens.sources import billing as B
from costlens.sources.fixtures import SERVICE_MAP_SQL, Tables, service_map

# ------------------------------------------------------------------ ANO-3..6
# Search starts for the metric stand-ins: some at or above 0 (the start comes
# back), some below 0 (the search runs its 100 steps).
METRIC_STARTS = {"click": 0.3, "error": -0.3, "purchase": 0.0, "signup": -5.0, "view": 10.0}


def _lowered_py(start: float) -> float:
    t = start
    for _ in range(AN.MAX_ITERATIONS):
        t -= AN.STEP
    return t


_STARTS_SQL = "(values " + ", ".join(
    f"('{m}', {s!r}::double, {_lowered_py(s)!r}::double)" for m, s in METRIC_STARTS.items()
) + ") st(metric, start, low)"


def _ratio_sql(h: str) -> str:
    return f"case when {h} = 0 then 0.0 when labelled = 0 then null else 100.0::double * {h} / labelled end"


@query(
    "ano3_6_thresholds",
    "ANO-3 ANO-4 ANO-5 ANO-6",
    ["metric_points"],
    f"""with off as (select metric, quantile_cont(value, 0.2) as offset from metric_points group by metric),
lab as (select p.metric, p.value - o.offset as score,
               case when p.value - o.offset < 0 then -1 else 1 end as anomaly
        from metric_points p join off o on o.metric = p.metric),
g as (select l.metric, st.start, st.low, count(*) filter (where score < st.start) as h0,
             count(*) filter (where score < st.low) as h1, count(*) filter (where anomaly = -1) as labelled
      from lab l join {_STARTS_SQL} on st.metric = l.metric group by l.metric, st.start, st.low)
select g.metric, round(o.offset, 6) as offset, labelled,
       case when {_ratio_sql('h0')} is null or {_ratio_sql('h0')} >= 95 then start else low end as threshold,
       case when {_ratio_sql('h0')} is null or {_ratio_sql('h0')} >= 95 then {_ratio_sql('h0')} else {_ratio_sql('h1')} end
         as accuracy
from g join off o on o.metric = g.metric""",
)
def ano3_6_thresholds(spark, sf_dir):
    """Metric values as raw scores per metric: 20 % offset, labels, closed-form threshold search."""
    pts = Tables(spark, sf_dir).metric_points.select("metric", F.col("value").alias("raw"))
    lab = AN.with_decision(pts, "metric", "raw", 0.2)
    cal = AN.calibrate_threshold(lab, "metric", METRIC_STARTS)
    off = AN.contamination_offset(pts, "metric", "raw").select("metric", F.round("offset", 6).alias("offset"))
    return cal.join(off, "metric")


SERVICES = [*AWS_SERVICES, *GCP_SERVICES]


def both_clean(t: Tables):
    """The clean tables of both providers, as the batch job writes them."""
    return aws_clean(t).unionByName(gcp_clean(t))


def _cost_rows(t: Tables):
    c = both_clean(t).where("cost is not null")
    return c.withColumn("row_id", C.row_id())


@query("ano1_2_isolation_forest", "ANO-1 ANO-2 ANO-3 ANO-4")
def ano1_2_isolation_forest(spark, sf_dir):
    """Isolation forest per service over every clean cost row of both providers (rows-only check)."""
    return AN.isolation_forest(_cost_rows(Tables(spark, sf_dir)), "service", "cost", "row_id")


@query("ano6_forest_thresholds", "ANO-1 ANO-2 ANO-5 ANO-6")
def ano6_forest_thresholds(spark, sf_dir):
    """Forest decision values per service -> calibrated threshold per service."""
    t = Tables(spark, sf_dir)
    scored = AN.isolation_forest(_cost_rows(t), "service", "cost", "row_id")
    starts = {s: 0.3 if i % 2 == 0 else -0.05 for i, s in enumerate(SERVICES)}
    return AN.calibrate_threshold(scored, "service", starts)


# ------------------------------------------------------------------ TS
def series(t: Tables):
    return FC.daily_series(both_clean(t))


SERIES_SQL = (
    f"select service, date, {dsum_('cost')} as y "
    f"from ({CLEAN_AWS_SQL} union all {CLEAN_GCP_SQL}) c where cost is not null group by service, date"
)


@query("ts1_daily_series", "TS-1", ["cost_aws_raw", "cost_gcp_raw"], f"select service, {d_('date')} as date, y from ({SERIES_SQL}) s")
def ts1_daily_series(spark, sf_dir):
    """Daily cost per service (one time step per date, D6)."""
    return series(Tables(spark, sf_dir))


@query(
    "ts3_sqrt",
    "TS-3",
    ["cost_aws_raw", "cost_gcp_raw"],
    f"select service, {d_('date')} as date, case when y >= 0 then sqrt(y) end as sqrt_y from ({SERIES_SQL}) s",
)
def ts3_sqrt(spark, sf_dir):
    """Variance-stabilising square root of the daily series."""
    return series(Tables(spark, sf_dir)).select("service", "date", FC.sqrt_transform("y").alias("sqrt_y"))


@query(
    "ts4_difference",
    "TS-4",
    ["cost_aws_raw", "cost_gcp_raw"],
    f"""select service, {d_('date')} as date, y, dy from (
  select *, d1 - lag(d1) over (partition by service order by date) as dy from (
    select *, y - lag(y) over (partition by service order by date) as d1 from ({SERIES_SQL}) s) a
  where d1 is not null) b where dy is not null""",
)
def ts4_difference(spark, sf_dir):
    """Second difference of the daily series (first two rows per service dropped)."""
    return FC.difference(series(Tables(spark, sf_dir)), 2).select("service", "date", "y", "dy")


ACF_SQL = f"""with s as (select service, date, y, row_number() over (partition by service order by date) - 1 as i,
                count(*) over (partition by service) as n, avg(y) over (partition by service) as mu from ({SERIES_SQL}) x),
z as (select service, i, n, y - mu as z from s),
den as (select service, sum(z * z) as den from z group by service),
lags as (select service, unnest(range(0, greatest(cast(floor(n / 2.0 - 1) as bigint), 0) + 1)) as k
         from (select distinct service, n from z) d),
num as (select a.service, l.k, sum(a.z * b.z) as num, max(a.n) as n
        from lags l join z a on a.service = l.service and a.i >= l.k
        join z b on b.service = a.service and b.i = a.i - l.k group by a.service, l.k)
select num.service, k as lag, num / den as acf, n from num join den on den.service = num.service"""


@query(
    "ts9_acf",
    "TS-9",
    ["cost_aws_raw", "cost_gcp_raw"],
    f"select service, lag, round(acf, 8) as acf, n from ({ACF_SQL}) x",
)
def ts9_acf(spark, sf_dir):
    """Autocorrelation of each daily series for lags 0..n/2−1."""
    a = FC.acf(series(Tables(spark, sf_dir)))
    return a.select("service", "lag", F.round("acf", 8).alias("acf"), "n")


@query(
    "ts10_choose_q",
    "TS-10",
    ["cost_aws_raw", "cost_gcp_raw"],
    f"""select service, greatest(coalesce(min(case when acf < 1.96 / sqrt(n) then lag end) - 1, 0), 0) as "order",
               max(n) as n from ({ACF_SQL}) x group by service""",
)
def ts10_choose_q(spark, sf_dir):
    """MA order from the first autocorrelation under 1.96/√n."""
    return FC.choose_order(FC.acf(series(Tables(spark, sf_dir))))


# The running total of a service's daily cost: a series whose orders aren't zero.
RUNNING_SQL = f"select service, date, sum(y) over (partition by service order by date) as y from ({SERIES_SQL}) d"


def running(t: Tables):
    w = Window.partitionBy("service").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return series(t).select("service", "date", F.sum("y").over(w).alias("y"))


PACF_SQL = f"""with recursive a as (select service, n, list(acf order by lag) as r from (
    {ACF_SQL.replace(SERIES_SQL, RUNNING_SQL)}) c group by service, n),
d as (select service, n, r, 1 as k, [r[2]] as f, r[2] as p from a where len(r) > 1
  union all
  select service, n, r, k + 1, list_concat(list_transform(f, lambda x, i: x - q * f[k + 1 - i]), [q]), q
  from (select *, (r[k + 2] - list_sum(list_transform(f, lambda x, i: x * r[k + 2 - i])))
               / (1 - list_sum(list_transform(f, lambda x, i: x * r[i + 1]))) as q from d where k + 1 < len(r)) e)
select service, 0 as lag, 1.0::double as pacf, n from a union all select service, k as lag, p as pacf, n from d"""


@query(
    "ts7_pacf",
    "TS-7",
    ["cost_aws_raw", "cost_gcp_raw"],
    f"select service, lag, round(pacf, 6) as pacf, n from ({PACF_SQL}) x",
)
def ts7_pacf(spark, sf_dir):
    """Partial autocorrelation of each service's running total, lags 0..n/2−1."""
    p = FC.pacf(running(Tables(spark, sf_dir)))
    return p.select("service", "lag", F.round("pacf", 6).alias("pacf"), "n")


@query(
    "ts8_choose_p",
    "TS-8",
    ["cost_aws_raw", "cost_gcp_raw"],
    f"""select service, greatest(coalesce(min(case when pacf < 1.96 / sqrt(n) then lag end) - 1, 0), 0) as "order",
               max(n) as n from ({PACF_SQL}) x group by service""",
)
def ts8_choose_p(spark, sf_dir):
    """AR order from the first partial autocorrelation under 1.96/√n, on each service's running total."""
    return FC.choose_order(FC.pacf(running(Tables(spark, sf_dir))), value="pacf")


AR1_SQL = f"""with l as (select service, date, y, lag(y) over (partition by service order by date) as ylag from ({SERIES_SQL}) s),
f as (select service, regr_intercept(y, ylag) as c, regr_slope(y, ylag) as phi, arg_max(y, date) as last_y,
             max(date) as last_date from l group by service)
select service, last_date + cast(step as integer) as date, cast(step as integer) as step,
       c / (1 - phi) + power(phi, cast(step as double)) * (last_y - c / (1 - phi)) as forecast
from f, range(1, 8) r(step)"""


@query(
    "ts14_15_ar1_forecast",
    "TS-14 TS-15",
    ["cost_aws_raw", "cost_gcp_raw"],
    f"select service, {d_('date')} as date, step, round(forecast, 2) as forecast from ({AR1_SQL}) x",
)
def ts14_15_ar1_forecast(spark, sf_dir):
    """AR(1) by conditional least squares, 7 dated forecast steps per service."""
    f = FC.ar1_forecast(series(Tables(spark, sf_dir)))
    return f.withColumn("forecast", F.round("forecast", 2))


@query(
    "ts2_adf_lag0",
    "TS-2",
    ["cost_aws_raw", "cost_gcp_raw"],
    f"""with l as (select service, y - lag(y) over (partition by service order by date) as dy,
                  lag(y) over (partition by service order by date) as ylag from ({SERIES_SQL}) s),
g as (select service, regr_count(dy, ylag) as nobs, regr_slope(dy, ylag) as beta, regr_sxx(dy, ylag) as sxx,
             regr_syy(dy, ylag) as syy, regr_sxy(dy, ylag) as sxy from l group by service)
select service, nobs, round(beta, 9) as beta,
       round(beta / sqrt((syy - sxy * sxy / sxx) / (nobs - 2) / sxx), 6) as tau from g""",
)
def ts2_adf_lag0(spark, sf_dir):
    """Dickey-Fuller statistic (no augmentation lags) per service."""
    a = FC.adf_lag0(series(Tables(spark, sf_dir)))
    return a.select("service", "nobs", F.round("beta", 9).alias("beta"), F.round("tau", 6).alias("tau"))


# ------------------------------------------------------------------ AGG-4
def _adf_sql(source: str) -> str:
    """tau, lag and nobs per key `k` of `source` (k, date, y), by elimination on the moments of the lagged columns."""

    def vectors(most: str, order: str) -> str:
        """Centred columns: 0 the level, 1.. the lags, -1 the target, at the place that `order` gives."""
        part = f"""case c when 0 then ys[{most} + 1 : n - 1]
                   when -1 then dys[{most} + 1 : n - 1] else dys[{most} - c + 1 : n - 1 - c] end"""
        return f"""select k, n, {most} as lags, {order} as place, list_transform(x, lambda v: v - list_avg(x)) as x
            from (select *, {part} as x from (select *, unnest(range(-1, {most} + 1)) as c from {{}}))"""

    def eliminated(v: str) -> str:
        """The matrix of moments after each number p of pivots, less the pivots' rows and columns."""
        return f"""select k, any_value(n) as n, any_value(lags) as lags, 0 as p, list(r order by place) as a from (
              select a.k, a.place, any_value(a.n) as n, any_value(a.lags) as lags,
                     list(list_inner_product(a.x, b.x) order by b.place) as r
              from {v} a join {v} b on a.k = b.k group by a.k, a.place) group by k
          union all
          select k, n, lags, p + 1,
                 list_transform(a[2:], lambda r: list_transform(r[2:], lambda z, j: z - r[1] * a[1][j + 1] / a[1][1]))
          from {{}} where p <= lags"""

    first = "case c when -1 then 1000000 else c end"  # level, lags, target
    second = "case c when -1 then 1000001 when 0 then 1000000 else c end"  # lags, level, target
    return f"""with recursive adf_s as (
  select k, date, y, y - lag(y) over (partition by k order by date) as dy from ({source}) x),
adf_g as (select k, count(*) as n, list(y order by date) as ys, list(dy order by date) filter (where dy is not null) as dys
  from adf_s group by k),
adf_l as (select *, cast(greatest(least(ceil(12 * power(n / 100.0, 0.25)), floor(n / 2) - 2), 0) as bigint) as most
  from adf_g where n >= 6),
adf_v as materialized ({vectors('most', first).format('adf_l')}),
adf_e as ({eliminated('adf_v').format('adf_e')}),
adf_b as (select k, arg_min(p - 1, (n - 1 - lags) * ln(a[-1][-1] / (n - 1 - lags)) + 2 * (p + 1)) as best
  from adf_e where p > 0 and n - 1 - lags > p + 1 group by k),
adf_w as materialized ({vectors('best', second).format('(select * from adf_l join adf_b using (k))')}),
adf_f as ({eliminated('adf_w').format('adf_f')})
select k, lags as lag, n - 1 - lags as nobs,
       a[1][2] / a[1][1] / sqrt((a[2][2] - a[1][2] * a[1][2] / a[1][1]) / (n - 3 - 2 * lags) / a[1][1]) as tau
from adf_f where p = lags"""


@query(
    "ts2_adf",
    "TS-2",
    ["cost_aws_raw", "cost_gcp_raw"],
    f"""select k as service, cast(lag as integer) as lag, cast(nobs as integer) as nobs, round(tau, 4) as tau,
               tau <= -2.861592763096974 as stationary
        from ({_adf_sql(f"select service as k, date, y from ({RUNNING_SQL}) r")}) a""",
)
def ts2_adf(spark, sf_dir):
    """Augmented Dickey-Fuller test of each service's running total, lag by AIC."""
    a = FC.adf(running(Tables(spark, sf_dir)))
    return a.select("service", "lag", "nobs", F.round("tau", 4).alias("tau"), "stationary")


# The running total and its first and second differences, as series of their own.
DIFFERENCED_SQL = f"""with d0 as (select service, date, y from ({RUNNING_SQL}) r),
d1 as (select service, date, y - lag(y) over (partition by service order by date) as y from d0),
d2 as (select service, date, y - lag(y) over (partition by service order by date) as y from d1)
select service || '|0' as k, date, y from d0
union all select service || '|1', date, y from d1 where y is not null
union all select service || '|2', date, y from d2 where y is not null"""


CHOSEN_D_SQL = f"""select split_part(k, '|', 1) as service, cast(split_part(k, '|', 2) as integer) as d, lag, tau
from ({_adf_sql(DIFFERENCED_SQL)}) a
qualify row_number() over (partition by split_part(k, '|', 1) order by
  case when tau <= -2.861592763096974 then split_part(k, '|', 2) when k like '%|2' then '3' else '4' end) = 1"""


@query(
    "ts6_choose_d",
    "TS-2 TS-4 TS-6",
    ["cost_aws_raw", "cost_gcp_raw"],
    f"""select service, n, d, cast(lag as integer) as lag, round(tau, 4) as tau from ({CHOSEN_D_SQL}) c
        join (select service, count(*) as n from ({RUNNING_SQL}) r group by service) t using (service)""",
)
def ts6_choose_d(spark, sf_dir):
    """Differences until the test calls a service's running total stationary."""
    c = FC.choose_d(running(Tables(spark, sf_dir)))
    return c.select("service", "n", "d", "lag", F.round("tau", 4).alias("tau"))


CHOSEN_SERIES_SQL = f"""select c.service, date, y from ({CHOSEN_D_SQL}) c
join ({DIFFERENCED_SQL}) v on v.k = c.service || '|' || c.d"""


def _order_sql(corr: str, value: str) -> str:
    return f"""select service, cast(greatest(coalesce(min(case when {value} < 1.96 / sqrt(n) then lag end) - 1, 0), 0) as integer)
        as ord from ({corr}) x group by service"""


@query(
    "ts6_10_model_orders",
    "TS-2 TS-4 TS-6 TS-7 TS-8 TS-9 TS-10",
    ["cost_aws_raw", "cost_gcp_raw"],
    f"""with chosen_series as materialized ({CHOSEN_SERIES_SQL}), chosen_d as ({CHOSEN_D_SQL})
        select d.service, p.ord as p, d.d, q.ord as q from chosen_d d
        join ({_order_sql(PACF_SQL.replace(RUNNING_SQL, 'select * from chosen_series'), 'pacf')}) p using (service)
        join ({_order_sql(ACF_SQL.replace(SERIES_SQL, 'select * from chosen_series'), 'acf')}) q using (service)""",
)
def ts6_10_model_orders(spark, sf_dir):
    """Orders (p, d, q) of each service's running total, without Python."""
    return FC.model_orders(running(Tables(spark, sf_dir)))


def forecasts(t: Tables, s=None):
    s = series(t) if s is None else s
    return FC.ar1_forecast(s).withColumn("forecast", F.round("forecast", 2))


FORECASTS_SQL = f"select service, date, step, round(forecast, 2) as forecast from ({AR1_SQL}) x"


@query(
    "agg4_forecast_by_date",
    "AGG-4",
    ["cost_aws_raw", "cost_gcp_raw"],
    f"select {d_('date')} as date, "
    + ", ".join(
        dsum_(f"case when service = '{s}' then coalesce(forecast, 0.0) end") + f' as "{s}"'
        for s in SERVICES
    )
    + f" from ({FORECASTS_SQL}) f group by date",
)
def agg4_forecast_by_date(spark, sf_dir):
    """All services' forecasts by date, wide, in one job."""
    return P.forecast_by_date(forecasts(Tables(spark, sf_dir)), SERVICES)


# ------------------------------------------------------------------ ALR
def thresholds(t: Tables, s=None):
    """Fixture thresholds: the median of each service's daily cost."""
    s = series(t) if s is None else s
    return s.groupBy("service").agg(F.round(F.percentile("y", 0.5), 2).alias("threshold"))


THRESHOLDS_SQL = f"select service, round(quantile_cont(y, 0.5), 2) as threshold from ({SERIES_SQL}) s group by service"

ALERTS_SQL = f"""select f.service, max(t.threshold) as threshold, bool_or(f.forecast > t.threshold) as overspending,
       max(f.forecast) as max_forecast, min(case when f.forecast > t.threshold then f.date end) as first_breach
from ({FORECASTS_SQL}) f join ({THRESHOLDS_SQL}) t on t.service = f.service group by f.service"""


def alerts(t: Tables):
    # The daily series (one row per service and day) feeds both the forecasts
    # and the thresholds: written once, so the billing input is read once.
    s = materialize(series(t))
    return AL.overspend(forecasts(t, s), thresholds(t, s))


@query(
    "alr1_overspend",
    "ALR-1",
    ["cost_aws_raw", "cost_gcp_raw"],
    f"select service, threshold, overspending, max_forecast, {d_('first_breach')} as first_breach from ({ALERTS_SQL}) a",
)
def alr1_overspend(spark, sf_dir):
    """Forecast vs threshold per service: any step strictly above it."""
    return alerts(Tables(spark, sf_dir))


@query("ano6_alr1_end_to_end", "ANO-1 ANO-2 ANO-5 ANO-6 ALR-1")
def ano6_alr1_end_to_end(spark, sf_dir):
    """Forest thresholds of every service against its forecasts (rows-only): what the batch job hands to the alerts."""
    t = Tables(spark, sf_dir)
    scored = AN.isolation_forest(_cost_rows(t), "service", "cost", "row_id")
    starts = {s: 0.3 if i % 2 == 0 else -0.05 for i, s in enumerate(SERVICES)}
    return AL.overspend(forecasts(t), AN.calibrate_threshold(scored, "service", starts))


# Check queries whose output is the findings table; their union is the report input.
FINDING_QUERIES = [
    "cw1_excessive_metrics", "cw2_excessive_log_groups", "cw3_excessive_log_streams", "cw4_high_data_points",
    "ec2_1_low_cpu", "ec2_2_high_transfer", "ec2_3_old_instances", "ec2_4_unoptimized_volumes",
    "ec2_5_old_snapshots", "eks1_idle_cluster_instances", "eks2_cluster_transfer", "eks3_foreign_targets",
    "eks4_unhealthy_targets", "eks5_unmonitored", "eks6_overutilized", "eks7_hourly_transfer",
    "eks8_missing_cluster_logs", "eks9_cluster_counts", "eks11_idle_volumes", "s3_1_stale_objects",
    "s3_2_incomplete_uploads", "s3_4_replicated_keys", "s3_5_excessive_requests", "vpc1_idle_nat",
    "vpc2_unused_addresses", "vpc3_idle_vpn", "vpc4_vpn_packets", "vpc5_many_endpoints", "vpc6_unused_routes",
    "vpc7_blackhole_routes", "vpc8_open_acl_allow", "vpc9_open_acl_egress", "vpc10_many_rules",
    "vpc11_many_cidrs", "vpc12_flow_log_volume", "cfg1_many_resources", "cfg2_idle_custom_rules",
    "cfg3_stopped_recorders", "cfg4_stale_delivery", "kms1_many_keys", "kms2_busy_operations",
    "kms4_frequent_rotation", "adv1_advisor_flagged", "gce1_underutilized", "gce2_overutilized_preemptible",
    "gce3_egress_gb", "gce4_low_disk_io", "gce5_large_snapshots", "gke2_overprovisioned_nodes",
    "gke3_idle_large_nodes", "gke4_cluster_egress", "gke5_cluster_logging", "net1_egress_rate",
    "net2_ingress_rate", "net3_excessive_logging",
]


def fixture_setup() -> RP.Setup:
    """The limits, dates and metric names under which the fixture's checks are registered (q_checks)."""
    from costlens.plans.q_checks import AS_OF, CPU, IN, MEM, OTHER, OUT

    names = {
        "cpu": CPU, "mem": MEM, "nin": IN, "nout": OUT, "rdops": IN, "wrops": OUT, "idle": OTHER, "pod": CPU, "node": MEM,
        "req": OTHER, "nat_out": IN, "nat_in": OUT, "vpn_in": CPU, "vpn_out": MEM, "flow": IN, "pk_in": IN, "pk_out": OUT,
        "gcpu": CPU, "geg": OUT, "grd": IN, "gwr": OUT, "keg": OUT, "klog": OTHER, "kmon": MEM, "veg": OUT, "vin": IN,
    }
    limits = RP._limits() | {
        "CW-2": 2, "CW-3": 10, "CW-4": 50, "CW-4 minutes": 1440, "EC2-1": 100, "EC2-2": 200, "EC2-4b": 200, "EKS-1": 100,
        "EKS-1 memory": 100, "EKS-2": 200, "EKS-6": 150, "EKS-7": 200, "EKS-9": 300, "EKS-11": 100, "S3-5": 1, "VPC-1": 100,
        "VPC-3": 300, "VPC-4": 100, "VPC-10a": 5, "VPC-10b": 5, "VPC-11": 40, "VPC-12": 100, "GCE-1": 100, "GCE-2": 5,
        "GCE-2 low": 5, "GCE-3": 2e-7, "GCE-4": 1e-6, "GKE-3": 0.7, "GKE-3 memory": 3.0, "GKE-4": 200, "GKE-5": 180,
        "NET-1": 0.5, "NET-2": 0.3,
    }
    dates = {"EC2-3": "1995-12-01", "EC2-5": "2001-08-02", "S3-1": "2024-02-15", "CFG-4": "2024-03-05"}
    return RP.Setup(AS_OF, dates, names, limits, "red widget")


def all_findings(spark, sf_dir, services: list[str] | None = None):
    """Every check's findings in one table (or those of the checks of `services`), a branch per source."""
    from costlens.operators.metrics import metric_cube
    from costlens.plans.q_checks import AS_OF

    t = Tables(spark, sf_dir)
    names = sorted(set(AL.PREFIX_SERVICE.values())) if services is None else services
    cube = metric_cube(t.metric_points, AS_OF, "7 days", materialize=bool(names))
    return RP.findings(t, cube, fixture_setup(), names)


def union_of_checks(spark, sf_dir):
    """The same findings from the check functions, one branch each: what the compiled rules are tested against."""
    return union_findings([REGISTRY[n].fn(spark, sf_dir) for n in FINDING_QUERIES])


def hot_findings(spark, sf_dir):
    """The findings of the alerting services: only their checks are planned and run."""
    names = AL.alerting_services(alerts(Tables(spark, sf_dir)), service_map(spark))
    return all_findings(spark, sf_dir, services=names)


def _findings_sql() -> str:
    return " union all ".join(f"({REGISTRY[n].raw_sql})" for n in FINDING_QUERIES)


def _findings_fixtures() -> list[str]:
    names: list[str] = ["cost_aws_raw", "cost_gcp_raw"]
    for n in FINDING_QUERIES:
        for f in REGISTRY[n].fixtures:
            if f not in names:
                names.append(f)
    return names


def _prompts_sql() -> str:
    rows = ", ".join(
        "('{}', '{}')".format(k, AL.prompt_text(k, AL.CHECK_SERVICE[k]).replace("'", "''")) for k in AL.PROBLEMS
    )
    return f"(values {rows}) pr(prompt_id, prompt)"


def _hot_findings_sql() -> str:
    return (
        f"select * from ({_findings_sql()}) fd where fd.service in (select sm.check_service from ({ALERTS_SQL}) a "
        f"join {SERVICE_MAP_SQL} on sm.service = a.service where a.overspending)"
    )


def _late_registrations():
    """Registered after the check queries exist (their SQL is reused)."""

    @query("alr2_findings_for", "ALR-2", _findings_fixtures(), _hot_findings_sql())
    def alr2_findings_for(spark, sf_dir):
        """Findings of the services whose forecast breaches the threshold; only their checks are planned."""
        return hot_findings(spark, sf_dir)

    @query(
        "alr3_report",
        "ALR-3 ALR-5 ALR-6",
        _findings_fixtures(),
        f"select h.*, pr.prompt from ({_hot_findings_sql()}) h left join {_prompts_sql()} on pr.prompt_id = h.prompt_id",
    )
    def alr3_report(spark, sf_dir):
        """Flagship: clean cost -> AR(1) forecasts -> alerts -> every finding of the
        alerting services with its advice question."""
        return AL.report(hot_findings(spark, sf_dir), AL.prompts(spark))

    @query(
        "alr4_first_finding",
        "ALR-4",
        _findings_fixtures(),
        f"""select service, check_name, rule_rank, resource_id, problem, observed, threshold, prompt_id from (
  select *, row_number() over (partition by service, check_name
            order by rule_rank, resource_id, prompt_id, problem, observed nulls first) as rn
  from ({_findings_sql()}) fd) x where rn = 1""",
    )
    def alr4_first_finding(spark, sf_dir):
        """The first finding per (service, check), deterministic order."""
        return AL.first_finding(all_findings(spark, sf_dir))

    @query(
        "alr5_attach_prompt",
        "ALR-5",
        _findings_fixtures(),
        f"""select x.*, pr.prompt from (select service, check_name, rule_rank, resource_id, problem, observed,
  threshold, prompt_id from (select *, row_number() over (partition by service, check_name
  order by rule_rank, resource_id, prompt_id, problem, observed nulls first) as rn from ({_findings_sql()}) fd) y
  where rn = 1) x left join {_prompts_sql()} on pr.prompt_id = x.prompt_id""",
    )
    def alr5_attach_prompt(spark, sf_dir):
        """First finding per check with its advice question."""
        return AL.attach_prompt(AL.first_finding(all_findings(spark, sf_dir)), AL.prompts(spark))

    @query("alr3_report_nested", "ALR-3 ALR-4")
    def alr3_report_nested(spark, sf_dir):
        """Nested report: per service, the first finding of each check (rows-only)."""
        return AL.report_nested(all_findings(spark, sf_dir), AL.prompts(spark))


# ------------------------------------------------------------------ SRC-6/7
def threshold_history(t: Tables):
    return t.orders.select(
        F.col("o_orderpriority").alias("service"),
        F.col("o_totalprice").alias("threshold"),
        F.col("o_orderdate").alias("run_ts"),
        F.col("o_orderkey").alias("order_key"),
    )


LATEST_SQL = (
    "select o_orderpriority as service, first(o_totalprice order by o_orderdate desc, o_orderkey desc) as threshold "
    "from orders group by o_orderpriority"
)


@query("src6_latest_thresholds", "SRC-6", [], LATEST_SQL)
def src6_latest_thresholds(spark, sf_dir):
    """Last threshold per service from an append-only history (ties by order key)."""
    return B.latest_thresholds(threshold_history(Tables(spark, sf_dir)), ("run_ts", "order_key"))


@query(
    "src7_thresholds_wide",
    "SRC-7",
    [],
    "select " + ", ".join(f"max(case when service = '{s}' then threshold end) as \"{s}\"" for s in GCP_SERVICES)
    + f" from ({LATEST_SQL}) l",
)
def src7_thresholds_wide(spark, sf_dir):
    """The wide threshold row, one column per service."""
    latest = B.latest_thresholds(threshold_history(Tables(spark, sf_dir)), ("run_ts", "order_key"))
    return B.thresholds_wide(latest, GCP_SERVICES)


# ------------------------------------------------------------------ sinks and sources, round trips
def _scratch(spark, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint directory."""
    return scratch_folder(spark, f"roundtrip-{name}")


@query(
    "cln10_order_by_date",
    "CLN-10",
    ["cost_gcp_raw"],
    f"select provider, {d_('date')} as date, service, product_code, region, location, cost "
    f"from ({CLEAN_GCP_SQL}) c",
)
def cln10_order_by_date(spark, sf_dir):
    """Clean GCP table sorted by date for display (a range-partitioned sort)."""
    
    return C.order_by_date(C.clean_gcp(Tables(spark, sf_dir).cost_gcp_raw))


@query(
    "snk1_src4_clean_roundtrip",
    "SNK-1 SRC-4 CLN-10",
    ["cost_aws_raw", "cost_gcp_raw"],
    f"select provider, {d_('date')} as date, service, product_code, region, location, cost from ("
    f"{CLEAN_AWS_SQL} union all {CLEAN_GCP_SQL}) c",
)
def snk1_src4_clean_roundtrip(spark, sf_dir):
    """Both clean tables written partitioned by provider (sorted by date per
    file), then read back as one report."""
    
    t = Tables(spark, sf_dir)
    path = _scratch(spark, "clean")
    B.write_clean(aws_clean(t).unionByName(C.clean_gcp(t.cost_gcp_raw)), path)
    return B.read_report(spark, path, fmt="parquet").select(
        "provider", "date", "service", "product_code", "region", "location", "cost"
    )


@query(
    "snk3_src5_forecasts_roundtrip",
    "SNK-3 SRC-5",
    ["cost_aws_raw", "cost_gcp_raw"],
    f"select service, {d_('date')} as date, step, forecast from ({FORECASTS_SQL}) f",
)
def snk3_src5_forecasts_roundtrip(spark, sf_dir):
    """All services' forecasts written as one table partitioned by service, read back in one scan."""
    path = _scratch(spark, "forecasts")
    B.write_forecasts(forecasts(Tables(spark, sf_dir)), path)
    return B.read_forecasts(spark, path).select("service", "date", "step", "forecast")


@query(
    "snk2_append_thresholds",
    "SNK-2 SRC-6",
    ["metric_points"],
    "select metric as service, threshold * 2 as threshold from ("
    + REGISTRY["ano3_6_thresholds"].raw_sql
    + ") t",
)
def snk2_append_thresholds(spark, sf_dir):
    """Two runs appended to the threshold history; the latest run wins per service."""
    th = ano3_6_thresholds(spark, sf_dir).select(F.col("metric").alias("service"), "threshold", "accuracy")
    path = _scratch(spark, "thresholds")
    B.append_thresholds(th, path, "2024-01-01 00:00:00")
    B.append_thresholds(th.withColumn("threshold", F.col("threshold") * 2), path, "2024-02-01 00:00:00")
    return B.latest_thresholds(spark.read.parquet(path))


# An export run folder name (timestamp + UUID), and one that is not a run.
_RUN = "2024-02-01T10_00_00.000Z-0123abcd-0123-4567-89ab-0123456789ab"


@query(
    "src1_aws_export_layout",
    "SRC-1",
    ["cost_aws_raw"],
    "select '2024-01' as billing_period, count(*) as n, "
    f"{dsum_('line_item_blended_cost')} as total, count(discount_bundled_discount) as n_bundled from cost_aws_raw",
)
def src1_aws_export_layout(spark, sf_dir):
    """The whole AWS report written as gzip CSV in the export layout
    (`BILLING_PERIOD=…/<run>/files`) next to a copy in a folder that is not a
    run; the reader keeps the run folder only and adds the period column."""
    raw = Tables(spark, sf_dir).cost_aws_raw
    base = _scratch(spark, "aws-export")
    for run in (_RUN, "manual-copy"):
        raw.write.option("header", True).option("compression", "gzip").csv(f"{base}/BILLING_PERIOD=2024-01/{run}")
    df = B.read_aws_billing(spark, base, raw.schema, file_prefix="part-")
    return df.groupBy(F.col("BILLING_PERIOD").cast("string").alias("billing_period")).agg(
        F.count(F.lit(1)).alias("n"),
        dsum("line_item_blended_cost").alias("total"),
        F.count("discount_bundled_discount").alias("n_bundled"),
    )


@query(
    "src2_3_gcp_files_union",
    "SRC-2 SRC-3",
    ["cost_gcp_raw"],
    'select "Service description" as service, 2 * count(*) as n, count("Cost (€)") as n_cost, '
    'count("Discounts (€)") as n_disc from cost_gcp_raw group by 1',
)
def src2_3_gcp_files_union(spark, sf_dir):
    """The whole GCP report written as CSV, read back by file-name prefix
    (SRC-2), and two differently projected copies concatenated by column name
    with missing columns as null (SRC-3)."""
    raw = Tables(spark, sf_dir).cost_gcp_raw
    folder = _scratch(spark, "gcp-export")
    raw.write.option("header", True).csv(folder)
    g = B.read_gcp_billing(spark, folder, "part-", raw.schema)
    u = B.union_reports(
        [g.select("Date", "Service description", "Cost (€)"), g.select("Date", "Service description", "Discounts (€)")]
    )
    return u.groupBy(F.col("Service description").alias("service")).agg(
        F.count(F.lit(1)).alias("n"), F.count("Cost (€)").alias("n_cost"), F.count("Discounts (€)").alias("n_disc")
    )


@query(
    "src1_columns_by_name",
    "SRC-1 SRC-3",
    ["cost_aws_raw"],
    f"""select m as billing_period, line_item_product_code as code, product_region_code as region, count(*) as n,
        {dsum_('line_item_blended_cost')} as blended,
        {dsum_("case when m = '2024-01' then discount_total_discount end")} as discounts
        from cost_aws_raw, (values ('2024-01'), ('2024-02')) months(m) group by all""",
)
def src1_columns_by_name(spark, sf_dir):
    """Two months of the AWS export, the second with its columns in reverse order and one missing."""
    raw = Tables(spark, sf_dir).cost_aws_raw
    base = _scratch(spark, "aws-columns")
    later = raw.select(*[c for c in reversed(raw.columns) if c != "discount_total_discount"])
    for month, df in (("2024-01", raw), ("2024-02", later)):
        df.write.option("header", True).option("compression", "gzip").csv(f"{base}/BILLING_PERIOD={month}/{_RUN}")
    got = B.read_aws_billing(spark, base, file_prefix="part-")
    return got.groupBy(
        F.col("BILLING_PERIOD").cast("string").alias("billing_period"),
        F.col("line_item_product_code").alias("code"),
        F.col("product_region_code").alias("region"),
    ).agg(
        F.count(F.lit(1)).alias("n"), dsum("line_item_blended_cost").alias("blended"), dsum("discount_total_discount").alias("discounts")
    )


@query(
    "src2_columns_by_name",
    "SRC-2 SRC-3",
    ["cost_gcp_raw"],
    """select "Service description" as service, 2 * count(*) as n, 2 * count("Cost (€)") as n_cost,
              count("Discounts (€)") as n_disc from cost_gcp_raw group by 1""",
)
def src2_columns_by_name(spark, sf_dir):
    """Two GCP exports, the second with its columns in reverse order and one missing."""
    raw = Tables(spark, sf_dir).cost_gcp_raw
    folder = _scratch(spark, "gcp-columns")
    raw.write.option("header", True).csv(folder)
    later = raw.select(*[f"`{c}`" for c in reversed(raw.columns) if c != "Discounts (€)"])
    later.write.mode("append").option("header", True).csv(folder)
    return B.read_gcp_billing(spark, folder, "part-").groupBy(F.col("Service description").alias("service")).agg(
        F.count(F.lit(1)).alias("n"), F.count("Cost (€)").alias("n_cost"), F.count("Discounts (€)").alias("n_disc")
    )


@query(
    "snk1_incremental_clean",
    "SRC-1 SNK-1 CLN-12",
    ["cost_aws_raw"],
    f"select provider, {d_('date')} as date, service, product_code, region, location, cost, "
    f"strftime(date, '%Y') as billing_period from ({CLEAN_AWS_SQL}) c",
)
def snk1_incremental_clean(spark, sf_dir):
    """The AWS export in yearly periods, cleaned in two runs: the second one finds
    a new run folder in one period (with a half of its lines before, all after)
    and reads and replaces that period alone.  Equal to one cleaning of it all."""
    raw = Tables(spark, sf_dir).cost_aws_raw
    raw = raw.withColumn("BILLING_PERIOD", F.substring("identity_time_interval", 1, 4))
    base, table, manifest = (_scratch(spark, n) for n in ("aws-runs", "aws-clean", "aws-manifest"))
    write = lambda df, run, mode: (
        df.withColumn("run", F.lit(run)).write.mode(mode).option("header", True).option("compression", "gzip")
        .partitionBy("BILLING_PERIOD", "run").csv(f"{base}-staged")
    )
    write(raw.where("BILLING_PERIOD <> '1995' or l_orderkey % 2 = 0"), _RUN, "overwrite")
    _as_run_folders(spark, f"{base}-staged", base)
    columns = [c for c in raw.columns if c != "BILLING_PERIOD"]
    schema = raw.select(*columns).schema
    clean = lambda df: C.clean_aws(df, order=AWS_ORDER, period="BILLING_PERIOD")
    B.update_clean_aws(spark, base, table, manifest, clean, schema, file_prefix="part-")
    write(raw.where("BILLING_PERIOD = '1995' and l_orderkey % 2 <> 0"), _LATER_RUN, "append")
    _as_run_folders(spark, f"{base}-staged", base)
    B.update_clean_aws(spark, base, table, manifest, clean, schema, file_prefix="part-")
    got = spark.read.parquet(table).withColumn("billing_period", F.col("BILLING_PERIOD").cast("string"))
    return got.select("provider", "date", "service", "product_code", "region", "location", "cost", "billing_period")


_LATER_RUN = "2024-03-01T10_00_00.000Z-0123abcd-0123-4567-89ab-0123456789ab"


def _as_run_folders(spark, staged: str, base: str) -> None:
    """Gives the export its layout: `run=<folder>` becomes `<folder>`."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(staged).getFileSystem(spark._jsc.hadoopConfiguration())
    for period in files.listStatus(path(staged)):
        if period.isDirectory():
            to = path(base, period.getPath().getName())
            files.mkdirs(to)
            for run in files.listStatus(period.getPath()):
                files.rename(run.getPath(), path(to, run.getPath().getName().removeprefix("run=")))


@query(
    "snk2_repeated_run",
    "SNK-2 SRC-6",
    ["metric_points"],
    "select metric as service, threshold, 1 as rows from (" + REGISTRY["ano3_6_thresholds"].raw_sql + ") t",
)
def snk2_repeated_run(spark, sf_dir):
    """A run written twice (the first time with other values) leaves its rows once."""
    th = ano3_6_thresholds(spark, sf_dir).select(F.col("metric").alias("service"), "threshold", "accuracy")
    path = _scratch(spark, "thresholds-again")
    for factor in (3, 1):
        B.append_thresholds(th.withColumn("threshold", F.col("threshold") * factor), path, "2024-01-01 00:00:00", "run-1")
    return spark.read.parquet(path).groupBy("service").agg(F.max("threshold").alias("threshold"), F.count(F.lit(1)).cast("int").alias("rows"))
