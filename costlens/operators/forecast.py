"""Time series and forecasts per service.

Work is done after the daily aggregate (TS-1), so a series has one row per
day whatever the size of the billing data; per-service windows therefore
hold days, not rows.  Native operators: TS-1, 2, 3, 4, 6, 7, 8, 9, 10, 14 and 15.
ARIMA runs per service in `groupBy(service).applyInPandas` with numpy.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costlens.functions import dsum, finite
from costlens.session import materialize

HORIZON = 7
Z95 = 1.96


# ------------------------------------------------------------------ native
def daily_series(clean: DataFrame, group: str = "service", value: str = "cost") -> DataFrame:
    """TS-1 (with D6, D16): one value per service and date; null costs dropped."""
    return (
        clean.filter(F.col(value).isNotNull() & F.col(group).isNotNull() & F.col("date").isNotNull())
        .groupBy(group, "date")
        .agg(dsum(value).alias("y"))
    )


def sqrt_transform(c) -> Column:
    """TS-3: square root, null for negative input."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c >= 0, F.sqrt(c))


def _w(group: str) -> Window:
    return Window.partitionBy(group).orderBy("date")


def difference(series: DataFrame, d: int = 1, col: str = "y", group: str = "service", out: str = "dy") -> DataFrame:
    """TS-4: difference `d` times along date; the first `d` rows are dropped."""
    cur = series.withColumn(out, F.col(col))
    for _ in range(d):
        cur = cur.withColumn(out, F.col(out) - F.lag(out).over(_w(group))).filter(F.col(out).isNotNull())
    return cur


def indexed(series: DataFrame, group: str = "service", col: str = "y") -> DataFrame:
    """Series with a 0-based time index `i`, the length `n` and the mean."""
    w = _w(group)
    wg = Window.partitionBy(group)
    return (
        series.withColumn("i", F.row_number().over(w) - 1)
        .withColumn("n", F.count(F.lit(1)).over(wg))
        .withColumn("mu", F.avg(col).over(wg))
    )


def acf(series: DataFrame, group: str = "service", col: str = "y", max_lag: int | None = None) -> DataFrame:
    """TS-9: autocorrelation for lags 0..K, K = int(n/2 − 1) (or `max_lag`).

    acf(k) = Σ_t (y_t − ȳ)(y_{t−k} − ȳ) / Σ_t (y_t − ȳ)²  (denominator n, as
    statsmodels).  A service's days are one sorted array (one number per day of
    its history), so no day is sent on once per lag."""
    r = _correlations(series, group, col, max_lag)
    # outer: the optimizer would evaluate the array once more for a filter on its size
    return r.select(group, F.posexplode_outer("r").alias("lag", "acf"), "n")


def _correlations(series: DataFrame, group: str, col: str, max_lag: int | None) -> DataFrame:
    """(group, n, r): the autocorrelations of lags 0..K as one array."""
    days = series.groupBy(group).agg(
        F.sort_array(F.collect_list(F.struct("date", F.col(col).alias("y")))).alias("days"), F.avg(col).alias("mu")
    )
    z = days.select(group, F.size("days").alias("n"), F.transform("days", lambda d: d["y"] - F.col("mu")).alias("z"))
    kmax = F.lit(int(max_lag)) if max_lag is not None else (F.col("n") / 2 - 1).cast("int")
    kmax = F.least(F.greatest(kmax, F.lit(0)), F.col("n") - 1)

    def product(k: Column) -> Column:
        pairs = F.zip_with(F.slice("z", k + 1, F.col("n") - k), F.slice("z", F.lit(1), F.col("n") - k), lambda a, b: a * b)
        return F.aggregate(pairs, F.lit(0.0), lambda a, v: a + v)

    sums = z.select(group, F.col("n").cast("long").alias("n"), F.transform(F.sequence(F.lit(0), kmax), product).alias("s"))
    # lag 0 is the sum of squares
    return sums.select(group, "n", F.transform("s", lambda v: F.try_divide(v, F.element_at("s", 1))).alias("r"))


def pacf(series: DataFrame, group: str = "service", col: str = "y", max_lag: int | None = None) -> DataFrame:
    """TS-7: partial autocorrelation for lags 0..K by the Durbin-Levinson recursion on the autocorrelations.

    Lag 0 is 1.  From the coefficients f of order k − 1,
    pacf(k) = (r_k − Σ f_j r_{k−j}) / (1 − Σ f_j r_j); order k then has
    f_j − pacf(k) f_{k−j}, and pacf(k) itself.  A constant series has nulls."""
    r = _correlations(series, group, col, max_lag)
    add = lambda a, v: a + v

    def dot(f: Column, x: Column) -> Column:
        return F.aggregate(F.zip_with(f, x, lambda a, b: a * b), F.lit(0.0), add)

    def step(s: Column, k: Column) -> Column:
        back = F.reverse(F.slice("r", F.lit(2), k - 1))  # r_{k-1} .. r_1
        ahead = F.slice("r", F.lit(2), k - 1)
        new = F.try_divide(F.element_at("r", k + 1) - dot(s["f"], back), F.lit(1.0) - dot(s["f"], ahead))
        nxt = F.transform(
            F.array(new),
            lambda p: F.struct(
                F.concat(F.zip_with(s["f"], F.reverse(s["f"]), lambda a, b: a - p * b), F.array(p)).alias("f"),
                F.concat(s["out"], F.array(p)).alias("out"),
            ),
        )
        return nxt[0]

    zero = F.struct(F.array().cast("array<double>").alias("f"), F.array(F.lit(1.0)).alias("out"))
    lags = F.when(F.size("r") > 1, F.sequence(F.lit(1), F.size("r") - 1)).otherwise(F.array().cast("array<int>"))
    out = F.aggregate(lags, zero, step, lambda s: s["out"])
    return r.select(group, "n", out.alias("out")).select(group, F.posexplode_outer("out").alias("lag", "pacf"), "n")


def choose_order(corr: DataFrame, group: str = "service", value: str = "acf") -> DataFrame:
    """TS-8 / TS-10: order = (first lag whose value is below 1.96/√n) − 1,
    floored at 0; 0 when no lag is below the bound (the reference's argmax quirk)."""
    bound = F.lit(Z95) / F.sqrt(F.col("n").cast("double"))
    first = F.min(F.when(F.col(value) < bound, F.col("lag")))
    return corr.groupBy(group).agg(
        F.greatest(F.coalesce(first - 1, F.lit(0)), F.lit(0)).alias("order"), F.first("n").alias("n")
    )


def ar1_fit(series: DataFrame, group: str = "service", col: str = "y") -> DataFrame:
    """TS-15 (fit): AR(1) with constant by conditional least squares:
    y_t = c + φ y_{t−1}.  Returns (service, c, phi, last_date, last_y, n)."""
    w = _w(group)
    x = series.withColumn("ylag", F.lag(col).over(w))
    return x.groupBy(group).agg(
        F.regr_intercept(col, "ylag").alias("c"),
        F.regr_slope(col, "ylag").alias("phi"),
        F.max_by(col, "date").alias("last_y"),
        F.max("date").alias("last_date"),
        F.count(F.lit(1)).alias("n"),
    )


def forecast_frame(last: DataFrame, group: str = "service", horizon: int = HORIZON) -> DataFrame:
    """TS-14: one row per step, dates from the day after the last date."""
    return last.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step")).withColumn(
        "date", F.date_add("last_date", F.col("step"))
    )


def ar1_forecast(series: DataFrame, group: str = "service", col: str = "y", horizon: int = HORIZON) -> DataFrame:
    """TS-15: μ + φ^h (y_n − μ) with μ = c / (1 − φ)  ->  forecasts(service, date, step, forecast)."""
    f = forecast_frame(ar1_fit(series, group, col), group, horizon)
    mu = F.try_divide(F.col("c"), F.lit(1.0) - F.col("phi"))
    fc = mu + F.pow(F.col("phi"), F.col("step").cast("double")) * (F.col("last_y") - mu)
    return f.select(group, "date", F.col("step").cast("int").alias("step"), fc.alias("forecast"))


def adf_lag0(series: DataFrame, group: str = "service", col: str = "y") -> DataFrame:
    """TS-2 (lag 0): Dickey-Fuller τ of Δy_t = α + β y_{t−1}; τ = β / se(β)."""
    w = _w(group)
    x = series.withColumn("ylag", F.lag(col).over(w)).withColumn("dy", F.col(col) - F.col("ylag"))
    g = x.groupBy(group).agg(
        F.regr_count("dy", "ylag").alias("nobs"),
        F.regr_slope("dy", "ylag").alias("beta"),
        F.regr_sxx("dy", "ylag").alias("sxx"),
        F.regr_syy("dy", "ylag").alias("syy"),
        F.regr_sxy("dy", "ylag").alias("sxy"),
    )
    ssr = F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")
    se = F.sqrt(F.try_divide(ssr, (F.col("nobs") - 2).cast("double")) / F.col("sxx"))
    return g.select(group, "nobs", "beta", F.try_divide(F.col("beta"), se).alias("tau"))


# The MacKinnon p-value is at most 0.05 up to this τ, the root of 2.1659 + 1.4412 τ + 0.038269 τ² = Φ⁻¹(0.05).
TAU_5 = (-1.4412 + math.sqrt(1.4412**2 - 4 * 0.038269 * (2.1659 + 1.6448536269514722))) / (2 * 0.038269)
# A column whose remainder beside the others is less than this share of it adds nothing to them.
SINGULAR = 1e-12


def _let(value: Column, body) -> Column:
    """`body(value)` with the value computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def _centred(a: Column) -> Column:
    mean = F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, v: s + v), F.size(a).cast("double"))
    return _let(mean, lambda m: F.transform(a, lambda v: v - m))


def _unit(a: Column) -> Column:
    """The centred column at length 1; null if it is constant to 10 digits (the constant regressor holds it already)."""

    def scaled(c: Column) -> Column:
        return _let(_dot(c, c), lambda q: F.when(q > _dot(a, a) * 1e-20, F.transform(c, lambda v: v / F.sqrt(q))))

    return _let(_centred(a), scaled)


def _substituted(factor: Column, cols: Column, x: Column) -> Column:
    """The row that column `x` has in the Cholesky factor of the cross-moments of `cols`: L⁻¹ (cols · x)."""

    def entry(row: Column, lj: Column) -> Column:
        moment = _dot(x, F.element_at(cols, F.size(row) + 1))
        rest = moment - _dot(row, F.slice(lj, F.lit(1), F.size(row)))
        return F.concat(row, F.array(F.try_divide(rest, F.element_at(lj, -1))))

    return F.aggregate(factor, F.array().cast("array<double>"), entry)


def _cholesky(cols: Column) -> Column:
    """The Cholesky factor of the cross-moments of columns of length 1, by rows.

    Null from the first column on that the ones before it (nearly) span."""

    def add(factor: Column, x: Column) -> Column:
        def finished(row: Column) -> Column:
            rest = F.lit(1.0) - _dot(row, row)
            return F.concat(row, F.array(F.when(rest > SINGULAR, F.sqrt(rest))))

        return F.concat(factor, F.array(_let(_substituted(factor, cols, x), finished)))

    return F.aggregate(cols, F.array().cast("array<array<double>>"), add)


def _lagged(dy: Column, lags: Column, start: Column, rows: Column) -> Column:
    """Columns Δy_{t−1} .. Δy_{t−lags} over the rows from `start` on."""
    some = F.transform(F.sequence(F.lit(1), lags), lambda j: _unit(F.slice(dy, start - j + 1, rows)))
    return F.when(lags > 0, some).otherwise(F.array().cast("array<array<double>>"))


def _diff(y: Column) -> Column:
    n = F.greatest(F.size(y) - 1, F.lit(0))
    return F.zip_with(F.slice(y, F.lit(2), n), F.slice(y, F.lit(1), n), lambda a, b: a - b)


def _adf(y: Column) -> Column:
    """(tau, lag, nobs) of an array of daily values in order, by cross-moments of the lagged columns.

    Every lag 0..L is tried on the same rows, L = min(⌈12 (n/100)^¼⌉, ⌊n/2⌋ − 2).
    With the level first and the lags after it, one factor has them all: the
    squared residual of the first columns is what their entries in the target's
    row leave of it.  The lag of the least AIC is fitted again on all its rows,
    the level last; its t-value is then the last entry over the residual's
    standard error.  Null for fewer than 6 values, and if the level or the
    chosen lags are spanned by the other columns.
    """
    n = F.size(y)
    top = F.ceil(F.lit(12.0) * F.pow(n / F.lit(100.0), F.lit(0.25))).cast("int")
    longest = F.greatest(F.least(top, F.floor(n / F.lit(2)).cast("int") - 2), F.lit(0))

    def least_aic(dy: Column, most: Column) -> Column:
        rows = n - 1 - most
        cols = F.concat(F.array(_unit(F.slice(y, most + 1, rows))), _lagged(dy, most, most, rows))

        def scores(x: Column, target: Column) -> Column:
            z = _substituted(_cholesky(x), x, target)

            def score(zs: Column, k: Column) -> Column:
                part = F.slice(zs, F.lit(1), k + 1)
                left = _dot(target, target) - _dot(part, part)
                aic = F.when(left > 0, rows * F.ln(F.when(left > 0, left) / rows) + 2 * (k + 2))
                return F.struct(F.when(rows > k + 2, aic).alias("aic"), k.alias("lag"))

            return _let(z, lambda zs: F.transform(F.sequence(F.lit(0), most), lambda k: score(zs, k)))

        found = _let(cols, lambda x: _let(_centred(F.slice(dy, most + 1, rows)), lambda target: scores(x, target)))
        best = F.array_min(F.filter(found, lambda s: s["aic"].isNotNull()))
        return F.coalesce(best["lag"], F.lit(0))

    def fitted(dy: Column, lag: Column) -> Column:
        rows = n - 1 - lag
        cols = F.concat(_lagged(dy, lag, lag, rows), F.array(_unit(F.slice(y, lag + 1, rows))))

        def statistic(x: Column, target: Column) -> Column:
            def tau(z: Column) -> Column:
                left = _dot(target, target) - _dot(z, z)
                error = F.sqrt(F.when((left > 0) & (rows > lag + 2), left) / F.greatest(rows - lag - 2, F.lit(1)))
                return F.struct((F.element_at(z, -1) / error).alias("tau"), lag.alias("lag"), rows.alias("nobs"))

            return _let(_substituted(_cholesky(x), x, target), tau)

        return _let(cols, lambda x: _let(_centred(F.slice(dy, lag + 1, rows)), lambda target: statistic(x, target)))

    tested = _let(_diff(y), lambda dy: _let(_let(longest, lambda m: least_aic(dy, m)), lambda lag: fitted(dy, lag)))
    none = F.struct(F.lit(None).cast("double").alias("tau"), F.lit(0).alias("lag"), n.alias("nobs"))
    return F.when(n >= 6, tested).otherwise(none)


def _days(series: DataFrame, group: str, col: str) -> DataFrame:
    """(group, y): a service's values by date as one array, one number per day of its history.

    Less the first value: neither the test nor a correlation depends on the level, and a high one costs digits."""
    known = series.where(F.col(group).isNotNull() & finite(col).isNotNull())
    days = F.sort_array(F.collect_list(F.struct("date", F.col(col).cast("double").alias("y"))))
    return known.groupBy(group).agg(days.alias("days")).select(
        group, F.transform("days", lambda d: d["y"] - F.get("days", F.lit(0))["y"]).alias("y")
    )


def normal_cdf(x: Column) -> Column:
    """Φ(x) by its series around 0, 1/2 + φ(x) Σ x^(2k+1) / (2k+1)!!; 0 or 1 beyond 8."""
    first = F.struct(x.alias("term"), x.alias("sum"))

    def step(s: Column, k: Column) -> Column:
        return _let(
            s["term"] * x * x / (2 * k + 1), lambda t: F.struct(t.alias("term"), (s["sum"] + t).alias("sum"))
        )

    total = F.aggregate(F.sequence(F.lit(1), F.lit(150)), first, step, lambda s: s["sum"])
    near = F.greatest(F.lit(0.5) + F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * total, F.lit(0.0))
    return F.when(x < -8, F.lit(0.0)).when(x > 8, F.lit(1.0)).otherwise(near)


def mackinnon(tau: Column) -> Column:
    """The p-value of τ (constant only): `mackinnon_p` as a column; null for null."""
    low = normal_cdf(F.lit(2.1659) + 1.4412 * tau + 0.038269 * tau * tau)
    high = normal_cdf(F.lit(1.7339) + 0.93202 * tau - 0.12745 * tau * tau - 0.010368 * tau * tau * tau)
    return (
        F.when(tau < -18.83, F.lit(0.0)).when(tau > 2.74, F.lit(1.0)).when(tau <= -1.61, low).when(tau > -1.61, high)
    )


def adf(series: DataFrame, group: str = "service", col: str = "y") -> DataFrame:
    """TS-2: augmented Dickey-Fuller test with a constant, lag by AIC (`_adf`) -> (group, tau, lag, nobs, p, stationary).

    Days without a finite value are left out.  `stationary`: p is at most 0.05;
    false where there is no τ.  One shuffle, no Python."""
    a = _days(series, group, col).select(group, _adf(F.col("y")).alias("a")).select(group, "a.*")
    stationary = F.coalesce(F.col("tau") <= TAU_5, F.lit(False))
    return a.select(group, "tau", "lag", "nobs", mackinnon(F.col("tau")).alias("p"), stationary.alias("stationary"))


def choose_d(series: DataFrame, group: str = "service", col: str = "y") -> DataFrame:
    """TS-6: differences until the test calls the series stationary, at most two -> (group, n, d, tau, lag).

    `tau` and `lag` are of the last test.  A series without τ is differenced
    as one that isn't stationary, while it has more than one value."""

    return _differenced(series, group, col).select(group, "n", "d", "a.tau", "a.lag")


def _differenced(series: DataFrame, group: str, col: str) -> DataFrame:
    """(group, n, y, d, a): the values differenced `d` times as the test `a` asks for, and how many there were."""
    cur = _days(series, group, col).select(group, F.size("y").cast("long").alias("n"), "y")
    cur = cur.select("*", F.lit(0).alias("d"), _adf(F.col("y")).alias("a"))
    more = ~F.coalesce(F.col("a.tau") <= TAU_5, F.lit(False)) & (F.size("y") > 1)
    for d in (1, 2):
        # a series that was decided at d - 1 keeps its test
        cur = cur.select("*", (more & (F.col("d") == d - 1)).alias("go"))
        cur = cur.withColumn("y", F.when(F.col("go"), _diff(F.col("y"))).otherwise(F.col("y")))
        cur = cur.withColumn("a", F.when(F.col("go"), _adf(F.col("y"))).otherwise(F.col("a")))
        cur = cur.withColumn("d", F.when(F.col("go"), F.lit(d)).otherwise(F.col("d"))).drop("go")
    return cur


def model_orders(series: DataFrame, group: str = "service", col: str = "y") -> DataFrame:
    """TS-6..10: the orders (group, p, d, q): d by `choose_d`, then p from the partial autocorrelation and q from the
    autocorrelation of the differenced series (lags 0..n/2 − 1 of what is left of it).

    The differenced series are written once, one row per service."""
    found = materialize(_differenced(series, group, col))
    w = found.select(group, F.posexplode("y").alias("date", "y"))
    p = choose_order(pacf(w, group), group, "pacf").select(group, F.col("order").alias("p"))
    q = choose_order(acf(w, group), group).select(group, F.col("order").alias("q"))
    orders = found.select(group, "d").join(p, group, "left").join(q, group, "left")
    order = [F.coalesce(F.col(c), F.lit(0)).cast("int").alias(c) for c in ("p", "d", "q")]
    return orders.select(group, *order)


# ------------------------------------------------------------------ numpy, per service
def _norm_cdf(x: float) -> float:
    return 0.5 * (1.0 + math.erf(x / math.sqrt(2.0)))


def mackinnon_p(tau: float) -> float:
    """Approximate p-value of the ADF τ (constant only), MacKinnon (1994) surface."""
    if not np.isfinite(tau):
        return float("nan")
    if tau < -18.83:
        return 0.0
    if tau > 2.74:
        return 1.0
    if tau <= -1.61:
        return _norm_cdf(2.1659 + 1.4412 * tau + 0.038269 * tau * tau)
    return _norm_cdf(1.7339 + 0.93202 * tau - 0.12745 * tau**2 - 0.010368 * tau**3)


def _ols(X: np.ndarray, y: np.ndarray):
    beta, *_ = np.linalg.lstsq(X, y, rcond=None)
    resid = y - X @ beta
    return beta, resid


def adf_test(y: np.ndarray):
    """TS-2: ADF with constant, lag chosen by AIC on a common sample, refit on
    the full sample.  Returns (tau, pvalue, usedlag, nobs)."""
    y = np.asarray(y, dtype=float)
    n = len(y)
    if n < 6:
        return float("nan"), float("nan"), 0, n
    maxlag = int(math.ceil(12.0 * (n / 100.0) ** 0.25))
    maxlag = max(0, min(n // 2 - 2, maxlag))
    dy = np.diff(y)

    def design(lag: int, start: int):
        rows = np.arange(start, n - 1)  # index into dy: dy[t] = y[t+1]-y[t]
        cols = [np.ones(len(rows)), y[rows]]
        for j in range(1, lag + 1):
            cols.append(dy[rows - j])
        return np.column_stack(cols), dy[rows]

    best, best_aic = 0, np.inf
    for lag in range(0, maxlag + 1):
        X, t = design(lag, maxlag)
        if len(t) <= X.shape[1]:
            continue
        _, r = _ols(X, t)
        m = len(t)
        ssr = float(r @ r)
        if ssr <= 0:
            continue
        aic = m * math.log(ssr / m) + 2 * X.shape[1]
        if aic < best_aic:
            best, best_aic = lag, aic
    X, t = design(best, best)
    if len(t) <= X.shape[1]:
        return float("nan"), float("nan"), best, len(t)
    b, r = _ols(X, t)
    s2 = float(r @ r) / (len(t) - X.shape[1])
    try:
        cov = s2 * np.linalg.inv(X.T @ X)
        tau = float(b[1] / math.sqrt(cov[1, 1])) if cov[1, 1] > 0 else float("nan")
    except np.linalg.LinAlgError:
        tau = float("nan")
    return tau, mackinnon_p(tau), best, len(t)


def pacf_first_below(w: np.ndarray, nlags: int, bound: float):
    """TS-7/8: PACF by OLS (regress w_t on constant and lags 1..k, last
    coefficient), stopping at the first lag below `bound`; returns that lag or 0."""
    n = len(w)
    for k in range(1, nlags + 1):
        if n - k <= k + 1:
            break
        X = np.column_stack([np.ones(n - k)] + [w[k - j : n - j] for j in range(1, k + 1)])
        b, _ = _ols(X, w[k:])
        if b[-1] < bound:
            return k
    return 0


def acf_first_below(w: np.ndarray, nlags: int, bound: float):
    z = w - w.mean()
    den = float(z @ z)
    if den == 0:
        return 0
    for k in range(1, nlags + 1):
        if k >= len(z):
            break
        if float(z[k:] @ z[:-k]) / den < bound:
            return k
    return 0


def choose_pdq(y: np.ndarray):
    """TS-6..10: d by repeated ADF (p > 0.05, at most 2), then p from PACF and
    q from ACF of the differenced series (D8: on cost, not on dates)."""
    n = len(y)
    w = np.asarray(y, dtype=float)
    d = 0
    p_val = adf_test(w)[1]
    while (not np.isfinite(p_val) or p_val > 0.05) and d < 2 and len(w) > 1:
        d += 1
        w = np.diff(w)
        p_val = adf_test(w)[1]
    nlags = max(int(n / 2 - 1), 0)
    bound = Z95 / math.sqrt(len(w)) if len(w) else 1.0
    p = max(0, pacf_first_below(w, nlags, bound) - 1)
    q = max(0, acf_first_below(w, nlags, bound) - 1)
    return p, d, q, w


def stationary_form(y: np.ndarray):
    """TS-5: none / sqrt+diff / sqrt+diff+diff by the ADF p-value (D7: reported only)."""
    y = np.asarray(y, dtype=float)
    if not (adf_test(y)[1] > 0.05):
        return "none"
    z = np.diff(np.sqrt(np.where(y >= 0, y, np.nan)))
    z = z[np.isfinite(z)]
    if adf_test(z)[1] > 0.05:
        return "sqrt_diff2"
    return "sqrt_diff"


def _css_resid(params, w, p, q, const):
    n = len(w)
    c = params[0] if const else 0.0
    phi = params[const : const + p]
    theta = params[const + p : const + p + q]
    e = np.zeros(n)
    m = max(p, q)
    for t in range(m, n):
        ar = sum(phi[i] * w[t - 1 - i] for i in range(p))
        ma = sum(theta[j] * e[t - 1 - j] for j in range(q))
        e[t] = w[t] - c - ar - ma
    return e[m:], e


def arima_fit(w: np.ndarray, p: int, q: int, const: bool, iters: int = 25):
    """TS-11: ARMA(p, q) on the differenced series by conditional least squares:
    Hannan-Rissanen start, then Gauss-Newton with a numeric Jacobian."""
    n = len(w)
    k = int(const) + p + q
    if k == 0:
        return np.zeros(0), float(np.var(w)) if n else float("nan"), True
    # Hannan-Rissanen: long AR for innovations, then OLS on lags of w and e.
    m = min(max(p + q + 1, int(round(math.log(max(n, 2)) ** 2))), max(n // 3, 1))
    e_hat = np.zeros(n)
    if q > 0 and n > m + 2:
        X = np.column_stack([np.ones(n - m)] + [w[m - j : n - j] for j in range(1, m + 1)])
        b, r = _ols(X, w[m:])
        e_hat[m:] = r
    start = max(p, q) + (m if q > 0 else 0)
    cols = [np.ones(n - start)] if const else []
    cols += [w[start - i : n - i] for i in range(1, p + 1)]
    cols += [e_hat[start - j : n - j] for j in range(1, q + 1)]
    if n - start > k and cols:
        params, _ = _ols(np.column_stack(cols), w[start:])
    else:
        params = np.zeros(k)
        if const and n:
            params[0] = float(np.mean(w))
    converged = False
    for _ in range(iters):
        r, _ = _css_resid(params, w, p, q, const)
        J = np.empty((len(r), k))
        for i in range(k):
            h = 1e-6 * max(1.0, abs(params[i]))
            pp = params.copy()
            pp[i] += h
            J[:, i] = (_css_resid(pp, w, p, q, const)[0] - r) / h
        step, *_ = np.linalg.lstsq(J, -r, rcond=None)
        if not np.all(np.isfinite(step)):
            break
        params = params + step
        if np.max(np.abs(step)) < 1e-8 * (1 + np.max(np.abs(params))):
            converged = True
            break
    r, _ = _css_resid(params, w, p, q, const)
    sigma2 = float(r @ r) / max(len(r), 1)
    return params, sigma2, converged


def arima_forecast(y: np.ndarray, p: int, d: int, q: int, steps: int = HORIZON):
    """TS-11..13: fit ARIMA(p, d, q) (constant only when d = 0), one-step
    predictions of every level, and a `steps`-ahead forecast.

    The first max(p, q) values are predicted by the mean of the differenced
    series; a level that has nothing before it by 0."""
    y = np.asarray(y, dtype=float)
    pu, qu = p, q
    w = np.diff(y, n=d) if d else y.copy()
    const = d == 0
    if not len(w):  # as many differences as values: the last level goes on
        return np.full(steps, y[-1]), np.r_[0.0, y[:-1]], dict(pu=pu, qu=qu, sigma2=float("nan"), converged=False)
    params, sigma2, conv = arima_fit(w, pu, qu, const)
    c = params[0] if const else 0.0
    phi = params[int(const) : int(const) + pu]
    theta = params[int(const) + pu :]
    _, e = _css_resid(params, w, pu, qu, const)
    m = max(pu, qu)
    # one-step predictions of w, then of levels
    what = np.full(len(w), float(np.mean(w)))
    for t in range(m, len(w)):
        what[t] = w[t] - e[t]
    pred = np.r_[0.0, y[:-1]]
    if d == 0:
        pred = what
    else:
        # level prediction = prediction of the d-th difference + last known levels
        for t in range(len(w)):
            idx = t + d
            base = y[idx - 1] if d == 1 else 2 * y[idx - 1] - y[idx - 2]
            pred[idx] = base + what[t]
    wf = list(w)
    ef = list(e)
    out = []
    for _ in range(steps):
        ar = sum(phi[i] * wf[-1 - i] for i in range(pu))
        ma = sum(theta[j] * ef[-1 - j] for j in range(qu))
        nxt = c + ar + ma
        out.append(nxt)
        wf.append(nxt)
        ef.append(0.0)
    fc = np.asarray(out)
    if d == 1:
        fc = y[-1] + np.cumsum(fc)
    elif d == 2:
        last_diff = y[-1] - y[-2]
        diffs = last_diff + np.cumsum(fc)
        fc = y[-1] + np.cumsum(diffs)
    return fc, pred, dict(pu=pu, qu=qu, sigma2=sigma2, converged=conv)


MODEL_OUT = (
    "service string, kind string, date date, step int, value double, "
    "p int, d int, q int, p_used int, q_used int, adf_tau double, adf_p double, adf_lag int, "
    "form string, sigma2 double, converged boolean"
)


def _arima_group(horizon: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        svc = str(pdf["service"].iloc[0])
        y = pdf["y"].to_numpy(dtype=float)
        dates = pd.to_datetime(pdf["date"]).dt.date.to_numpy()
        tau, pv, lag, _ = adf_test(y)
        form = stationary_form(y)
        p, d, q, _ = choose_pdq(y)
        fc, pred, info = arima_forecast(y, p, d, q, horizon)
        last = pd.Timestamp(dates[-1])
        fdates = [(last + pd.Timedelta(days=h)).date() for h in range(1, horizon + 1)]
        common = dict(p=p, d=d, q=q, p_used=info["pu"], q_used=info["qu"], adf_tau=tau, adf_p=pv, adf_lag=lag,
                      form=form, sigma2=info["sigma2"], converged=info["converged"])
        rows = [dict(service=svc, kind="forecast", date=dt, step=h + 1, value=float(v), **common)
                for h, (dt, v) in enumerate(zip(fdates, fc))]
        rows += [dict(service=svc, kind="predict", date=dt, step=0, value=(None if not np.isfinite(v) else float(v)),
                      **common) for dt, v in zip(dates, pred)]
        return pd.DataFrame(rows)

    return run


def arima_job(series: DataFrame, group: str = "service", horizon: int = HORIZON) -> DataFrame:
    """TS-2, 5..8, 11..13 in one grouped job over daily series: one Python task
    per service, input = that service's days (bounded by the history length)."""
    s = series.select(F.col(group).alias("service"), "date", "y")
    return s.groupBy("service").applyInPandas(_arima_group(horizon), MODEL_OUT)


def arima_forecasts(series: DataFrame, group: str = "service", horizon: int = HORIZON) -> DataFrame:
    """ARIMA forecasts in the engine's `forecasts(service, date, step, forecast)` shape."""
    m = arima_job(series, group, horizon)
    return m.filter(F.col("kind") == "forecast").select(
        F.col("service").alias(group), "date", "step", F.col("value").alias("forecast")
    )
