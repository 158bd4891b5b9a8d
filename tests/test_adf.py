"""The augmented Dickey-Fuller test and the orders in native operators, against least squares in numpy."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from costlens.operators import forecast as FC


def made(n, seed):
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 1, n)
    ar = np.zeros(n)
    for t in range(2, n):
        ar[t] = 0.5 * ar[t - 1] + 0.3 * ar[t - 2] + e[t]
    return {
        f"white{n}": rng.normal(10, 1, n),
        f"walk{n}": np.cumsum(rng.normal(0, 1, n)) + 1000,
        f"lags{n}": ar,
        f"walk of lags{n}": np.cumsum(ar),
        f"twice{n}": np.cumsum(np.cumsum(rng.normal(0, 1, n))),
    }


@pytest.fixture(scope="module")
def many():
    out = {}
    for i, n in enumerate((1, 2, 3, 6, 7, 8, 20, 100, 700)):
        out |= made(n, i)
    return out


def table(spark, series):
    day = dt.date(2000, 1, 1)
    rows = [(k, day + dt.timedelta(days=i), None if v is None else float(v)) for k, ys in series.items() for i, v in enumerate(ys)]
    return spark.createDataFrame(rows, "service string, date date, y double").repartition(7)


def test_statistic_lag_and_p_equal_least_squares(spark, many):
    got = {r.service: r for r in FC.adf(table(spark, many)).collect()}
    assert set(got) == set(many)
    lags = set()
    for k, ys in many.items():
        tau, p, lag, nobs = FC.adf_test(ys)
        g = got[k]
        assert (g.lag, g.nobs) == (lag, nobs), k
        if math.isnan(tau):
            assert g.tau is None and g.p is None and not g.stationary
        else:
            assert g.tau == pytest.approx(tau, rel=1e-6, abs=1e-8) and g.p == pytest.approx(p, rel=1e-5, abs=1e-12), k
            assert g.stationary == (p <= 0.05)
        lags.add(lag)
    assert len(lags) > 3


def test_orders_equal_those_of_the_numpy_choice(spark, many):
    df = table(spark, many)
    ds = {r.service: r.d for r in FC.choose_d(df).collect()}
    orders = {r.service: (r.p, r.d, r.q) for r in FC.model_orders(df).collect()}
    for k, ys in many.items():
        p, d, q, _ = FC.choose_pdq(ys)
        assert ds[k] == d == orders[k][1], k
        assert orders[k][2] == q, k
        if len(ys) > 20:  # the last coefficients of Durbin-Levinson and of least squares differ on a few values
            assert orders[k][0] == p, k
    assert {d for d in ds.values()} == {0, 1, 2}


def test_odd_series(spark):
    odd = {
        "constant": [0.1] * 50,
        "straight": [float(i) for i in range(50)],
        "gaps": [None, 1.0, 4.0, None, 2.0, 8.0, 5.0, 7.0, math.nan, 1.0, 0.0, 3.0, math.inf, 2.0],
        "large": [1e12 + v for v in made(100, 3)["white100"]],
    }
    got = {r.service: r for r in FC.adf(table(spark, odd)).collect()}
    assert got["constant"].tau is None and not got["constant"].stationary
    kept = np.array([1.0, 4.0, 2.0, 8.0, 5.0, 7.0, 1.0, 0.0, 3.0, 2.0])
    assert got["gaps"].tau == pytest.approx(FC.adf_test(kept)[0], rel=1e-6)
    assert got["large"].tau == pytest.approx(FC.adf_test(made(100, 3)["white100"])[0], rel=1e-3) and got["large"].stationary
    assert FC.adf(table(spark, odd).where("false")).count() == 0
    assert FC.model_orders(table(spark, odd).where("false")).count() == 0


def test_repeated_dates_and_clashing_columns(spark):
    df = table(spark, {"a": made(30, 1)["white30"]}).withColumn("n", F.lit("x")).withColumn("days", F.lit("y"))
    assert FC.choose_d(df).columns == ["service", "n", "d", "tau", "lag"]
    assert FC.choose_d(df.unionAll(df)).count() == 1


def test_p_values(spark):
    taus = [-30.0, -18.0, -8.0, -3.5, -2.861592763096974, -1.61, -1.6, 0.0, 1.0, 2.7, 2.8]
    got = spark.createDataFrame([(t,) for t in taus], "t double").select("t", FC.mackinnon(F.col("t")).alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(FC.mackinnon_p(r.t), rel=1e-6, abs=1e-13)
    assert FC.mackinnon_p(FC.TAU_5) == pytest.approx(0.05, abs=1e-9)


def test_one_shuffle_and_no_python(spark, many):
    plan = FC.choose_d(table(spark, {"a": many["walk100"]}))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
