"""Numeric properties of the model operators."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from costlens.operators import anomaly as AN
from costlens.operators import forecast as FC


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(7)
    rows = []
    for g in ("a", "b"):
        vals = list(rng.normal(100, 5, 2000)) + [400.0, 500.0, -300.0]
        rows += [(g, i, float(v)) for i, v in enumerate(vals)]
    return spark.createDataFrame(rows, "service string, row_id long, cost double")


def test_forest_scores_and_labels(planted):
    out = AN.isolation_forest(planted, "service", "cost", "row_id").toPandas()
    assert len(out) == 2 * 2003
    assert ((out["raw"] < 0) & (out["raw"] > -1)).all()
    for g, part in out.groupby("service"):
        low = set(part.nsmallest(10, "score")["row_id"].tolist())
        # planted outliers are among the lowest scores (points beyond the
        # sampled range share the extreme leaf with the sample's extremes)
        assert {2000, 2001, 2002} <= low
        share = (part["anomaly"] == -1).mean()
        assert 0.18 <= share <= 0.22


def test_forest_deterministic_across_partitioning(planted):
    a = AN.isolation_forest(planted, "service", "cost", "row_id").select("row_id", "service", "raw").toPandas()
    b = AN.isolation_forest(planted.repartition(7), "service", "cost", "row_id")
    b = b.select("row_id", "service", "raw").toPandas()
    m = a.merge(b, on=["service", "row_id"])
    assert len(m) == len(a) and np.allclose(m["raw_x"], m["raw_y"], rtol=0, atol=1e-12)


def test_forest_model_is_bounded(planted):
    m = AN.iforest_fit(planted, "service", "cost", "row_id").toPandas()
    assert len(m) == 200 and m["psi"].max() == 256
    assert max(len(s) for s in m["splits"]) <= 255


def test_mackinnon_points():
    assert abs(FC.mackinnon_p(-3.43) - 0.0100) < 2e-3
    assert abs(FC.mackinnon_p(-2.86) - 0.0502) < 2e-3
    assert abs(FC.mackinnon_p(-2.57) - 0.0994) < 2e-3


def test_adf_separates_stationary_from_random_walk():
    rng = np.random.default_rng(1)
    noise = rng.normal(size=400)
    assert FC.adf_test(noise)[1] < 0.01
    walk = np.cumsum(rng.normal(size=400))
    assert FC.adf_test(walk)[1] > 0.05


def test_arma_recovery():
    rng = np.random.default_rng(3)
    n, phi, theta = 3000, 0.6, 0.3
    e = rng.normal(size=n)
    w = np.zeros(n)
    for t in range(1, n):
        w[t] = 2.0 + phi * w[t - 1] + e[t] + theta * e[t - 1]
    params, sigma2, conv = FC.arima_fit(w, 1, 1, True)
    assert abs(params[1] - phi) < 0.05 and abs(params[2] - theta) < 0.07 and abs(sigma2 - 1) < 0.1


def _series(spark, ys):
    start = dt.date(2024, 1, 1)
    return spark.createDataFrame([("s", start + dt.timedelta(days=i), float(y)) for i, y in enumerate(ys)],
                                 "service string, date date, y double")


def test_ar1_forecast_matches_closed_form(spark):
    rng = np.random.default_rng(5)
    ys = [10.0]
    for _ in range(300):
        ys.append(3.0 + 0.7 * ys[-1] + rng.normal())
    f = FC.ar1_forecast(_series(spark, ys)).orderBy("step").toPandas()
    x, y = np.array(ys[:-1]), np.array(ys[1:])
    phi, c = np.polyfit(x, y, 1)
    mu = c / (1 - phi)
    want = [mu + phi**h * (ys[-1] - mu) for h in range(1, 8)]
    assert np.allclose(f["forecast"], want, rtol=1e-9)
    assert f["date"].tolist()[0] == dt.date(2024, 1, 1) + dt.timedelta(days=len(ys))


def test_acf_matches_numpy(spark):
    rng = np.random.default_rng(9)
    ys = rng.normal(size=60).cumsum()
    got = FC.acf(_series(spark, ys)).orderBy("lag").toPandas()
    z = ys - ys.mean()
    want = [float(z[k:] @ z[: len(z) - k]) / float(z @ z) for k in range(0, 30)]
    assert len(got) == 30 and np.allclose(got["acf"], want)


def test_arima_job_outputs_seven_forecasts(spark):
    rng = np.random.default_rng(11)
    ys = 100 + rng.normal(size=200).cumsum()
    out = FC.arima_job(_series(spark, ys)).toPandas()
    fc = out[out["kind"] == "forecast"]
    assert len(fc) == 7 and fc["value"].notna().all()
    assert (out[out["kind"] == "predict"].shape[0]) == 200


def test_forest_large_group_sampling_path(spark):
    # 60,000 rows: trees * 2 * psi / n < 1, so each row is hashed once
    df = spark.range(60000).select(
        F.lit("big").alias("service"), F.col("id").alias("row_id"),
        (F.col("id") % 1000).cast("double").alias("cost"),
    )
    m = AN.iforest_fit(df, "service", "cost", "row_id").toPandas()
    assert len(m) == 100 and (m["psi"] == 256).all()
    s = AN.isolation_forest(df, "service", "cost", "row_id").agg(F.count("*"), F.min("raw"), F.max("raw")).first()
    assert s[0] == 60000 and -1 < s[1] <= s[2] < 0


def test_pacf_and_exact_quantile(spark):
    import datetime as dt

    from costlens.operators import anomaly as AN
    from costlens.operators import forecast as FC

    rng = np.random.default_rng(0)
    y = [0.0, 0.0]
    for _ in range(120):
        y.append(0.6 * y[-1] + 0.25 * y[-2] + rng.normal())
    rows = [("a", dt.date(2024, 1, 1) + dt.timedelta(i), float(v)) for i, v in enumerate(y)]
    rows += [("constant", dt.date(2024, 1, 1) + dt.timedelta(i), 1.0) for i in range(9)] + [("one", dt.date(2024, 1, 1), 5.0)]
    df = spark.createDataFrame(rows, "service string, date date, y double")
    got = FC.pacf(df).toPandas()
    a = got[got.service == "a"].sort_values("lag").pacf.to_numpy()
    z = np.array(y) - np.mean(y)
    r = np.array([z[k:] @ z[: len(z) - k] for k in range(len(a))]) / (z @ z)
    toeplitz = lambda k: np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)])
    want = [1.0] + [np.linalg.solve(toeplitz(k), r[1 : k + 1])[-1] for k in range(1, len(r))]
    assert np.allclose(a, want)
    order = {x["service"]: x["order"] for x in FC.choose_order(FC.pacf(df), value="pacf").collect()}
    assert order == {"a": 2, "constant": 0, "one": 0}
    x = rng.normal(size=3000).round(2)
    scores = spark.createDataFrame([("g", float(v)) for v in x] + [("h", 1.0)], "g string, raw double")
    for accuracy in (100, 1_000_000):
        q = {o["g"]: o["offset"] for o in AN.exact_quantile(scores, "g", "raw", 0.2, accuracy).collect()}
        assert abs(q["g"] - np.quantile(x, 0.2)) < 1e-12 and q["h"] == 1.0


def test_session_leaves_the_submitted_master_alone():
    import inspect

    from costlens import session

    assert "local[" not in inspect.getsource(session.get_session)


def test_native_scores_equal_the_trees(spark, planted):
    """Every value through every tree by hand: the same score, with values on splits, beyond them, infinite and NaN."""
    model = AN.iforest_fit(planted, "service", "cost", "row_id")
    trees = model.toPandas()
    a = trees[trees["g"] == "a"]
    edge = [float(x) for s in a["splits"][:5] for x in s[::40]]
    values = edge + [-1e9, 1e9, 0.0, -0.0, float("inf"), -float("inf"), float("nan"), 100.0, *np.linspace(80, 120, 500).tolist()]
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(values)], "service string, row_id long, cost double")
    scored = AN.iforest_score(df, model, "service", "cost", "row_id")
    got = {r.rid: r.raw for r in scored.collect()}
    for i, v in enumerate(values):
        total = sum(d[int(np.searchsorted(np.asarray(s), v, side="right"))] for s, d in zip(a["splits"], a["depths"]))
        want = -(2.0 ** (-(total / len(a)) / AN.c_factor(256)))
        assert abs(got[i] - want) < 1e-12
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Python" not in plan and "Exchange hashpartitioning" not in plan


def test_step_quantile(spark, planted):
    out = AN.isolation_forest(planted, "service", "cost", "row_id")
    got = {r.service: r.offset for r in AN.step_quantile(out, "service", "raw", 0.2).collect()}
    for g, part in out.toPandas().groupby("service"):
        assert abs(got[g] - np.percentile(part["raw"], 20)) < 1e-12
    exact = {r.service: r.offset for r in AN.exact_quantile(out, "service", "raw", 0.2).collect()}
    assert all(abs(exact[g] - got[g]) < 1e-12 for g in got)
