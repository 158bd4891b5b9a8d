"""The shared metric cube answers every windowed statistic exactly as the raw points do."""

import pytest

from costlens.operators import metrics as M
from costlens.operators.checks import aws as A
from costlens.operators.checks import gcp as G
from costlens.sources.fixtures import Tables

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


# as_of on a grain boundary, and two that are not (cells split at the offset)
@pytest.mark.parametrize("as_of", ["2024-01-31 00:00:00", "2024-01-30 13:07:00", "2024-01-30 21:59:41"])
def test_cube_matches_points(spark, as_of):
    pts = Tables(spark, SF).metric_points
    cube = M.metric_cube(pts, as_of, "7 days")
    for lookback, period in [("1 day", "1 hour"), ("60 minutes", "1 day"), ("7 days", "1 day"), ("1 day", "300 seconds")]:
        a = M.metric_stats(pts, as_of, lookback, period)
        b = M.metric_stats(cube, as_of, lookback, period)
        assert _rows(a) == _rows(b), (lookback, period)
    assert _rows(M.peak(pts, as_of, "1 day", ["view"])) == _rows(M.peak(cube, as_of, "1 day", ["view"]))
    assert _rows(A.high_data_points(pts, as_of, 1440, 5)) == _rows(A.high_data_points(cube, as_of, 1440, 5))
    assert _rows(G.egress_rate(pts, as_of, 0.01, metric="signup")) == _rows(G.egress_rate(cube, as_of, 0.01, metric="signup"))


def test_cube_rejects_uncovered_windows(spark):
    cube = M.metric_cube(Tables(spark, SF).metric_points, "2024-01-31", "1 day", materialize=False)
    with pytest.raises(ValueError):
        cube.window("2024-01-31", "7 days")
    with pytest.raises(ValueError):
        cube.window("2024-01-30", "1 hour")
    with pytest.raises(ValueError):
        M.metric_stats(cube, "2024-01-31", "1 day", "7 minutes")


def test_report_reads_metrics_once(spark):
    from costlens.plans.q_models import all_findings, union_of_checks

    def scans(shared):
        made = (all_findings if shared else union_of_checks)(spark, SF)
        return made._jdf.queryExecution().executedPlan().toString().count("events.parquet")

    # every windowed metric check reads the cube; the remaining scans of the
    # events table are the other inventories built on it (objects, audit
    # events, deliveries) and the all-time metric list of CW-1
    assert scans(True) <= 6 < 30 <= scans(False)
