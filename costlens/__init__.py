"""costlens: multi-cloud cost analytics as Spark DataFrame jobs.

Billing exports, metric points and resource inventories go in as DataFrames;
clean cost, pivots, anomaly labels, thresholds, forecasts, alerts and
findings come out as DataFrames.  Every operator is a lazy plan; nothing is
collected to the driver inside the library.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions of this package that run inside Python workers (grouped pandas
# functions) are shipped by value with the task, so executors need only
# pyspark, numpy and pandas — not this package on their path.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

from costlens.session import get_session  # noqa: E402

__all__ = ["get_session"]
