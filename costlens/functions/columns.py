"""Expression builders shared by the operators.

Everything here returns a `pyspark.sql.Column`; nothing runs Python per row.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Exact arithmetic of money and metrics: values are rounded to 10 decimals and
# may be as large as 1e28, so 4e-7 and 5e12 both add up exactly and a total does not
# depend on the order in which partitions are combined (D: SURVEY 1.2).
MONEY = "decimal(38,10)"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c) -> Column:
    """The value, or null if it is NaN or infinite."""
    return F.when(F.abs(_c(c)) < float("inf"), _c(c))  # NaN is above infinity


def exact(c) -> Column:
    """A finite value as an exact decimal, or null if it is 1e28 or more."""
    return finite(c).try_cast(MONEY)


def dsum(c) -> Column:
    """Order-independent sum of a double column, returned as double.

    NaN and infinite values are left out, as nulls are.  Null if a value or
    the sum is out of the decimal's range (1e28); parts of a value under 5e-11
    are rounded away."""
    fits = F.count(exact(c)) == F.count(finite(c))
    return F.when(fits, F.try_sum(exact(c)).cast("double"))


def davg(c) -> Column:
    """Mean of the finite values, not dependent on partition order (exact sum / count); null where `dsum` is."""
    return F.try_divide(dsum(c), F.count(finite(c)).cast("double"))


def interval_date(c) -> Column:
    """CLN-3: date part of an ISO interval `start/end` — text before the first `T`; null if that isn't a date."""
    return F.substring_index(_c(c), "T", 1).try_cast("date")


# A plain decimal literal, optionally signed, with an optional exponent, blanks
# around it allowed.  Spark's cast also takes `1d` / `2f` (Java suffixes),
# which a tolerant numeric parser must reject; this guard does that.
_NUMERIC_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def to_number(c) -> Column:
    """CLN-7: text -> double; anything that is not a plain number becomes null."""
    s = _c(c).cast("string")
    return F.when(s.rlike(_NUMERIC_TEXT), F.trim(s).try_cast("double"))


# Names of services in the billing exports that differ from the
# names under which thresholds and checks are kept.
BILLING_NAMES = {
    "awskms": "AWSKMS",
    "Compute Engine": "ComputeEngine",
    "Kubernetes Engine": "KubernetesEngine",
}


def canonical_service(c) -> Column:
    """A service name of a billing export -> the engine's name of that service (others stay)."""
    s = _c(c)
    out = s
    for k, v in BILLING_NAMES.items():
        out = F.when(s == k, F.lit(v)).otherwise(out)
    return out


# Kubernetes quantity suffixes and their multipliers
# (decimal SI and binary IEC forms, as defined by the Kubernetes API).
_SUFFIX_FACTORS = {
    "n": 1e-9,
    "u": 1e-6,
    "m": 1e-3,
    "": 1.0,
    "k": 1e3,
    "M": 1e6,
    "G": 1e9,
    "T": 1e12,
    "P": 1e15,
    "E": 1e18,
    "Ki": 2.0**10,
    "Mi": 2.0**20,
    "Gi": 2.0**30,
    "Ti": 2.0**40,
    "Pi": 2.0**50,
    "Ei": 2.0**60,
}


def quantity(c) -> Column:
    """GKE-6: Kubernetes quantity text (`500m`, `128Mi`, `16Ki`, `2`) -> base units."""
    s = F.trim(_c(c).cast("string"))
    num = F.regexp_extract(s, r"^([+-]?[0-9.]+(?:[eE][+-]?[0-9]+)?)", 1)
    suffix = F.regexp_extract(s, r"^[+-]?[0-9.]+(?:[eE][+-]?[0-9]+)?([A-Za-z]*)$", 1)
    factor = F.lit(None).cast("double")
    for k, v in _SUFFIX_FACTORS.items():
        factor = F.when(suffix == k, F.lit(v)).otherwise(factor)
    return F.try_multiply(num.try_cast("double"), factor)


def cpu_milli(c) -> Column:
    """CPU quantity in milli-cores (`500m` -> 500, `2` -> 2000, `250000000n` -> 250)."""
    return F.round(quantity(c) * F.lit(1000.0), 6)


def mem_mib(c) -> Column:
    """Memory quantity in MiB (`128Mi` -> 128, `1Gi` -> 1024, `16384Ki` -> 16)."""
    return F.round(quantity(c) / F.lit(2.0**20), 6)


def lit_ts(v) -> Column:
    """A timestamp literal from a `datetime`, `date` or ISO text (UTC session)."""
    if isinstance(v, Column):
        return v
    if isinstance(v, _dt.datetime):
        v = v.strftime("%Y-%m-%d %H:%M:%S.%f")
    elif isinstance(v, _dt.date):
        v = v.isoformat()
    return F.lit(str(v)).cast("timestamp_ntz")


def whole_days_between(earlier, later) -> Column:
    """Whole elapsed 24-hour days from `earlier` to `later` (not midnights crossed)."""
    return F.floor(
        (F.unix_micros(_c(later).cast("timestamp")) - F.unix_micros(_c(earlier).cast("timestamp")))
        / F.lit(86_400_000_000)
    )
