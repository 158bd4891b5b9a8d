"""Column-level helpers: pure `Column -> Column` expressions, all JVM-side."""

from costlens.functions.columns import (
    canonical_service,
    dsum,
    exact,
    finite,
    davg,
    interval_date,
    to_number,
    quantity,
    cpu_milli,
    mem_mib,
    lit_ts,
    whole_days_between,
)

__all__ = [
    "canonical_service",
    "dsum",
    "exact",
    "finite",
    "davg",
    "interval_date",
    "to_number",
    "quantity",
    "cpu_milli",
    "mem_mib",
    "lit_ts",
    "whole_days_between",
]
