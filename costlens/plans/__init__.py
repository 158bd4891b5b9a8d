"""Composed plans: the batch job, the alert request, and the registered test queries."""

from costlens.plans.registry import REGISTRY, Query, query  # noqa: F401
from costlens.plans import q_billing, q_checks, q_metrics, q_models  # noqa: F401  (register queries)

q_models._late_registrations()


def all_queries() -> dict[str, Query]:
    return dict(REGISTRY)
