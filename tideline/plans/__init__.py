"""Operators wired to tables."""

from tideline.plans.registry import QUERIES, Query


def all_queries() -> dict[str, Query]:
    """Every named query; importing the modules registers them."""
    from tideline.plans import horizontal, leadlag, outcomes, relations, reporting, screening, texts  # noqa: F401
    return dict(QUERIES)
