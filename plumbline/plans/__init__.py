"""Ready-made queries over the driver tables and their DuckDB twins."""

from __future__ import annotations

from importlib import import_module

_MODULES = (
    "rule_queries", "profile_queries", "violation_queries", "report_queries", "text_queries",
    "stream_queries",
)


def load_all():
    """name -> registered query, in a stable order."""
    from plumbline.plans.catalog import REGISTRY

    for module in _MODULES:
        import_module(f"plumbline.plans.{module}")
    return REGISTRY
