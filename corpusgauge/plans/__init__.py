"""Views, registered queries and oracles."""

from __future__ import annotations

import importlib

MODULES = [
    "rollup_queries", "metric_queries", "text_queries", "judging_queries", "curation_queries", "io_queries",
    "evaluation_queries",
]


def load():
    """All registered queries and their oracle SQL."""
    from corpusgauge.plans import registry

    for name in MODULES:
        importlib.import_module(f"corpusgauge.plans.{name}")
    return registry.QUERIES, registry.ORACLES
