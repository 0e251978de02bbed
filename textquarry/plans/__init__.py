"""Registered queries over the driver's tables."""

from textquarry.plans import analytics_queries, graph_queries, search_queries  # noqa: F401
from textquarry.plans.registry import ORACLES, QUERIES  # noqa: F401
