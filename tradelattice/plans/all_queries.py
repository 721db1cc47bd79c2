"""Imports every module that registers queries."""

from tradelattice.plans import cleaning_queries, complexity_queries, graph_queries, model_queries  # noqa: F401
from tradelattice.plans.registry import ORACLES, QUERIES  # noqa: F401
