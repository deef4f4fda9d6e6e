"""All queries of the core library; importing a module registers its queries."""

from corvane.plans import compose_queries, delivery_queries, graph_queries, map_queries, orphan_queries, search_queries, source_queries, text_queries  # noqa: F401
from corvane.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
