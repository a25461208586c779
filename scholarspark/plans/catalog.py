"""All registered queries; importing a module of queries registers them."""

from . import extraction_queries, graph_queries, maintenance_queries, relational_queries, retrieval_queries, service_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
