"""All registered queries."""

from . import decision_queries, metric_queries, protocol_queries, similarity_queries  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
