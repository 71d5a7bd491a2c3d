"""All queries of the subpackage."""

from .queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
