"""Registered queries over the given tables, each with the SQL that must agree."""

from checks import code_queries, graph_queries, log_queries, risk_queries, source_queries, text_queries  # noqa: F401
from checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
