"""Registered queries over the test tables."""

from catalog import corpus_queries, text_queries, evaluation_queries, report_queries  # noqa: F401
from catalog import model_queries, response_queries  # noqa: F401
from catalog.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
