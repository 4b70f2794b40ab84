"""All queries of the library, and for each the SQL that gives the same rows."""

from __future__ import annotations

from . import file_queries, model_queries, order_queries, report_queries, star_queries, text_queries
from .registry import QUERIES, SQL

flagship = report_queries.lexical_correlation

__all__ = ["QUERIES", "SQL", "file_queries", "flagship", "model_queries", "order_queries", "report_queries", "star_queries", "text_queries"]
