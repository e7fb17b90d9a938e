"""All queries on the driver's tables, by name, and the SQL that checks them."""

from __future__ import annotations

from . import coverage_queries, event_queries, feature_queries, forensic_queries, io_queries, model_queries, ranking_queries, review_queries, screening_queries, statement_queries, text_queries  # noqa: F401  (they register themselves)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
