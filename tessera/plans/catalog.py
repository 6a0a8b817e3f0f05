"""Registry of the core queries and of the SQL that checks them."""

from __future__ import annotations

from . import cohort_queries, document_queries, merge_queries, program_queries, sample_queries, stat_queries, stream_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "cohort_queries", "document_queries", "merge_queries", "program_queries", "sample_queries", "stat_queries", "stream_queries"]
