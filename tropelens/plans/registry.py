"""All queries of the library proper, and the SQL that each must agree with."""

from __future__ import annotations

from tropelens.plans import bundle_queries, item_queries, label_queries, more_queries, pattern_queries, prose_queries, study_queries, text_queries, vector_queries
from tropelens.plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "bundle_queries", "item_queries", "label_queries", "more_queries", "pattern_queries", "prose_queries", "study_queries", "text_queries", "vector_queries"]
