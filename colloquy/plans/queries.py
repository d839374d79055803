"""Registry of the core queries and their SQL."""

from __future__ import annotations

from . import core_queries, data_queries, review_queries

QUERIES = {**core_queries.QUERIES, **data_queries.QUERIES, **review_queries.QUERIES}
ORACLE = {**core_queries.ORACLE, **data_queries.ORACLE, **review_queries.ORACLE}
FLAGSHIP = "qa_pairs"
