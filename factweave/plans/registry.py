"""All queries of the fact operators."""

from __future__ import annotations

from . import bound_queries, branch_queries, concurrency_queries, condition_queries, derive_queries, draft_queries, graph_queries, join_queries, machine_queries, rescan_queries, round_queries, row_queries, stream_queries, symbol_queries, table_queries, time_queries, tree_queries, whole_queries  # noqa: F401
from .bindings import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
