"""Registered queries, each beside the SQL that it must agree with."""

from .registry import QUERIES, SQL, Query

__all__ = ["SQL", "all_queries"]


def all_queries() -> dict[str, Query]:
    """Every registered query by name; importing the modules registers them."""
    from . import code_queries, engine_queries, graph_queries, index_queries, more_queries, record_queries, retrieval_queries, state_queries, store_queries, text_queries, view_queries  # noqa: F401

    return QUERIES
