"""Registered queries over the given tables, each with the SQL that must return the same rows."""

from paperlode.plans import events, integrity, relations, retrieval, search, stats, surfaces, texts, vector_index  # noqa: F401
from paperlode.plans.registry import QUERIES, Query, Tables

__all__ = ["QUERIES", "Query", "Tables"]
