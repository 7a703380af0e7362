"""All queries over the driver's tables, by name, with the SQL each must equal."""

from __future__ import annotations

from . import document_queries, editor_queries, scalar_queries, stream_queries, tree_queries  # noqa: F401
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
