"""Named queries over the tables, each with the SQL that checks it where SQL can express it."""

from __future__ import annotations

from . import functions, graphs, learning, relational, sources, stats, streams, texts, vectors  # noqa: F401
from .base import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
