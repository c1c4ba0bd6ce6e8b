"""Queries over the driver's tables, each with its SQL counterpart where SQL can say it."""

from . import catalog, evidence, handoffs, projects, surface, texts, timelines
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
