"""All registered queries of the library, and their SQL."""

from __future__ import annotations

from . import feature_rows, features, finance, lookups, research, texts
from .base import Query

_PARTS = (features, feature_rows, research, finance, texts, lookups)


def queries() -> dict[str, Query]:
    return {name: q for part in _PARTS for name, q in part.registry.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.registry.sql.items()}
