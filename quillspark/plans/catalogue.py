"""All queries of the catalogue, by identifier."""

from __future__ import annotations

from . import dictionaries, further, more, relational, services, texts, whole  # noqa: F401  (they register their queries)
from .registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
