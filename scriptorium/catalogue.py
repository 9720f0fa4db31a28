"""The library's own queries by name, and their DuckDB SQL."""

from __future__ import annotations

from scriptorium.plans import decided, entities, events, fulltexts, library, mapped, matched, replays, runs, search, written  # noqa: F401  they register their queries
from scriptorium.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
