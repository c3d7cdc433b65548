"""Registry of the queries of the econometrics operators and of the SQL that checks them."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def _load() -> None:
    from . import queries as _  # noqa: F401  registers on import


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict:
    _load()
    return dict(ORACLES)
