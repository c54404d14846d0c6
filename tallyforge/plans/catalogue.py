"""Registered queries of the engine: name -> (query, comparison SQL or None)."""

from __future__ import annotations

REGISTERED: dict[str, tuple] = {}


def register(name: str, query, sql: str | None) -> None:
    if name in REGISTERED:
        raise ValueError(f"{name} is registered twice")
    REGISTERED[name] = (query, sql)


def queries() -> dict:
    return {name: query for name, (query, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}


def _all() -> dict[str, tuple]:
    from tallyforge.plans import bank_queries, file_queries, release_queries, service_queries  # noqa: F401  they register on import

    return REGISTERED
