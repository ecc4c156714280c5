"""All queries of the library with their SQL."""

from __future__ import annotations


def _load():
    from . import catalog, queries_numeric, queries_retrieval, queries_rows, queries_store, queries_text  # noqa: F401

    return catalog


def queries() -> dict:
    return dict(_load().QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_load().SQL)
