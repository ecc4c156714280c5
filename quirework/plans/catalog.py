"""Queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, **parts: str):
    """Registers a function (spark, sf_dir) -> DataFrame under its name; @name@ in the SQL stands for a part."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            text = sql
            for name, value in parts.items():
                text = text.replace(f"@{name}@", value)
            SQL[function.__name__] = text
        return function

    return add


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"
