"""Each query with SQL gives the rows that DuckDB gives for it."""

import math
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()
ONLY = os.environ.get("ORACLE_ONLY", "")


def plain(value):
    if value is None:
        return "\0"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return "nan" if isinstance(value, float) and math.isnan(value) else f"{float(value):.9g}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}:{plain(v)}" for k, v in sorted(value.items())) + "}"
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    return str(value)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in sorted(Path(SF).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(n for n in SQL if ONLY in n))
def test_query_matches_sql(spark, duck, name):
    assert name in QUERIES
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    got = sorted([plain(r[c]) for c in columns] for r in found.collect())
    rows = duck.execute(SQL[name])
    names = [d[0] for d in rows.description]
    assert sorted(names) == columns
    want = sorted([plain(dict(zip(names, r))[c]) for c in columns] for r in rows.fetchall())
    assert len(got) == len(want), (len(got), len(want))
    wrong = [(g, w) for g, w in zip(got, want) if g != w]
    assert not wrong, wrong[:2]


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in SQL and ONLY in n and not n.startswith("op") and n != "pipeline"))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0
