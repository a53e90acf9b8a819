"""One session for all tests, and comparison with DuckDB in the way of an order-free diff."""

from __future__ import annotations

import math
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
DATA = Path("/root/testdata")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from tessera.session import local_session

    session = local_session(cores=4, partitions=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def plain(value):
    """A value that both engines give alike: floats to nine digits, arrays and structs as tuples."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}") + 0.0
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in sorted(value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    if hasattr(value, "as_tuple"):
        return plain(float(value))
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck(folder, sql: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = Path(folder) / f"{t}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/*.parquet')" if path.is_dir() else f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    return names, found.fetchall()


@pytest.fixture(scope="session")
def same(spark):
    """same(query, sql, folder): both engines give the same columns and rows; returns the number of rows."""

    def check(query, sql: str, folder) -> int:
        df = query(spark, str(folder))
        names, theirs = duck(folder, sql)
        ours = df.collect()
        assert sorted(df.columns) == sorted(names)
        a, b = rows_of(df.columns, ours), rows_of(names, theirs)
        assert len(a) == len(b)
        for x, y in zip(a, b):
            assert x == y
        return len(a)

    return check
