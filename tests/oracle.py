"""Running a query's SQL in DuckDB and comparing rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "array<bigint>": "BIGINT[]",
}


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(map(_plain, x))
    return x


def _sorted(rows):
    return sorted((tuple(map(_plain, r)) for r in rows), key=repr)


def assert_same(df, sql: str, sf_dir: str) -> None:
    """Same columns, types and rows, in any order."""
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    expected = con.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(expected.columns)
    kinds = dict(zip(expected.columns, map(str, expected.types), strict=True))
    assert {c: TYPES[t] for c, t in df.dtypes} == kinds
    ours = _sorted(tuple(r) for r in df.select(names).collect())
    theirs = _sorted(expected.select(*[f'"{n}"' for n in names]).fetchall())
    assert ours == theirs
