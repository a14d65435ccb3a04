"""Runs a query and its SQL twin on the smallest tables and compares the rows."""

from __future__ import annotations

import os
from typing import Any

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v: Any) -> Any:
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    return tuple(plain(x) for x in v) if isinstance(v, list | tuple) else v


def rows(columns: list[str], found: list) -> list:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[k]) for k in order) for r in found), key=str)


def database():  # noqa: ANN201
    import duckdb

    c = duckdb.connect()
    for name in sorted(os.listdir(DATA)):
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return c


def compare(spark, query, sql: str) -> None:  # noqa: ANN001
    df = query(spark, DATA)
    twin = database().sql(sql)
    assert sorted(df.columns) == sorted(twin.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(list(twin.columns), twin.fetchall())
