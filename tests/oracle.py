"""Run a query beside its SQL in DuckDB and compare rows, whatever their order."""

import os
from pathlib import Path

import duckdb
import pandas as pd

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(sf: str = SF):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}/*.parquet'" if p.is_dir() else f"create view {p.stem} as select * from '{p}'")
    return con


def _plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, float):
        return None if v != v else int(v) if v == int(v) else round(v, 6)
    return v


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    return sorted(tuple(str(_plain(v)) for v in r) for r in df.itertuples(index=False))


def same(spark, query, sql: str, sf: str = SF) -> None:
    got, want = query(spark, sf).toPandas(), connect(sf).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
