"""Spark rows against DuckDB rows, in any order."""

import glob
import os

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{source}')")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    def cell(x):
        if isinstance(x, float):
            return "" if x != x else str(round(x, 6))
        return "" if x is None or x is pd.NA or x is pd.NaT else str(x)

    df = df.reindex(sorted(df.columns), axis=1)
    return sorted(tuple(cell(x) for x in r) for r in df.itertuples(index=False))


def same(spark_df, sql: str, con) -> None:
    got, want = spark_df.toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
