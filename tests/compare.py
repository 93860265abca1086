"""Spark results against DuckDB on the driver's tables."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return c


def canonical(df: pd.DataFrame) -> list[tuple]:
    def one(x):
        if isinstance(x, float):
            return "null" if x != x else f"{x:.6f}"
        if hasattr(x, "tolist") and not isinstance(x, (str, bytes)):
            return str(x.tolist())
        return "null" if x is None or x is pd.NaT else str(x)

    df = df[sorted(df.columns)]
    return sorted(tuple(map(one, row)) for row in df.itertuples(index=False))


def assert_same(spark_df, sql, folder):
    got, want = spark_df.toPandas(), duck(folder).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)
