"""Rows of a query beside those of its SQL in DuckDB."""

import os

import duckdb

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in NAMES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return c


def rows(df, columns):
    return sorted(map(repr, df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False, name=None)))


def same(df, sql, sf_dir):
    a, b = df.toPandas(), connect(sf_dir).execute(sql).df()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    assert rows(a, columns) == rows(b, columns)
    return len(a)
