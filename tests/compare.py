"""Rows of Spark and DuckDB as comparable text."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(x):
    if not isinstance(x, (list, tuple)) and pd.isna(x):
        return None
    return round(float(x), 9) if isinstance(x, (int, float)) and not isinstance(x, bool) else x


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(map(repr, (tuple(map(cell, r)) for r in df[cols].astype(object).itertuples(index=False))))
