"""Spark rows against DuckDB rows, whatever their order."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sql, folder):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con.sql(sql).df()


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted(tuple("null" if v is None or v is pd.NA or v != v else str(v) for v in r) for r in frame[names].astype(object).values.tolist())
