"""Comparing a query's rows with those of its SQL in DuckDB."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    def shown(x):
        if x is None or x is pd.NA or isinstance(x, float) and x != x:
            return "null"
        if isinstance(x, float):  # pandas has whole numbers beside nulls as floats
            return repr(round(x, 6) + 0.0).removesuffix(".0")
        return str(x.tolist() if hasattr(x, "tolist") else x)

    return sorted(tuple(shown(x) for x in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


def same(spark, sf_dir, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    ours, theirs = query(spark, sf_dir).toPandas(), con.sql(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
