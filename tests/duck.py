"""Comparison of a DataFrame with an oracle's rows."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def same(df, connection, sql):
    a, b = df.toPandas(), connection.execute(sql).df()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    assert len(a) == len(b)
    x, y = (t[columns].astype(str).sort_values(columns).reset_index(drop=True) for t in (a, b))
    assert x.equals(y)
