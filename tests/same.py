"""Compare a Spark frame with DuckDB's rows, as sets of rows with their columns sorted by name."""

import decimal
import math

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (decimal.Decimal, int, float)):
        return None if math.isnan(float(v)) else round(float(v), 8)
    return pd.Timestamp(v).isoformat() if hasattr(v, "isoformat") else v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(([value(r[i]) for i in order] for r in rows), key=lambda r: [str(x) for x in r])


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def assert_same(df, connection, sql):
    got = connection.execute(sql)
    want = table([d[0] for d in got.description], got.fetchall())
    have = table(df.columns, [tuple(r) for r in df.collect()])
    assert have[0] == want[0]
    assert len(have[1]) == len(want[1])
    assert have[1] == want[1]
