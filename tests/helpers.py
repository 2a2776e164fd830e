"""Running a query and its SQL on the same small tables."""

import decimal

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    return f"{v:f}" if isinstance(v, decimal.Decimal) else repr(v) if isinstance(v, float) else v


def rows_of(df):
    cols = sorted(df.columns)
    return sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=str), cols


def oracle(sql, sf=SF):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    r = c.execute(sql)
    names = [x[0] for x in r.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(x[i]) for i in order) for x in r.fetchall()), key=str), sorted(names)
