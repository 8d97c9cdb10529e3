"""Compare a Spark result with DuckDB's, as an unordered table of values."""

import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def value(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, float):
        return None if x != x else round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(map(value, x))
    return x


def rows(names, table):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(value(r[i]) for i in order) for r in table), key=repr)


def check(con, df, sql):
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, result.fetchall())
