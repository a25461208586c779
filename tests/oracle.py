"""Comparison of a query with its oracle, independent of row order, column order and number types."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x):
    if x is None:
        return "~"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (list, tuple)):
        return str([cell(y) for y in x])
    if isinstance(x, dict):
        return str({k: cell(v) for k, v in x.items()})
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        f = float(x)
        return "~" if f != f else format(round(f, 5) + 0.0, ".5f")
    return str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(cell(r[k]) for k in order) for r in rows)


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def assert_same(df, con, sql):
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = rows_of(columns, found.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert len(got) == len(want)
    assert got == want
    return got
