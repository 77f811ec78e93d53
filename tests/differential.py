"""A query against its SQL: rows as multisets, columns by name, types that mean the same."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def differences(got, con, sql):
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in sorted(names))) for r in want.fetchall())
    if sorted(got.columns) != sorted(names):
        return f"columns {sorted(got.columns)} and {sorted(names)}"
    rows = sorted(repr(tuple(plain(r[c]) for c in sorted(names))) for r in got.collect())
    if rows == want:
        return "" if rows else "no rows"
    a, b = sorted(set(rows) - set(want))[:3], sorted(set(want) - set(rows))[:3]
    return f"{len(rows)} and {len(want)} rows; only Spark {a}; only SQL {b}"
