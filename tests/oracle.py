"""Hold a query against its SQL, as the driver does: columns by name, rows in any order."""

import os

import duckdb


def connection(data):
    con = duckdb.connect()
    for name in os.listdir(data):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{data}/{name}'")
    return con


def plain(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    return str([plain(v) for v in value]) if isinstance(value, (list, tuple)) else str(value)


def same(frame, con, sql):
    names = sorted(frame.columns)
    ours = sorted(tuple(plain(r[n]) for n in names) for r in frame.collect())
    cursor = con.execute(sql)
    theirs_names = [d[0] for d in cursor.description]
    assert sorted(theirs_names) == names
    theirs = sorted(tuple(plain(r[theirs_names.index(n)]) for n in names) for r in cursor.fetchall())
    assert ours == theirs
