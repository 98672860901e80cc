"""Rows of a query and of its SQL, as sorted lists that can be compared."""

from __future__ import annotations

import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    return int(value) if isinstance(value, bool) else value


def ordered(names, rows):
    at = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(([plain(r[k]) for k in at] for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


def both(con, frame, sql):
    """(columns, rows) of the frame and of the SQL."""
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    want = sorted(names), ordered(names, found.fetchall())
    return (sorted(frame.columns), ordered(frame.columns, frame.collect())), want
