"""Compare a query with its SQL on the same files, the rows in any order.

``python tests/compare.py [folder] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def plain(value):
    if value is None:
        return ("",)
    if isinstance(value, bool):
        return ("b", value)
    if isinstance(value, (int, float)):
        if isinstance(value, float) and math.isnan(value):
            return ("nan",)
        return ("n", round(float(value), 6))
    if isinstance(value, datetime.datetime):
        return ("t", value.replace(tzinfo=None).isoformat())
    if isinstance(value, (list, tuple)):
        return ("l",) + tuple(plain(v) for v in value)
    return ("s", str(value))


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def connect(folder, inside=""):
    """``inside`` is the pattern of files where the conversations are a folder of them."""
    con = duckdb.connect()
    for name in TABLES:
        path = f"{folder}/{name}.parquet" + (inside if name == "conversations" else "")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def difference(spark, con, query, sql, folder):
    """None when equal, else a short description."""
    df = query(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    want = rows_of(names, cursor.fetchall())
    if got == want:
        return None if got else "both empty"
    off = next((i for i, (a, b) in enumerate(zip(got, want)) if a != b), min(len(got), len(want)))
    show = lambda rows: str(rows[off])[:600] if off < len(rows) else "-"
    return f"{len(got)} rows against {len(want)}\n   spark {show(got)}\n   sql   {show(want)}"


def main():
    import __spark_entry__ as entry
    from parley.session import local_session

    args = sys.argv[1:]
    folder = args[0] if args and "/" in args[0] else "/root/testdata/sf0.01"
    names = [a for a in args if "/" not in a]
    spark, con = local_session(8), connect(folder)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, query in queries.items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        start = time.time()
        try:
            if name in sql:
                found = difference(spark, con, query, sql[name], folder)
            else:
                found = None if query(spark, folder).count() else "no rows"
        except Exception as error:  # noqa: BLE001 - report and go on
            found = f"{type(error).__name__}: {str(error)[:900]}"
        bad += found is not None
        kind = "sql " if name in sql else "rows"
        print(f"{'OK  ' if found is None else 'FAIL'} {kind} {time.time() - start:6.2f}s {name} {found or ''}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
