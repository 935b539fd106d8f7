"""Run registered queries beside their SQL and compare the rows.

    python tests/oracle.py [-s SF_DIR] [name or prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return 0.0 if v == 0 else v
    return v


def _key(row):
    return tuple((v is None, str(type(v).__name__) if not isinstance(v, (int, float)) else "n",
                  v if v is not None else 0) for v in row)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    names = [cols[i] for i in order]
    return names, sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=_key)


def compare(spark_rows, duck_rows):
    (nc, nr), (dc, dr) = spark_rows, duck_rows
    if nc != dc:
        return f"columns differ: {nc} / {dc}"
    if len(nr) != len(dr):
        return f"rows {len(nr)} / {len(dr)}; first only-spark {[r for r in nr if r not in dr][:2]} only-sql {[r for r in dr if r not in nr][:2]}"
    bad = [(a, b) for a, b in zip(nr, dr) if a != b]
    if not bad:
        types = [type(v).__name__ for v in (nr[0] if nr else ())], [type(v).__name__ for v in (dr[0] if dr else ())]
        return "" if types[0] == types[1] else (f"types {types}" if any(
            x != y and "NoneType" not in (x, y) for x, y in zip(*types)) else "")
    soft = all(
        x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(x - y) <= 1e-5 * max(1, abs(x)))
        for a, b in bad for x, y in zip(a, b)
    )
    return f"{'ROUNDING' if soft else 'VALUES'} {len(bad)}/{len(nr)}: {nc} spark={bad[0][0]} sql={bad[0][1]}"


def check(spark, con, folder, name, fn, sql):
    t = time.time()
    df = fn(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - t
    if sql is None:
        return took, len(got[1]), "", True
    t = time.time()
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    return took, len(got[1]), compare(got, want), False


def main():
    from tidemark.plans.catalog import ORACLE_SQL, QUERIES
    from tidemark.session import local_session

    args = sys.argv[1:]
    folder = "/root/testdata/sf0.01"
    if args[:1] == ["-s"]:
        folder, args = args[1], args[2:]
    names = [n for n in QUERIES if not args or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args)]
    spark, con, bad = local_session(), connect(folder), 0
    for n in names:
        try:
            took, rows, why, loose = check(spark, con, folder, n, QUERIES[n], ORACLE_SQL.get(n))
        except Exception as ex:  # noqa: BLE001
            took, rows, why, loose = 0, 0, "ERROR " + str(ex)[:300], False
        bad += bool(why)
        mark = "BAD " if why else ("rows" if loose else "ok  ")
        if why or took > 4 or rows == 0 or loose or len(names) < 12:
            print(f"{mark} {n} rows={rows} {took:.1f}s {why}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    sys.stdout.flush()
    os._exit(1 if bad else 0)


if __name__ == "__main__":
    main()
