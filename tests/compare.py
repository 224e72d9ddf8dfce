"""Runs registered queries next to their SQL: python tests/compare.py FOLDER [names]."""

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}" if abs(value) < 1e6 else f"{value:.3f}"
    if isinstance(value, bool) or value is None:
        return str(value)
    if hasattr(value, "as_tuple"):
        return plain(float(value))
    if isinstance(value, int):
        return str(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows), sorted(columns)


def compare(query, sql, spark, folder, con):
    df = query(spark, folder)
    ours, our_columns = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    theirs, their_columns = rows_of(columns, cursor.fetchall())
    if our_columns != their_columns:
        return f"columns {our_columns} != {their_columns}"
    if ours == theirs:
        return None
    extra = [r for r in ours if r not in set(theirs)][:1]
    lack = [r for r in theirs if r not in set(ours)][:1]
    return f"rows {len(ours)} vs {len(theirs)}\n  spark only: {str(extra)[:700]}\n  sql only:   {str(lack)[:700]}"


def main():
    from optrace.plans.oracle import ORACLES
    from optrace.plans.queries import QUERIES
    from optrace.session import local_session

    folder, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark, con = local_session(), connect(sys.argv[1])
    for name in names:
        started = time.time()
        if name not in ORACLES:
            print(f"{name}: no SQL", flush=True)
            continue
        try:
            problem = compare(QUERIES[name], ORACLES[name], spark, folder, con)
        except Exception as error:  # noqa: BLE001 - report and go on
            problem = f"{type(error).__name__} {str(error)[:500]}"
        print(f"{name}: {'ok' if problem is None else problem} ({time.time() - started:.1f}s)", flush=True)


if __name__ == "__main__":
    main()
