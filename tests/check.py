"""Run registered queries next to their SQL twins and compare the values. ``python tests/check.py [dir] [name..]``."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def plain(value):
    """One comparable form for a value of either engine."""
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (float, decimal.Decimal)):
        number = float(value)
        return "nan" if math.isnan(number) else f"{number:.9g}"
    if isinstance(value, int):
        return f"{float(value):.9g}" if abs(value) < 2**31 else str(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


def duck(sf_dir):
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def compare(spark, connection, sf_dir, name, job, twin):
    """None when equal, otherwise a short account of the difference."""
    frame = job(spark, sf_dir)
    got = rows_of(frame.columns, frame.collect())
    if twin is None:
        return None if got else "no rows"
    cursor = connection.execute(twin)
    columns = [c[0] for c in cursor.description]
    want = rows_of(columns, cursor.fetchall())
    if sorted(columns) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} / twin {sorted(columns)}"
    if not want:
        return "twin gives no rows"
    if got == want:
        return None
    mine, theirs = set(got), set(want)
    return (f"rows {len(got)} / twin {len(want)}\n   only spark: {[r[:600] for r in sorted(mine - theirs)[:2]]}"
            f"\n   only twin:  {[r[:600] for r in sorted(theirs - mine)[:2]]}")


if __name__ == "__main__":
    import __spark_entry__ as entry
    from corpusloom.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    wanted = sys.argv[2:]
    spark = local_session("8")
    connection = duck(sf_dir)
    twins = entry.oracle_sql()
    bad = 0
    for name, job in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        began = time.time()
        try:
            problem = compare(spark, connection, sf_dir, name, job, twins.get(name))
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1200]}"
        bad += problem is not None
        state = "ok" if problem is None else f"BAD {problem}"
        print(f"{name} [{time.time() - began:.1f}s{'' if name in twins else ', rows only'}] {state}", flush=True)
    print("bad:", bad)
