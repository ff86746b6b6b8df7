"""Run registered queries beside their SQL twins and compare the whole results.

    python tests/compare.py [--sf 0.01] [name-prefix ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int,)):
        return v
    if isinstance(v, decimal.Decimal):
        return plain(float(v))
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        if v == int(v) and abs(v) < 1e15:
            return int(v)
        return float(f"{v:.9g}")
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v)


def table(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=repr)


def run_pair(spark, con, name, fn, sql, folder):
    t0 = time.time()
    df = fn(spark, folder)
    rows = df.collect()
    t1 = time.time()
    got = table(df.columns, [tuple(r) for r in rows])
    kinds = {c: str(df.schema[c].dataType.simpleString()) for c in df.columns}
    if sql is None:
        return "rows", len(rows), t1 - t0, None, kinds
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    types = [str(d[1]) for d in cur.description]
    want = table(cols, cur.fetchall())
    t2 = time.time()
    note = None
    dk = dict(zip(cols, types))
    if got[0] != want[0]:
        note = f"columns {got[0]} != {want[0]}"
    elif len(got[1]) != len(want[1]):
        note = f"rows {len(got[1])} != {len(want[1])}: {got[1][:3]} vs {want[1][:3]}"
    elif got[1] != want[1]:
        bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
        note = f"{len(bad)} rows differ: {got[0]} {bad[:2]}"
    for c, k in kinds.items():
        d = dk.get(c, "")
        if ("HUGEINT" in d) or ("DECIMAL" in d) or ("decimal" in k) or (
            (k in ("double", "float")) != (d in ("DOUBLE", "FLOAT"))
        ):
            note = (note or "") + f" type {c}: {k} vs {d}"
    return ("ok" if note is None else "BAD"), len(rows), t1 - t0, note, round(t2 - t1, 2)


def main(argv):
    from colprov.session import get_session
    import __spark_entry__ as entry

    sf = "0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        argv = argv[:i] + argv[i + 2:]
    folder = f"/root/testdata/sf{sf}"
    spark = get_session("compare", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    oracles = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if argv and not any(name.startswith(a) for a in argv):
            continue
        try:
            status, n, sec, note, extra = run_pair(spark, con, name, fn, oracles.get(name), folder)
        except Exception as e:  # report and go on
            status, n, sec, note, extra = "ERR", 0, 0.0, f"{type(e).__name__}: {str(e)[:1500]}", ""
        bad += status in ("BAD", "ERR")
        print(f"{status:5}{name:45}{n:8} rows {sec:7.2f}s  {note or ''}", flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main(sys.argv[1:])
