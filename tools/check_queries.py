"""Run registered queries and their SQL side by side: check_queries.py SF_DIR [name-prefix ...]"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

import duckdb  # noqa: E402

from tidewatch import catalog  # noqa: E402
from tidewatch.session import build_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v, digits=None):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if digits is not None:
            v = float(f"{v:.{digits}g}")
        return repr(v) if v != int(v) else str(int(v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x, digits) for x in v) + "]"
    return str(v)


def rows(cols, data, digits=None):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i], digits) for i in order) for r in data)


def compare(spark, con, sf_dir, name, entry):
    t = time.time()
    df = entry.run(spark, sf_dir)
    data = [tuple(r) for r in df.collect()]
    spent = time.time() - t
    if entry.oracle is None:
        return f"ok (no sql) rows={len(data)}", spent, True
    cur = con.execute(entry.oracle)
    cols = [c[0] for c in cur.description]
    ref = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return f"COLUMNS spark={sorted(df.columns)} sql={sorted(cols)}", spent, False
    a, b = rows(df.columns, data), rows(cols, ref)
    if a == b:
        return f"ok rows={len(a)}", spent, bool(a) or True
    near = rows(df.columns, data, 9) == rows(cols, ref, 9)
    only_a = [x for x in a if x not in set(b)][:2]
    only_b = [x for x in b if x not in set(a)][:2]
    return f"{'NEAR' if near else 'DIFF'} rows spark={len(a)} sql={len(b)}\n   spark {only_a}\n   sql   {only_b}", spent, False


def main():
    sf_dir, prefixes = sys.argv[1], sys.argv[2:]
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions=8, spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    bad = 0
    total = 0
    for name, entry in catalog.load().items():
        if prefixes and not any(name.startswith(p) or p in entry.run.__module__ or p == entry_module(entry) for p in prefixes):
            continue
        total += 1
        try:
            message, spent, good = compare(spark, con, sf_dir, name, entry)
        except Exception as e:  # noqa: BLE001
            message, spent, good = f"ERROR {type(e).__name__}: {str(e)[:600]}", 0.0, False
        bad += not good
        if not good or os.environ.get("VERBOSE") or " rows=0" in message or spent > 8:
            print(f"{name:40s} {spent:6.2f}s {message}", flush=True)
    print(f"checked {total}, bad {bad}")


def entry_module(entry):
    return entry.run.__closure__[0].cell_contents.__module__.rsplit(".", 1)[-1] if entry.run.__closure__ else ""


if __name__ == "__main__":
    main()
