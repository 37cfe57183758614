"""Run a registered query next to its SQL twin and compare the rows."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


# Values must then be equal to the last bit, not just to the rounding.
STRICT = bool(os.environ.get("COMPARE_STRICT"))


def connect(root: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{root}/{name}.parquet'")
    return con


def _plain(value):
    if hasattr(value, "asDict"):
        return {k: _plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value


def _key(row):
    return tuple(
        (v is None, round(v, 5) if isinstance(v, float) else str(v)) for v in row
    )


def _same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        if STRICT:
            return repr(a) == repr(b)
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6) or (math.isnan(a) and math.isnan(b))
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(_same(x, y) for x, y in zip(a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_same(a[k], b[k]) for k in a)
    return type(a) is type(b) and a == b


def check(spark, con, root, build, sql):
    df = build(spark, root)
    cols = sorted(df.columns)
    left = sorted(([_plain(r[c]) for c in cols] for r in df.collect()), key=_key)
    if sql is None:
        return True, f"rows only: {len(left)}", len(left)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return False, f"columns differ: spark {cols} sql {sorted(names)}", len(left)
    order = [names.index(c) for c in cols]
    right = sorted(([_plain(r[i]) for i in order] for r in cur.fetchall()), key=_key)
    if len(left) != len(right):
        return False, f"row counts differ: spark {len(left)} sql {len(right)}", len(left)
    for a, b in zip(left, right):
        for c, x, y in zip(cols, a, b):
            if not _same(x, y):
                return False, f"{c}: spark {x!r} sql {y!r} in {a} / {b}"[:900], len(left)
    return True, f"{len(left)} rows", len(left)


def main(argv):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from voxloom.session import local_session

    root = f"/root/testdata/{argv[0]}"
    spark = local_session(8)
    con = connect(root)
    queries, sqls = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not argv[1:] or any(a in n for a in argv[1:])]
    bad = 0
    for name in names:
        started = time.time()
        try:
            ok, message, _ = check(spark, con, root, queries[name], sqls.get(name))
        except Exception as exc:  # report and go on with the next query
            ok, message = False, f"{type(exc).__name__}: {str(exc)[:1200]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:26s} {time.time() - started:6.2f}s {message}", flush=True)
    print(f"{len(names) - bad}/{len(names)} agree")


if __name__ == "__main__":
    main(sys.argv[1:])
