"""Run named queries beside their DuckDB SQL and compare columns, types and values.

``python tests/compare.py [sf_dir] [name ...]``
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, dt.datetime):
        return v.isoformat()
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def _close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return abs(a - b) <= 1e-9 * max(1.0, abs(a), abs(b))
    return a == b


def compare(df, con, sql):
    """None when equal, else a text saying what differs."""
    got_names = df.columns
    cur = con.execute(sql)
    want_names = [c[0] for c in cur.description]
    want_types = {c[0]: str(c[1]) for c in cur.description}
    want_rows = cur.fetchall()
    if sorted(got_names) != sorted(want_names):
        return f"columns {got_names} != {want_names}"
    for f in df.schema:
        if TYPES.get(f.dataType.simpleString()) != want_types[f.name]:
            return f"type of {f.name}: {f.dataType.simpleString()} != {want_types[f.name]}"
    got = _rows(got_names, [tuple(r) for r in df.collect()])
    want = _rows(want_names, want_rows)
    if len(got) != len(want):
        extra = [r for r in got if r not in set(want)][:2]
        return f"rows {len(got)} != {len(want)}; e.g. {extra}"
    bad = [(g, w) for g, w in zip(got, want) if not all(_close(x, y) for x, y in zip(g, w))]
    return f"{len(bad)} of {len(got)} rows differ; e.g. {bad[0]}" if bad else None


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from tests.conftest import make_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark, con = make_session(), duck(sf_dir)
    oracle, failed = oracle_sql(), []
    for name, fn in queries().items():
        if argv[1:] and name not in argv[1:]:
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            why = compare(df, con, oracle[name]) if name in oracle else None
            rows = "" if name in oracle else f" rows-only {df.count()}"
        except Exception as e:  # noqa: BLE001
            why, rows = f"{type(e).__name__}: {str(e)[:600]}", ""
        print(f"{'FAIL' if why else 'ok  '} {name} {time.time() - start:.1f}s{rows} {why or ''}", flush=True)
        if why:
            failed.append(name)
    print(f"{len(failed)} failed: {' '.join(failed)}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
