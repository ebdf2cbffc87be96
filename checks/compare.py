"""Run registered queries against their SQL twins and report differences.

    python -m checks.compare [sf_dir] [name-part ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

from civitally.session import local_session

from .queries import REGISTRY

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return value + 0.0
    if isinstance(value, (datetime.date, datetime.datetime)):
        return str(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(canonical(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=lambda r: tuple(str(v) for v in r))


def compare(spark, con, name: str, sf_dir: str) -> tuple[bool, str]:
    query = REGISTRY[name]
    t = time.time()
    df = query.run(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - t
    if query.sql is None:
        return True, f"rows only: {len(got)} rows, {took:.1f}s"
    cur = con.execute(query.sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return False, f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return False, f"rows {len(got)} != {len(want)}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        a, b = bad[0]
        cells = [(c, x, y) for c, x, y in zip(got_cols, a, b) if x != y]
        return False, f"{len(bad)}/{len(got)} rows differ, first: {cells[:4]}"
    return True, f"{len(got)} rows, {took:.1f}s"


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark, con = local_session(8), duck(sf_dir)
    failed = 0
    for name in REGISTRY:
        if parts and not any(p in name for p in parts):
            continue
        try:
            ok, note = compare(spark, con, name, sf_dir)
        except Exception as error:  # noqa: BLE001 - report and go on
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name}: {note}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main())
