"""Run registered queries and their SQL side by side: python -m checks.compare [sf_dir] [names]."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from checks.oracle import oracle_sql
from checks.queries import queries
from findrift.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def _key(row):
    return tuple((v is not None, str(v)) for v in row)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(r[i] for i in order) for r in rows]
    return sorted(out, key=_key)


def same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b))
    return a == b


def compare(spark, con, sf: str, name: str) -> tuple[bool, str]:
    t0 = time.time()
    df = queries()[name](spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    cur = con.execute(oracle_sql()[name])
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    t2 = time.time()
    note = f"spark {len(got)} rows {t1 - t0:.1f}s, sql {len(want)} rows {t2 - t1:.1f}s"
    if sorted(df.columns) != sorted(d[0] for d in cur.description):
        return False, note + f" columns differ {df.columns}"
    if len(got) != len(want):
        extra = set(got) - set(want)
        lack = set(want) - set(got)
        return False, note + f" only spark {list(extra)[:3]} only sql {list(lack)[:3]}"
    bad = [(g, w) for g, w in zip(got, want) if not all(same(x, y) for x, y in zip(g, w))]
    if bad:
        extra = set(got) - set(want)
        lack = set(want) - set(got)
        return False, note + f" {len(bad)} rows differ: spark {sorted(extra, key=_key)[:3]} sql {sorted(lack, key=_key)[:3]}"
    return True, note


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(queries())
    spark = build_session("local[8]", spark_sql_shuffle_partitions="8", spark_driver_memory="12g",
                          spark_ui_showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = []
    for name in names:
        try:
            ok, note = compare(spark, con, sf, name)
        except Exception as e:  # report and go on with the other queries
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        print("ok  " if ok else "FAIL", name, note, flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(names) - len(bad)}/{len(names)} equal", bad)


if __name__ == "__main__":
    main()
