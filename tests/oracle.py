"""Side-by-side check of registered queries against DuckDB.

``python -m tests.oracle [--sf DIR] [key or prefix* ...]`` prints one line per query.
"""

from __future__ import annotations

import fnmatch
import math
import sys
import time

import duckdb

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return int(v) if v == int(v) and abs(v) < 1e15 else v
    if isinstance(v, (list, tuple)):
        return [_norm(x) for x in v]
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if hasattr(v, "quantize"):
        return _norm(float(v))
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def _close(a, b) -> bool:
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)
    return a == b


def compare(spark, sf_dir, fn, sql, con=None):
    """Returns (verdict, detail, rows)."""
    df = fn(spark, sf_dir)
    cols, got = rows_of(df.columns, df.collect())
    if sql is None:
        return ("rows" if got else "EMPTY"), "", len(got)
    con = con or connect(sf_dir)
    cur = con.execute(sql)
    ocols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if cols != ocols:
        return "SCHEMA", f"{cols} vs {ocols}", len(got)
    if len(got) != len(want):
        return "COUNT", f"{len(got)} vs {len(want)} e.g. {got[:2]} vs {want[:2]}", len(got)
    if got == want:
        return "ok", "", len(got)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    near = all(all(_close(x, y) for x, y in zip(g, w)) for g, w in bad)
    detail = [
        [(c, x, y) for c, x, y in zip(cols, g, w) if x != y][:4] for g, w in bad[:2]
    ]
    return ("NEAR" if near else "VALUES"), f"{len(bad)} rows, {detail}", len(got)


def main() -> None:
    import __spark_entry__ as e
    from larkspan.session import local_session

    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        sf, args = args[1], args[2:]
    spark = local_session(8)
    con = connect(sf)
    queries, oracle = e.queries(), e.oracle_sql()
    keys = [k for k in queries if not args or any(fnmatch.fnmatch(k, a) for a in args)]
    bad = 0
    for k in keys:
        t = time.time()
        try:
            verdict, detail, n = compare(spark, sf, queries[k], oracle.get(k), con)
        except Exception as ex:  # noqa: BLE001 - report and go on
            verdict, detail, n = "ERROR", str(ex)[:600].replace("\n", " "), 0
        bad += verdict not in ("ok", "rows")
        print(f"{verdict:7s} {k:28s} {n:7d} rows {time.time() - t:6.2f}s {detail}", flush=True)
    print(f"{len(keys)} queries, {bad} not right")


if __name__ == "__main__":
    main()
