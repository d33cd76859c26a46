"""Runs registered queries against their SQL check: `python tests/parity.py [name ...]`."""

from __future__ import annotations

import math
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return "\0null"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return f"{float(v):.9g}" if abs(v) < 1e9 else str(v)
    if hasattr(v, "is_integer") or type(v).__name__ == "Decimal":
        return f"{float(v):.9g}"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows), sorted(columns)


def compare(spark, con, name, fn, sql, sf_dir):
    start = time.time()
    df = fn(spark, sf_dir)
    got = df.collect()
    seconds = time.time() - start
    mine, my_columns = rows_of(df.columns, [tuple(r) for r in got])
    if sql is None:
        return None, f"{name}: rows {len(mine)}, no SQL check, {seconds:.1f}s"
    start = time.time()
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    theirs, their_columns = rows_of(columns, cur.fetchall())
    duck_seconds = time.time() - start
    if my_columns != their_columns:
        return False, f"{name}: columns {my_columns} != {their_columns}"
    if mine != theirs:
        a, b = set(mine), set(theirs)
        return False, (f"{name}: rows {len(mine)} vs {len(theirs)}, only spark {len(a - b)} e.g. {sorted(a - b)[:2]}"
                       f", only sql {len(b - a)} e.g. {sorted(b - a)[:2]}")[:1500]
    return True, f"{name}: ok {len(mine)} rows {seconds:.1f}s (sql {duck_seconds:.1f}s)"


def main(names):
    from memograph.catalog import ORACLES, QUERIES
    from memograph.session import build_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="parity-")})
    con = duck(sf_dir)
    bad = 0
    wanted = [n for n in QUERIES if not names or any(n == x or (x.endswith("*") and n.startswith(x[:-1])) for x in names)]
    for name in wanted:
        try:
            ok, line = compare(spark, con, name, QUERIES[name], ORACLES.get(name), sf_dir)
        except Exception as error:  # a check tool reports and goes on
            ok, line = False, f"{name}: {type(error).__name__} {str(error)[:900]}"
        bad += not ok
        print(("PASS " if ok else "UNCHECKED " if ok is None else "FAIL ") + line, flush=True)
    print(f"{len(wanted) - bad} of {len(wanted)} pass")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
