"""Run a query in Spark and its oracle in DuckDB and compare the results."""

from __future__ import annotations

import math
import sys
import time
import traceback

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def kind(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "bool"
    return type(v).__name__


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return norm(list(v.values()))
    return f"{kind(v)}:{v}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(norm(r[k]) for k in order) for r in rows), [columns[k] for k in order]


def near(a: str, b: str) -> bool:
    """Equal, or doubles that rounding put on either side of a boundary."""
    if a == b:
        return True
    try:
        return math.isclose(float(a), float(b), rel_tol=1e-9)
    except ValueError:
        return False


def compare(spark, con, name, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got, gcols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return f"rows-only {len(got)}" if got else "EMPTY"
    rel = con.execute(sql)
    want, wcols = rows_of([c[0] for c in rel.description], rel.fetchall())
    if gcols != wcols:
        return f"COLUMNS {gcols} vs {wcols}"
    if not want:
        return "EMPTY"
    if got == want or len(got) == len(want) and all(all(map(near, a, b)) for a, b in zip(got, want)):
        return f"ok {len(got)}"
    diff = [(a, b) for a, b in zip(got, want) if a != b][:3]
    only_g = list(set(got) - set(want))[:2]
    only_w = list(set(want) - set(got))[:2]
    return f"DIFF rows {len(got)} vs {len(want)} cols {gcols}\n   spark {only_g}\n   duck  {only_w}\n   {diff[:1]}"


def main(module_names, sf="0.001", only=()):
    import importlib
    from cellgrid.plans.catalog import ORACLES, QUERIES
    from cellgrid.session import build_session
    for m in module_names:
        importlib.import_module(f"cellgrid.plans.{m}")
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("OFF")
    import logging
    logging.disable(logging.CRITICAL)
    sf_dir = f"/root/testdata/sf{sf}"
    con = duck(sf_dir)
    bad = 0
    for name, q in QUERIES.items():
        if only and name not in only:
            continue
        t = time.time()
        try:
            msg = compare(spark, con, name, q, ORACLES.get(name), sf_dir)
        except Exception as e:  # report and go on
            text = str(e) or traceback.format_exc()
            msg = "ERROR " + text[:400]
        spent = time.time() - t
        ok = msg.startswith(("ok", "rows-only"))
        bad += not ok
        print(f"{'' if ok else '!! '}{name}: {msg} ({spent:.1f}s)", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    args = sys.argv[1:]
    sf = args[0]
    mods = args[1].split(",")
    main(mods, sf, args[2].split(",") if len(args) > 2 else ())
