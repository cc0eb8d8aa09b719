"""Run registered queries next to their SQL twins and report differences.

    python -m helpweave.checks.compare [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import time

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def cell(v) -> str:
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "∅"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, float):
        return f"{v:.5f}".replace("-0.00000", "0.00000")
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(cell(x) for x in v) + "]"
    if hasattr(v, "as_integer_ratio") or hasattr(v, "normalize"):
        return f"{float(v):.5f}" if not isinstance(v, int) else str(v)
    return str(v)


def spark_session(cores: str = "8", memory: str = "8g"):
    from pyspark.sql import SparkSession

    from helpweave.session import SHUFFLE_CONF

    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("helpweave")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config(*SHUFFLE_CONF)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    import duckdb

    from helpweave.checks.load import load_all

    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--show", type=int, default=4)
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    queries, oracles = load_all()
    spark = spark_session()
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{args.sf}/{t}.parquet'")
    bad = []
    for name, fn in queries.items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        start = time.time()
        try:
            df = fn(spark, args.sf)
            cols = sorted(df.columns)
            got = sorted("|".join(cell(r[c]) for c in cols) for r in df.collect())
        except Exception as e:  # report and go on to the next query
            bad.append(name)
            print(f"FAIL {name}: {str(e)[:1500]}", flush=True)
            continue
        took = time.time() - start
        if name not in oracles:
            print(f"rows {name}: {len(got)} rows {took:.1f}s", flush=True)
            continue
        try:
            t0 = time.time()
            res = con.execute(oracles[name])
            dcols = [d[0] for d in res.description]
            rows = res.fetchall()
            dt = time.time() - t0
        except Exception as e:
            bad.append(name)
            print(f"FAIL {name} (sql): {str(e)[:1500]}", flush=True)
            continue
        if sorted(dcols) != cols:
            bad.append(name)
            print(f"FAIL {name}: columns {cols} vs {sorted(dcols)}", flush=True)
            continue
        idx = [dcols.index(c) for c in cols]
        want = sorted("|".join(cell(r[i]) for i in idx) for r in rows)
        if got == want:
            print(f"ok   {name}: {len(got)} rows {took:.1f}s (sql {dt:.1f}s)", flush=True)
        else:
            bad.append(name)
            a, b = sorted(set(got) - set(want)), sorted(set(want) - set(got))
            print(f"DIFF {name}: {len(got)} vs {len(want)} rows, only here {len(a)}, only sql {len(b)}; {cols}", flush=True)
            for x in a[: args.show]:
                print("   here:", x[:400])
            for x in b[: args.show]:
                print("   sql :", x[:400])
    print("bad:", bad)


if __name__ == "__main__":
    main()
