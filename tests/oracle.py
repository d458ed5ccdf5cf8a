"""Run registered queries in Spark and their SQL in DuckDB and compare whole results.

``python -m tests.oracle [--sf DIR] [--only-fail] [name …]`` checks all queries or the named ones.
"""

from __future__ import annotations

import argparse
import math
import tempfile
import time

import duckdb

SPARK_TO_DUCK = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "date": "DATE", "boolean": "BOOLEAN",
}
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def session(cpus: str = "8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("shelfcast-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="shelfcast-tests-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _key(v):
    if v is None:
        return (0, "")
    if isinstance(v, float) and math.isnan(v):
        return (1, "nan")
    return (2, repr(v))


def differences(spark, con, name: str, fn, sql: str | None, sf_dir: str) -> list[str]:
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    rows = [tuple(r[c] for c in cols) for r in df.collect()]
    if not rows:
        return ["no rows"]
    if sql is None:
        return []
    cur = con.execute(sql)
    want_types = {d[0]: str(d[1]) for d in cur.description}
    raw = cur.fetchall()
    if sorted(want_types) != cols:
        return [f"columns: spark {cols}, oracle {sorted(want_types)}"]
    pos = [list(want_types).index(c) for c in cols]
    want = [tuple(r[i] for i in pos) for r in raw]
    out = []
    for c, t in df.dtypes:
        if SPARK_TO_DUCK.get(t, t) != want_types[c]:
            out.append(f"type of {c}: spark {t}, oracle {want_types[c]}")
    if len(rows) != len(want):
        out.append(f"rows: spark {len(rows)}, oracle {len(want)}")
    a = sorted(tuple(map(_key, r)) for r in rows)
    b = sorted(tuple(map(_key, r)) for r in want)
    if a != b:
        sa, sb = set(a), set(b)
        out.append(f"values: {len(sa - sb)} only spark, {len(sb - sa)} only oracle; columns {cols}")
        out += [f"  spark  {[v for _, v in r]}" for r in sorted(sa - sb)[:3]]
        out += [f"  oracle {[v for _, v in r]}" for r in sorted(sb - sa)[:3]]
    return out


def main() -> None:
    import __spark_entry__ as entry

    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--only-fail", action="store_true")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    queries, oracles = entry.queries(), entry.oracle_sql()
    spark, con = session(), connect(args.sf)
    bad = 0
    for name in args.names or queries:
        t = time.time()
        try:
            diff = differences(spark, con, name, queries[name], oracles.get(name), args.sf)
        except Exception as e:  # report and go on with the next query
            diff = [f"{type(e).__name__}: {str(e)[:1500]}"]
        bad += bool(diff)
        if diff or not args.only_fail:
            kind = "sql " if name in oracles else "rows"
            print(f"{'FAIL' if diff else 'ok  '} {kind} {time.time() - t:6.1f}s {name}", *diff, sep="\n     ", flush=True)
    print(f"{bad} failed of {len(args.names or queries)}")
    spark.stop()


if __name__ == "__main__":
    main()
