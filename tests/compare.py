"""Run registered queries beside their SQL: python -m tests.compare SF_DIR [NAME...]."""

from __future__ import annotations

import glob
import math
import os
import sys
import time


def spark_session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, int):
        return repr(v)
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{plain(x)}" for k, x in sorted(v.items())) + "}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def same(spark, con, query, sql: str, sf_dir: str) -> tuple[bool, str]:
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted("|".join(plain(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return False, f"columns {cols} and {sorted(names)}"
    order = [names.index(c) for c in cols]
    want = sorted("|".join(plain(r[i]) for i in order) for r in cur.fetchall())
    if got == want:
        return True, f"{len(got)} rows"
    odd = [(g, w) for g, w in zip(got, want, strict=False) if g != w][:2]
    return False, f"{len(got)} and {len(want)} rows; {odd}"


def main(args: list[str]) -> int:
    import __spark_entry__ as entry

    sf_dir, names = args[0], args[1:]
    spark, con, bad = spark_session(), duck(sf_dir), 0
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in names or queries:
        began = time.time()
        if name in sql:
            ok, said = same(spark, con, queries[name], sql[name], sf_dir)
        else:
            ok, said = True, f"{queries[name](spark, sf_dir).count()} rows, no SQL"
        bad += not ok
        print("ok " if ok else "BAD", name, f"{time.time() - began:.1f}s", said[:600], flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
