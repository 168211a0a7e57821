"""Compares queries with their DuckDB twins: python tests/parity.py SF_DIR [NAME...]"""

import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    try:
        f = float(v)
    except (TypeError, ValueError):
        return str(v)
    return "nan" if math.isnan(f) else float(f"{f:.9g}")


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


def differs(spark, con, sf_dir, plan, sql):
    df = plan(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    ref = con.sql(sql)
    want = rows_of(ref.columns, ref.fetchall())
    if sorted(df.columns) != sorted(ref.columns):
        return f"columns {df.columns} {ref.columns}"
    if got != want:
        a, b = set(got) - set(want), set(want) - set(got)
        return f"{len(got)} {len(want)} rows; only Spark {sorted(a)[:2]}, only DuckDB {sorted(b)[:2]}"
    return "" if got else "no rows"


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sf, names = sys.argv[1], sys.argv[2:]
    con = connect(sf)
    for name, sql in e.oracle_sql().items():
        if not names or name in names:
            t = time.time()
            try:
                why = differs(spark, con, sf, e.queries()[name], sql)
            except Exception as x:
                why = f"{type(x).__name__} {str(x)[:400]}"
            print(name, "ok" if not why else f"DIFFERS {why}", round(time.time() - t, 1), flush=True)
