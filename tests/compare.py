"""Run registered queries on Spark and their SQL on DuckDB; compare whole results.

    python tests/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def spark_result(spark, fn, sf_dir):
    df = fn(spark, sf_dir)
    return sorted_rows(df.columns, [tuple(r) for r in df.collect()]), df


def duck_result(con, sql):
    cur = con.execute(sql)
    return sorted_rows([d[0] for d in cur.description], cur.fetchall())


TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


def type_difference(df, con, sql: str) -> str | None:
    """Spark column types against the SQL's, by name."""
    mine = {c: TYPES.get(t, t) for c, t in df.dtypes}
    theirs = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    odd = {c: (t, theirs.get(c)) for c, t in mine.items() if theirs.get(c) != t}
    return f"types {odd}" if odd else None


def difference(spark_side, duck_side) -> str | None:
    if spark_side[0] != duck_side[0]:
        return f"columns {spark_side[0]} vs {duck_side[0]}"
    if spark_side[1] != duck_side[1]:
        a, b = spark_side[1], duck_side[1]
        first = next((p for p in zip(a, b) if p[0] != p[1]), None)
        return f"{len(a)} vs {len(b)} rows, first difference {str(first)[:700]}"
    return None


def main(argv: list[str]) -> int:
    from pyspark.sql import SparkSession
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    import __spark_entry__ as entry
    con = duck(sf_dir)
    queries, oracle, bad = entry.queries(), entry.oracle_sql(), 0
    for name in argv[1:] or queries:
        start = time.time()
        try:
            mine, df = spark_result(spark, queries[name], sf_dir)
            took = time.time() - start
            if name in oracle:
                problem = (difference(mine, duck_result(con, oracle[name]))
                           or type_difference(df, con, oracle[name]))
            else:
                problem = None
            state = "DIFF " + problem if problem else f"ok {len(mine[1])} rows" + ("" if name in oracle else " (no SQL)")
        except Exception as e:
            took, state = time.time() - start, "FAIL " + str(e)[:1500]
        bad += not state.startswith("ok")
        print(f"{name:28s} {took:6.2f}s {state}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]) and 1)
