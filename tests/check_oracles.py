"""Compare every registered query with its oracle at one scale.

    python tests/check_oracles.py [name-part ...] [--sf 0.01]
"""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return con


def plain(value):
    if value is None:
        return ("null",)
    if isinstance(value, bool):
        return ("bool", value)
    if isinstance(value, float):
        return ("float", "nan" if math.isnan(value) else repr(value))
    if isinstance(value, int):
        return ("int", value)
    if isinstance(value, str):
        return ("str", value)
    if isinstance(value, (list, tuple)):
        return ("list", tuple(plain(v) for v in value))
    return (type(value).__name__, str(value))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def compare(spark, con, folder, name, queries, oracles):
    start = time.time()
    df = queries[name](spark, folder)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if name not in oracles:
        return ("rows-only" if got else "EMPTY", len(got), took, "")
    start = time.time()
    result = con.execute(oracles[name])
    columns = [c[0] for c in result.description]
    want = result.fetchall()
    took_sql = time.time() - start
    if sorted(columns) != sorted(df.columns):
        return ("COLUMNS", len(got), took, f"{sorted(df.columns)} != {sorted(columns)}")
    a, b = rows_of(df.columns, got), rows_of(columns, want)
    if a == b:
        return ("ok" if got else "EMPTY", len(got), took, f"sql {took_sql:.1f}s" if took_sql > 3 else "")
    sa, sb = set(a), set(b)
    only_a, only_b = [r for r in a if r not in sb], [r for r in b if r not in sa]
    detail = (f"{sorted(df.columns)}\n   spark {len(a)} rows, only spark {len(only_a)}: {str(only_a[:2])[:350]}"
              f"\n   sql   {len(b)} rows, only sql {len(only_b)}: {str(only_b[:2])[:350]}")
    return ("DIFF", len(got), took, detail)


def main():
    args = sys.argv[1:]
    sf = "0.01"
    if "--sf" in args:
        i = args.index("--sf")
        sf = args[i + 1]
        args = args[:i] + args[i + 2:]
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession
    folder = f"/root/testdata/sf{sf}"
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not args or any(n.startswith(a) for a in args)]
    bad = 0
    for name in names:
        try:
            state, rows, took, detail = compare(spark, con, folder, name, queries, oracles)
        except Exception as error:
            state, rows, took, detail = "ERROR", 0, 0.0, str(error)[:400]
        bad += state not in ("ok", "rows-only")
        print(f"{state:9s} {name:40s} rows={rows:<7d} {took:6.2f}s {detail}", flush=True)
    print(f"{len(names) - bad} of {len(names)} good")


if __name__ == "__main__":
    main()
