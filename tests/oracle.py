"""Compare registered queries with their SQL: ``python tests/oracle.py [--sf DIR] [NAME...]``."""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata"


def connection(d):
    import duckdb

    c = duckdb.connect()
    for f in sorted(os.listdir(d)):
        p = f"{d}/{f}"
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def one(v):
        if v is None:
            return "\0null"
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
        if isinstance(v, (list, tuple)):
            return str([one(x) for x in v])
        return str(v)

    return sorted(tuple(one(r[i]) for i in order) for r in rows)


def compare(spark, c, name, query, sql, d):
    t = time.time()
    df = query(spark, d)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - t
    if sql is None:
        return f"{name}: {len(got)} rows, no SQL, {took:.1f} s"
    rel = c.execute(sql)
    names = [x[0] for x in rel.description]
    want = rel.fetchall()
    assert sorted(names) == sorted(df.columns), (name, names, df.columns)
    a, b = canonical(got, df.columns), canonical(want, names)
    if a != b:
        have, need = set(a), set(b)
        extra, missing = [x for x in a if x not in need][:3], [x for x in b if x not in have][:3]
        raise AssertionError(f"{name}: {len(a)} rows, SQL {len(b)}; only here {extra}; only SQL {missing}")
    return f"{name}: {len(got)} rows equal, {took:.1f} s"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    args = sys.argv[1:]
    d = f"{DATA}/sf0.01"
    if args[:1] == ["--sf"]:
        d, args = f"{DATA}/{args[1]}", args[2:]
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    c, sql, q = connection(d), e.oracle_sql(), e.queries()
    bad = 0
    for n in args or q:
        for name in [x for x in q if x == n or (n.endswith("*") and x.startswith(n[:-1]))]:
            try:
                print(compare(spark, c, name, q[name], sql.get(name), d), flush=True)
            except Exception as x:  # noqa: BLE001
                bad += 1
                print(f"FAIL {name}: {type(x).__name__} {str(x)[:1500]}", flush=True)
    sys.exit(bad > 0)
