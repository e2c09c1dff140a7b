"""Compare the catalog with its SQL: ``python tests/compare.py [sf_dir] [name ...]``."""

import datetime
import decimal
import hashlib
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return repr(v + 0.0)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return repr(v)


def digest(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(plain(r[i]) for i in order) for r in rows)
    return len(lines), hashlib.md5("\n".join(lines).encode()).hexdigest(), lines


FAMILY = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def check(spark, con, name, fn, sql, sf):
    begun = time.time()
    df = fn(spark, sf)
    mine = digest(df.columns, [tuple(r) for r in df.collect()])
    spark_s = time.time() - begun
    begun = time.time()
    rel = con.execute(sql)
    columns = [d[0] for d in rel.description]
    types = {d[0]: str(d[1]) for d in rel.description}
    theirs = digest(columns, rel.fetchall())
    sql_s = time.time() - begun
    drift = {c: (t, types.get(c)) for c, t in df.dtypes if FAMILY.get(t) != types.get(c)}
    same = sorted(df.columns) == sorted(columns) and mine[:2] == theirs[:2]
    return same, mine, theirs, drift, spark_s, sql_s


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con, sqls, bad = connect(sf), e.oracle_sql(), []
    for name, fn in e.queries().items():
        if wanted and name not in wanted:
            continue
        try:
            if name not in sqls:
                print(f"{name:24s} rows only: {fn(spark, sf).count()}", flush=True)
                continue
            same, mine, theirs, drift, a, b = check(spark, con, name, fn, sqls[name], sf)
            print(f"{name:24s} {'ok' if same else 'DIFFERS'} rows {mine[0]}/{theirs[0]} spark {a:.1f}s sql {b:.1f}s {drift or ''}", flush=True)
            if not same:
                bad.append(name)
                left, right = set(mine[2]) - set(theirs[2]), set(theirs[2]) - set(mine[2])
                print("   only spark:", len(left), [x[:300] for x in sorted(left)[:3]])
                print("   only sql:  ", len(right), [x[:300] for x in sorted(right)[:3]], flush=True)
        except Exception as err:
            bad.append(name)
            print(f"{name:24s} FAILED {type(err).__name__} {str(err)[:400]}", flush=True)
    print("bad:", bad)
