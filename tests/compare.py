"""Compare registered queries with their SQL twins: ``python tests/compare.py [sf] [name ...]``."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float, decimal.Decimal)):
        number = float(value)
        return "nan" if math.isnan(number) else number
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(out, key=lambda r: [(v is None, str(type(v)), v) if v is not None else (True, "", 0) for v in r])


def kind(type_name):
    """The kind of a column type, so that a count is not mistaken for a measurement."""
    name = str(type_name).lower()
    for family, starts in {
        "integer": ("tinyint", "smallint", "int", "bigint", "long"), "double": ("double",),
        "text": ("varchar", "string"), "boolean": ("bool",)}.items():
        if name.startswith(starts):
            return family
    return name


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def difference(spark, con, sf_dir, query, twin):
    """None when both give the same rows, otherwise a text that says what differs."""
    df = query(spark, sf_dir)
    names, rows = canonical(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(twin)
    description = result.description
    names2, rows2 = canonical([d[0] for d in result.description], result.fetchall())
    if names != names2:
        return f"columns {names} and {names2}"
    spark_kinds = {n: kind(d) for n, d in df.dtypes}
    duck_kinds = {d[0]: kind(d[1]) for d in result.description}
    if spark_kinds != duck_kinds:
        return f"types {set(spark_kinds.items()) ^ set(duck_kinds.items())}"
    if rows != rows2:
        pairs = [(a, b) for a, b in zip(rows, rows2) if a != b][:3]
        return f"{len(rows)} and {len(rows2)} rows; first differences {str(pairs)[:1500]}"
    return None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    chosen = sys.argv[2:] or list(entry.queries())
    twins, bad = entry.oracle_sql(), 0
    for name in chosen:
        start = time.time()
        try:
            problem = difference(spark, con, sf_dir, entry.queries()[name], twins[name])
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{len(chosen)} queries, {bad} bad")
