"""Run queries and their SQL side by side: python tests/check_oracles.py [scale folder] [query ...]"""

import glob
import math
import os
import sys
import time
import traceback

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402


def open_tables(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[:-len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _key(row):
    return tuple((v is None, str(type(v)), v if not isinstance(v, float) else (math.isnan(v), v)) for v in row)


def compare(frame, con, sql):
    """None when names, kinds of values and rows agree, else what differs."""
    names = sorted(frame.columns)
    ours = sorted([tuple(r) for r in frame.select(*names).collect()], key=_key)
    cursor = con.execute(sql)
    theirs_names = [d[0] for d in cursor.description]
    if sorted(theirs_names) != names:
        return f"columns {names} against {sorted(theirs_names)}"
    kinds = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}
    types = dict(frame.dtypes)
    odd = [(d[0], types[d[0]], str(d[1])) for d in cursor.description if kinds.get(str(d[1])) != types[d[0]]]
    if odd:
        return f"types differ: {odd}"
    at = [theirs_names.index(n) for n in names]
    theirs = sorted([tuple(r[i] for i in at) for r in cursor.fetchall()], key=_key)
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b or [type(x) for x in a] != [type(x) for x in b]]
    return f"{len(bad)} of {len(ours)} rows differ, e.g. {bad[:3]}" if bad else None


def main():
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(entry.queries())
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = open_tables(folder)
    failed = []
    for name in wanted:
        started = time.time()
        try:
            frame = entry.queries()[name](spark, folder)
            sql = entry.oracle_sql().get(name)
            problem = compare(frame, con, sql) if sql else None
            note = "ok" if sql and not problem else problem or f"{frame.count()} rows, no SQL"
        except Exception:
            problem = note = traceback.format_exc()[-900:]
        if problem:
            failed.append(name)
        print(f"{name:28s} {time.time() - started:7.2f}s  {note}", flush=True)
    print(f"{len(wanted) - len(failed)} of {len(wanted)} fine; failed: {failed}")


if __name__ == "__main__":
    main()
