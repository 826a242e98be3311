"""Compares the queries with their SQL; also a script: compare.py SF [NAME...]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def differs(spark, query, sql: str, sf_dir: str) -> str:
    """Empty if the query and the SQL give the same rows."""
    got = query(spark, sf_dir).toPandas()
    con = duckdb.connect()
    for t in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {t.stem} AS SELECT * FROM '{t}{'/*.parquet' if t.is_dir() else ''}'")
    want = con.sql(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {list(got.columns)} {list(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} {len(want)}"
    cols = sorted(got.columns)
    a, b = (sorted(map(str, x[cols].itertuples(index=False, name=None))) for x in (got, want))
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(bad)} of {len(a)} rows, first {bad[0]}" if bad else ""


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    s = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    oracle = e.oracle_sql()
    for name, query in e.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:] or not sys.argv[2:] and (name.startswith("op") or name == "pipeline"):
            continue
        began = time.time()
        try:
            r = differs(s, query, oracle[name], sys.argv[1]) if name in oracle else f"rows only: {query(s, sys.argv[1]).count()}"
        except Exception as x:  # noqa: BLE001
            r = f"{type(x).__name__} {str(x)[:400]}"
        print(f"{name}: {r or 'ok'} ({time.time() - began:.1f} s)", flush=True)
