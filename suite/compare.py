"""Run queries against their SQL on DuckDB and report the differences.

Usage: ``python -m suite.compare [sf_dir] [name ...]``
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

from marketweek.session import configured


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _canonical(rows: list[tuple], columns: list[str]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(row[i] for i in order) for row in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def differences(spark_rows, spark_columns, duck_rows, duck_columns) -> str | None:
    if sorted(spark_columns) != sorted(duck_columns):
        return f"columns {sorted(spark_columns)} vs {sorted(duck_columns)}"
    if len(spark_rows) != len(duck_rows):
        return f"{len(spark_rows)} rows vs {len(duck_rows)}"
    a, b = _canonical(spark_rows, spark_columns), _canonical(duck_rows, duck_columns)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else None


def compare(spark: SparkSession, con, sf: str, name: str, query, oracle: str) -> str | None:
    df = query(spark, sf)
    duck = con.execute(oracle)
    duck_columns = [d[0] for d in duck.description]
    types = {d[0]: str(d[1]) for d in duck.description}
    mine = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
            "date": "DATE", "boolean": "BOOLEAN"}
    wrong = [(c, t, types.get(c)) for c, t in df.dtypes if mine.get(t, t) != types.get(c)]
    rows = [tuple(r) for r in df.collect()]
    found = differences(rows, df.columns, duck.fetchall(), duck_columns)
    return found or (f"types {wrong}" if wrong else None)


def main() -> int:
    from suite import catalog

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    builder = configured(SparkSession.builder.master("local[8]").appName("compare"))
    builder = builder.config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
    spark = builder.config("spark.sql.shuffle.partitions", "8").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    failed = 0
    for name in sys.argv[2:] or catalog.QUERIES:
        start = time.time()
        try:
            if name in catalog.ORACLES:
                result = compare(spark, con, sf, name, catalog.QUERIES[name], catalog.ORACLES[name])
                verdict = result or "same"
            else:
                result = None
                verdict = f"rows only: {len(catalog.QUERIES[name](spark, sf).collect())}"
        except Exception as error:  # report and go on with the next query
            result = verdict = f"{type(error).__name__}: {str(error)[:600]}"
        failed += result is not None
        print(f"{name:28s} {time.time() - start:6.2f}s {verdict}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
