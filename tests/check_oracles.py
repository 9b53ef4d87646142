"""Run registered queries and their SQL side by side: python tests/check_oracles.py [sf] [names]."""

from __future__ import annotations

import os
import sys
import time
import traceback
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')"
        )
    return connection


def canonical(frame: pd.DataFrame) -> list[tuple]:
    """Rows as sorted tuples of text, columns by name."""
    columns = sorted(frame.columns)
    return sorted(
        tuple("<null>" if pd.isna(value) else str(value) for value in row)
        for row in frame[columns].itertuples(index=False)
    )


def compare(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str | None:
    """None where both hold the same rows, else the first difference."""
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} != {sorted(sql_frame.columns)}"
    for name in spark_frame.columns:
        left, right = spark_frame[name].dtype.kind, sql_frame[name].dtype.kind
        if left != right and len(spark_frame) and len(sql_frame):
            return f"column {name}: kind {left} != {right}"
    left, right = canonical(spark_frame), canonical(sql_frame)
    if len(left) != len(right):
        return f"{len(left)} rows != {len(right)} rows"
    for a, b in zip(left, right, strict=True):
        if a != b:
            pairs = zip(sorted(spark_frame.columns), a, b, strict=True)
            differing = [(n, x[:300], y[:300]) for n, x, y in pairs if x != y]
            return f"first difference: {a[:1]} {differing}"
    return None


def main() -> int:
    from postwatch.plans.oracles import ORACLES
    from postwatch.plans.registry import QUERIES
    from postwatch.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    chosen = sys.argv[2:] or list(QUERIES)
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(
        master=os.environ.get("CHECK_MASTER", "local[8]"),
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
           "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    bad = 0
    for name in chosen:
        started = time.time()
        try:
            frame = QUERIES[name](spark, sf_dir).toPandas()
            took = time.time() - started
            if name in ORACLES:
                began = time.time()
                problem = compare(frame, connection.execute(ORACLES[name]).df())
                sql_took = time.time() - began
            else:
                problem, sql_took = None, 0.0
        except Exception as error:  # noqa: BLE001 - report and go on
            problem, took, sql_took = f"{type(error).__name__}: {str(error)[:600]}", 0.0, 0.0
            if "-v" in sys.argv:
                traceback.print_exc()
            frame = pd.DataFrame()
        bad += problem is not None
        status = "ok  " if problem is None else "FAIL"
        print(f"{status} {name:24} {len(frame):7} rows {took:6.2f}s sql {sql_took:6.2f}s"
              f" {'' if name in ORACLES else '(rows only)'} {problem or ''}", flush=True)
    print(f"{len(chosen) - bad} of {len(chosen)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(main())
