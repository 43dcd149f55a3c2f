"""Run a query and its SQL over the same tables and tell where they differ."""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

import duckdb

#: Whether doubles, which both sides round, must be equal to the last bit.
EXACT = bool(os.environ.get("EXACT"))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value if value is None or isinstance(value, (int, str, bool)) else str(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    rough = lambda row: repr(tuple(round(x, 4) if isinstance(x, float) else x for x in row))
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=rough)


def near(a, b) -> bool:
    return a == b or not EXACT and isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)


def difference(spark, query, oracle: str, sf_dir: str) -> str:
    """Empty if both give the same rows."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    res = connect(sf_dir).execute(oracle)
    names = [d[0] for d in res.description]
    want = rows_of(names, res.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows"
    bad = [(a, b) for a, b in zip(got, want, strict=True) if not all(map(near, a, b))]
    return f"{len(bad)} of {len(got)} rows, first {bad[0]}" if bad else ""


if __name__ == "__main__":  # python tests/compare.py DIR PREFIX...
    sys.path.insert(0, str(Path(__file__).parents[1]))
    from pyspark.sql import SparkSession

    from tidemark.plans import catalog

    spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for name, query in catalog.queries().items():
        if len(sys.argv) < 3 or name.startswith(tuple(sys.argv[2:])):
            began = time.time()
            try:
                said = difference(spark, query, catalog.oracles()[name], sys.argv[1]) if name in catalog.oracles() else f"no oracle, {query(spark, sys.argv[1]).count()} rows"
            except Exception as e:  # noqa: BLE001
                said = f"{type(e).__name__}: {str(e)[:600]}"
            print(f"{name} {time.time() - began:.1f} s {said or 'same'}", flush=True)
