"""Run registered queries next to their SQL and compare: ``check.py SF_DIR [name ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def session(cpus: int = 8):
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def database(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canon(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)]
    rows = []
    for row in df.itertuples(index=False):
        out = []
        for v in row:
            if v is None or (isinstance(v, float) and v != v) or v is pd.NaT or v is pd.NA:
                out.append("∅")
            elif isinstance(v, float) and v == int(v):
                out.append(str(int(v)))
            elif hasattr(v, "isoformat"):
                out.append(pd.Timestamp(v).isoformat())
            elif isinstance(v, float):
                out.append(f"{v:.9g}")
            else:
                out.append(str(v))
        rows.append("\x1f".join(out))
    return sorted(rows)


def compare(spark, con, name: str, sf_dir: str, inspect=None) -> tuple[bool, str]:
    from registry import ORACLES, QUERIES

    t0 = time.time()
    df = QUERIES[name](spark, sf_dir)
    if inspect:
        inspect(df)
    got = df.toPandas()
    t1 = time.time()
    if name not in ORACLES:
        return True, f"{name}: {len(got)} rows, no SQL ({t1 - t0:.1f}s)"
    want = con.execute(ORACLES[name]).fetchdf()
    t2 = time.time()
    if sorted(got.columns) != sorted(want.columns):
        return False, f"{name}: columns {sorted(got.columns)} != {sorted(want.columns)}"
    a, b = canon(got), canon(want)
    if a == b:
        return True, f"{name}: {len(a)} rows ok (spark {t1 - t0:.1f}s, sql {t2 - t1:.1f}s)"
    only_a = [x for x in a if x not in set(b)][:3]
    only_b = [x for x in b if x not in set(a)][:3]
    cols = sorted(got.columns)
    return False, f"{name}: {len(a)} vs {len(b)} rows\n  cols {cols}\n  spark {only_a}\n  sql   {only_b}"


def main() -> int:
    import registry

    registry.load()
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, con = session(), database(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in names or registry.QUERIES:
        try:
            ok, message = compare(spark, con, name, sf_dir)
        except Exception as e:  # noqa: BLE001
            ok, message = False, f"{name}: {type(e).__name__} {str(e)[:1500]}"
        bad += not ok
        print(("   " if ok else "BAD ") + message, flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main())
