"""Compare every registered query with its SQL: python tests/check_queries.py [sf_dir] [name ...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import numpy as np
import pandas as pd

SF_DIR = "/root/testdata/sf0.001"
"""Scale of the test tables."""

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_bool_dtype(df[c]) or df[c].map(lambda v: isinstance(v, (bool, np.bool_))).all():
            df[c] = df[c].astype(bool)
        elif pd.api.types.is_numeric_dtype(df[c]):
            df[c] = df[c].astype(float)
        else:
            df[c] = df[c].map(lambda v: None if v is None or v is pd.NaT or v != v else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None when equal, else what differs."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = normal(got), normal(want)
    for c in a.columns:
        if a[c].dtype == float and b[c].dtype == float:
            same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        else:
            same = (a[c].astype(object) == b[c].astype(object)) | (a[c].isna() & b[c].isna())
        if not same.all():
            i = int(np.argmin(same.to_numpy()))
            return f"{c}: {int((~same).sum())} rows differ, first {a.loc[i].to_dict()} != {b.loc[i].to_dict()}"
    return None


def main() -> int:
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    from pairflow.session import configured

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = (
        configured(SparkSession.builder).master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    oracle = entry.oracle_sql()
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            got = query(spark, sf_dir).toPandas()
            took = time.time() - start
            # Queries that SQL cannot express are tested against plain versions instead.
            problem = difference(got, con.execute(oracle[name]).df()) if name in oracle else None
        except Exception as error:
            took, problem = time.time() - start, f"{type(error).__name__}: {str(error)[:1500]}"
            got = []
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} rows={len(got)} {took:.2f}s {problem or ''}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
