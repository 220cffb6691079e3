"""Run each named query and its SQL check side by side: ``python -m tests.compare [sf] [names...]``."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

from lexiscore.catalog.oracle import ORACLES
from lexiscore.catalog.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def normal(pdf: pd.DataFrame) -> pd.DataFrame:
    """Columns and rows in a fixed order, values as text."""
    pdf = pdf[sorted(pdf.columns)]
    text = pdf.apply(lambda col: col.astype(object).where(col.notna(), None).map(str))
    return text.sort_values(list(text.columns)).reset_index(drop=True)


def difference(spark, con, name: str, sf_dir: str) -> str | None:
    got_df = QUERIES[name](spark, sf_dir)
    tables = got_df.toArrow(), con.execute(ORACLES[name]).to_arrow_table()
    got, want = (table.to_pandas(integer_object_nulls=True) for table in tables)
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(set(got.columns) ^ set(want.columns))}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = normal(got), normal(want)
    if a.equals(b):
        return None if len(a) else "no rows"
    bad = (a != b).any(axis=1)
    return f"{int(bad.sum())} rows differ: {a[bad].iloc[0].to_dict()} != {b[bad].iloc[0].to_dict()}"


def main() -> None:
    from lexiscore.session import get_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:] or list(QUERIES)
    sf_dir = f"/root/testdata/sf{sf}"
    spark = get_session(
        master="local[8]",
        spark__sql__shuffle__partitions="8",
        spark__driver__memory="12g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in names:
        start = time.time()
        try:
            problem = difference(spark, con, name, sf_dir) if name in ORACLES else "no SQL"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {error}"
        failed += problem is not None
        print(f"{name:32s} {time.time() - start:6.1f}s {'ok' if problem is None else problem[:1500]}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
