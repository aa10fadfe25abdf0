"""Compares a query's rows with those of DuckDB on the same Parquet tables."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb
import pandas as pd
from pyspark.sql import SparkSession


def session() -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{os.environ.get('TEST_CPUS', '8')}]").appName("tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )


def tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p if p.is_file() else f'{p}/*.parquet'}')")
    return con


def sorted_rows(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.map(lambda v: tuple(v) if hasattr(v, "tolist") and getattr(v, "ndim", 0) else None if v is pd.NA or (isinstance(v, float) and v != v) else v)
    return frame.iloc[sorted(range(len(frame)), key=lambda i: repr(tuple(frame.iloc[i])))].reset_index(drop=True) if len(frame) < 200 else frame.sort_values(list(frame.columns), key=lambda c: c.map(repr)).reset_index(drop=True)


def compare(spark: SparkSession, query, sql: str, sf_dir: str) -> int:
    ours = sorted_rows(query(spark, sf_dir).toPandas())
    theirs = sorted_rows(tables(sf_dir).execute(sql).df())
    assert list(ours.columns) == list(theirs.columns), (list(ours.columns), list(theirs.columns))
    assert len(ours) == len(theirs), (len(ours), len(theirs))
    for c in ours.columns:
        bad = [(a, b) for a, b in zip(ours[c], theirs[c], strict=True) if a != b and not (a is None and b is None)]
        assert not bad, (c, len(bad), bad[:3])
    return len(ours)
