"""Run a registered query on Spark and its oracle on DuckDB and compare them."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for file in Path(folder).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


def table(columns: list[str], rows) -> tuple[list[str], list[tuple[str, ...]]]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def spark_table(query, spark: SparkSession, folder: str):
    df = query(spark, folder)
    return table(df.columns, [tuple(r) for r in df.collect()])


def duck_table(sql: str, connection: duckdb.DuckDBPyConnection):
    result = connection.execute(sql)
    return table([d[0] for d in result.description], result.fetchall())
