"""A look at tables: their columns and their first row."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.sources.readers import read_columnar


def table_profile(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """(table_name, ordinal, column_name, example), one row per column.

    The first key is found on the key columns alone; its row is then looked up
    with filters that reach the scan. Of rows with equal keys the least of all columns is taken.
    A null key is met only where there is no other. The columns of an empty table have no example.
    """
    first = df
    for key in keys:
        first = first.where(F.col(key).eqNullSafe(first.agg(F.min(key)).scalar()))
    first = first.orderBy(*(c for c in df.columns if _has_order(df, c))).limit(1)
    entries: list[Column] = [
        F.struct(F.lit(i).alias("ordinal"), _as_text(df, c).alias("example"))
        for i, c in enumerate(df.columns, start=1)
    ]
    named = [F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column_name")) for i, c in enumerate(df.columns, start=1)]
    columns = df.sparkSession.range(1).select(F.inline(F.array(*named)))
    return columns.join(first.select(F.inline(F.array(*entries))), "ordinal", "left").select(
        F.lit(name).alias("table_name"), "ordinal", "column_name", "example"
    )


def _has_order(df: DataFrame, column: str) -> bool:
    return "map<" not in df.schema[column].dataType.simpleString()


def _as_text(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType.simpleString()
    value = F.col(column)
    return F.to_json(value) if kind.startswith(("array", "struct", "map")) else value.cast("string")


def profile_tables(tables: Mapping[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Profiles of several (table, keys) inputs in one table."""
    return reduce(
        DataFrame.unionByName, [table_profile(df, name, *keys) for name, (df, keys) in tables.items()]
    )


def profile_folders(
    spark: SparkSession, paths: Mapping[str, str], format: str = "parquet"
) -> tuple[DataFrame | None, dict[str, str]]:
    """Profiles of the datasets that can be read, and the reason for each that cannot, by name.

    Without a key the least row of all columns is shown. The first result is None
    where nothing can be read.
    """
    readable: dict[str, tuple[DataFrame, list[str]]] = {}
    skipped: dict[str, str] = {}
    for name, path in paths.items():
        try:
            df = read_columnar(spark, path, format=format)
            df.limit(1).collect()  # a damaged file shows when it is read
            readable[name] = (df, [])
        except (PySparkException, Py4JJavaError, FileNotFoundError) as error:
            skipped[name] = str(error).splitlines()[0]
    return (profile_tables(readable) if readable else None), skipped
