"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablewright.session import fresh_path

# The white space that the contracts name, as regular expression sets.
BLANK = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: a cut in the lineage that survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def full_text(text: str | Column = "text") -> Column:
    """The whole text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def id_key(doc_id: Column) -> Column:
    """A doc_id to join and group by; null has a key of its own, the lowest number."""
    return F.coalesce(doc_id.cast("long"), F.lit(-(2**63)))


def rows_named_by(docs: DataFrame, kept: DataFrame, key: Column, *further: Column) -> DataFrame:
    """The rows of ``docs`` whose (key, further) is among the rows of ``kept``, columns unchanged.

    ``kept`` has as many columns, in this order. Of rows with the same key the longest
    text stays. Texts are shuffled once.
    """
    names = [unused(docs, f"key{i}") for i in range(1 + len(further))]
    place = unused(docs, "place")
    keyed = docs.withColumns(dict(zip(names, (key, *further), strict=True)))
    order = Window.partitionBy(*names).orderBy(F.char_length(full_text()).desc())
    met = keyed.join(kept.toDF(*names), names, "left_semi")
    return met.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).select(*docs.columns)


def unsigned_crc32(key: str) -> Column:
    """crc32 of a key written as text; null counts as empty."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one where ``df`` already has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name



ROWS_TOGETHER = 1000
_ROWS_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def map_batches(df: DataFrame, function: Callable, schema: str | StructType) -> DataFrame:
    """``df.mapInArrow``, after limiting the session's Arrow batches to ``ROWS_TOGETHER`` rows.

    Spark buffers a whole batch on both sides of the Python worker, which for long
    texts is most of a worker's memory. The setting changes no result.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_ROWS_SETTING)) <= ROWS_TOGETHER:
        conf.set(_ROWS_SETTING, str(ROWS_TOGETHER))
    return df.mapInArrow(function, schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows`` rows, so that a task holds few long texts as Python objects at once."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


ARROW_TYPES = {
    "long": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "float": pa.float32(),
    "boolean": pa.bool_(),
    "string": pa.string(),
    "binary": pa.binary(),
    "array<int>": pa.list_(pa.int32()),
    "array<long>": pa.list_(pa.int64()),
    "array<float>": pa.list_(pa.float32()),
}


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of ``"name type, ..."``; needs no session, so tasks can call it."""
    return pa.schema([(name, ARROW_TYPES[kind]) for name, kind in map(str.split, ddl.split(", "))])


def record_batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )
