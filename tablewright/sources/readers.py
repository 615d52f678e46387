"""Reading datasets."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# Schema of the written mixture and pairs.
MIXTURE_SCHEMA = "messages array<struct<role string, content string>>"
PAIR_SCHEMA = "prompt string, chosen string, rejected string"


def read_columnar(
    spark: SparkSession, *paths: str, format: str = "parquet", position: bool = False, **options: str | None
) -> DataFrame:
    """Columnar files under the file schema; ``format="arrow_files"`` reads Arrow files.

    With ``position`` Arrow rows have their file, batch and row in the batch. ``options`` are those of the Arrow
    source: ``index``, ``folder`` with ``root``, ``damaged``. Its files and batches are skipped by filters
    where the session has ``spark.sql.python.filterPushdown.enabled``, as those of this package have.
    """
    if format == "parquet":
        return spark.read.parquet(*paths)
    if format == "arrow_files":
        from tablewright.sources.arrow_files import PUSHDOWN, ArrowFiles

        spark.dataSource.register(ArrowFiles)
        reader = spark.read.format("arrow_files").option("paths", json.dumps(paths))
        chosen = {"position": "true" if position else None, "pushdown": spark.conf.get(PUSHDOWN, "false"), **options}
        return reader.options(**{k: v for k, v in chosen.items() if v is not None}).load()
    raise ValueError(f"unknown format {format}")


def damaged_parquet(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, reason) of the parquet files whose footer cannot be read; they are opened in tasks."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from tablewright.sources.arrow_files import locate

    def opened(batches):
        for batch in batches:
            found = {"path": [], "reason": []}
            for path in batch.column(0).to_pylist():
                try:
                    system, inner = locate(path)
                    with system.open_input_file(inner) as source:
                        pq.ParquetFile(source)
                except (pa.ArrowException, OSError, ValueError) as error:
                    found["path"].append(path)
                    found["reason"].append(f"{type(error).__name__}: {error}".splitlines()[0])
            yield pa.RecordBatch.from_pydict(found, schema=pa.schema([("path", pa.string()), ("reason", pa.string())]))

    listed = spark.createDataFrame([(p,) for p in paths], "path string")
    return listed.mapInArrow(opened, "path string, reason string")


def read_split(spark: SparkSession, root: str, split: str, extension: str = ".parquet") -> DataFrame:
    """All files below ``root`` whose name ends in ``split`` and the extension."""
    return (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", f"*{split}{extension}")
        .parquet(root)
    )


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """JSON lines under a declared schema; a missing path is an error."""
    return spark.read.schema(schema).json(path)


def read_available(spark: SparkSession, paths: Mapping[str, str]) -> tuple[dict[str, DataFrame], list[str]]:
    """Parquet inputs that exist, by name, and the names of those that do not.

    It is an error only if none is left.
    """
    found: dict[str, DataFrame] = {}
    missing: list[str] = []
    for name, path in paths.items():
        try:
            found[name] = spark.read.parquet(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            missing.append(name)
    if not found:
        raise FileNotFoundError(f"no input found among {sorted(paths.values())}")
    return found, missing
