"""Writing training data and results, and reading results back."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.text import percent_text, percent_value
from tablewright.sources.manifests import Files, current_files, folder_name, replace_models

# Columns of a metric summary; a choice summary has only the
# dataset and its accuracy.
SUMMARY_SCHEMA = "Dataset string, Metric string, Value string"
ACCURACY = "Accuracy"


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines with every field present, null or not."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` has ended well: its success mark is there."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/"), "_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def write_once(df: DataFrame, path: str) -> None:
    """JSON lines, unless the output is already there; what a broken write has left is replaced."""
    if not is_complete(df.sparkSession, path):
        write_jsonl(df, path, mode="overwrite")


def write_detail(detail: DataFrame, path: str, models: list[str] | None = None) -> None:
    """Detailed results as JSON lines, one folder per model; other models' folders stay.

    The models in ``detail``, and those named in ``models``, have its rows and no others afterwards.
    """
    replace_models(detail, path, lambda w, to: w.option("ignoreNullFields", "false").json(to), models)


def read_detail(spark: SparkSession, path: str, schema: str, models: list[str] | None = None) -> DataFrame:
    """The detailed results that count, of all models or some; ``schema`` holds ``model`` where it is wanted."""
    folders = [n for n in Files(spark, path).names(path) if n.startswith("model=")]
    if models is not None:
        folders = sorted(set(folders) & {folder_name(spark, m) for m in models})
    found = [f for folder in folders for f in _files_in(spark, f"{path.rstrip('/')}/{folder}")]
    current = current_files(spark, found)
    none = spark.createDataFrame([], schema)
    # Spark puts the folder's column last
    return spark.read.schema(schema).option("basePath", path).json(current).select(*none.columns) if current else none


def _files_in(spark: SparkSession, folder: str) -> list[str]:
    return [f"{folder}/{n}" for n in Files(spark, folder).names(folder) if not n.startswith(("_", "."))]


def choice_summary(accuracies: DataFrame) -> DataFrame:
    """(model, Dataset, Accuracy) with the accuracy as ``40.13%``."""
    return accuracies.select(
        "model", F.col("dataset").alias("Dataset"), percent_text("accuracy").alias("Accuracy")
    )


def metric_summary(accuracies: DataFrame, metric: str = ACCURACY) -> DataFrame:
    """(model, Dataset, Metric, Value) with the value as ``40.13%``."""
    return accuracies.select(
        "model",
        F.col("dataset").alias("Dataset"),
        F.lit(metric).alias("Metric"),
        percent_text("accuracy").alias("Value"),
    )


def write_summary(summary: DataFrame, path: str, models: list[str] | None = None) -> None:
    """CSV with a header, one folder per model; other models' folders stay. A summary has a few rows per model.

    The models in ``summary``, and those named in ``models``, have its rows and no others afterwards.
    """
    replace_models(summary, path, lambda w, to: w.option("header", True).csv(to), models)


def read_summaries(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(model, dataset, metric, value) of summaries of both kinds, values as ratios.

    The model is the folder a file lies in, written as ``name`` or ``model=name``.
    A line of two columns is a dataset and its accuracy. Where a folder has a manifest, only the files it names
    are read.
    """
    reader = spark.read.schema(SUMMARY_SCHEMA).option("header", True)
    listed = reader.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).csv(root)
    # a few files per model
    current = current_files(spark, [unquote(f) for f in listed.inputFiles()])
    if not current:
        return spark.createDataFrame([], "model string, dataset string, metric string, value double")
    table = reader.csv(current)
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    model = F.url_decode(F.regexp_replace(F.regexp_replace(folder, "^model=", ""), r"\+", "%2B"))
    two_columns = F.col("Value").isNull()
    return table.select(
        model.alias("model"),
        F.col("Dataset").alias("dataset"),
        F.when(two_columns, F.lit(ACCURACY)).otherwise(F.col("Metric")).alias("metric"),
        percent_value(F.when(two_columns, F.col("Metric")).otherwise(F.col("Value"))).alias("value"),
    )
