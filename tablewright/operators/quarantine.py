"""Rows that cannot be evaluated, counted per dataset and reason."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators.formatting import POSITION_LABELS
from tablewright.operators.metrics import display_name
from tablewright.operators.preference import NOT_AN_INTEGER, label_index

OUT_OF_RANGE = "label is out of range"
NOTHING_TO_REJECT = "nothing to reject"
NO_LETTER = "answer has no letter"


def continuation_problem(endings: Column, label: Column) -> Column:
    """Why a (endings, label) row cannot become a pair; null if it can."""
    index = label_index(label)
    return (
        F.when(index.isNull(), NOT_AN_INTEGER)
        .when((index < 0) | (index >= F.size(endings)), OUT_OF_RANGE)
        .when(F.size(endings) < 2, NOTHING_TO_REJECT)
    )


def unreadable_label(label: Column) -> Column:
    """Why a label stops an evaluation; null if it does not."""
    return F.when(label_index(label).isNull(), NOT_AN_INTEGER)


def positional_problem(choices: Column, answer: Column) -> Column:
    """Why an integer answer has no letter; null if it has one."""
    labels = F.least(F.size(choices), F.lit(len(POSITION_LABELS)))
    return F.when(answer.isNull() | (answer >= labels) | (answer < -labels), NO_LETTER)


def failed_datasets(predictions: DataFrame) -> DataFrame:
    """(dataset, reason, n_rows) of the predictions with a ``problem``, by display name."""
    found = predictions.where("problem is not null")
    name = display_name(F.col("dataset"), F.col("subset"))
    return found.groupBy(name.alias("dataset"), F.col("problem").alias("reason")).agg(F.count("*").alias("n_rows"))


def failed_tasks(spark: SparkSession, reasons: Mapping[str, str]) -> DataFrame:
    """The same for tasks of which nothing could be read; they have no rows."""
    rows = [(task, reason, 0) for task, reason in sorted(reasons.items())]
    return spark.createDataFrame(rows, "dataset string, reason string, n_rows long")


def bad_rows(checks: list[tuple[str, DataFrame, Column]]) -> DataFrame:
    """(dataset, reason, n_rows) over (dataset, table, problem) checks."""
    found = [
        df.select(F.lit(name).alias("dataset"), problem.alias("reason")).where("reason is not null")
        for name, df, problem in checks
    ]
    return (
        reduce(DataFrame.unionByName, found)
        .groupBy("dataset", "reason")
        .agg(F.count("*").alias("n_rows"))
    )
