"""Generated answers: prompts, attached texts, grades."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions import batches as arrow
from tablewright.functions.text import final_number, same_number
from tablewright.operators.metrics import ratio
from tablewright.session import fresh_path

Generator = Callable[[list[str]], list[str]]

# Prompts of a call, and bytes of their text.
CALL_ROWS, CALL_BYTES = 256, 1 << 20


def reasoning_prompt(question: Column) -> Column:
    return F.concat(F.lit("Question: "), question, F.lit("\nLet's think step by step.\nAnswer:"))


def attach_predictions(items: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Left join of (key, prediction), one row per key; an item without one counts as wrong."""
    return items.join(predictions.select(key, "prediction"), key, "left")


def _generate(rows: DataFrame, prompt: str, generator: Generator, call_rows: int, call_bytes: int) -> DataFrame:
    """``rows`` with the ``prompt`` column replaced by a ``prediction``, in calls of bounded rows and bytes."""
    kept = [c for c in rows.columns if c != prompt]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept) + ", prediction string"

    def generate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow.pieces(batches, call_rows, call_bytes):
            columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            prompts = columns[prompt].to_pylist()
            texts = list(generator(prompts))
            if len(texts) != len(prompts):
                raise ValueError("the generator gave another number of texts than prompts")
            made = [columns[c] for c in kept] + [pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(made, names=[*kept, "prediction"])

    return rows.mapInArrow(generate, schema)


def attach_generator(
    items: DataFrame, key: str, generator: Generator, call_rows: int = CALL_ROWS, call_bytes: int = CALL_BYTES
) -> DataFrame:
    """(key, question, answer, prediction) from a user function of a list of prompts.

    A call has at most ``call_rows`` prompts and ``call_bytes`` of text.
    """
    rows = items.select(key, "question", "answer", reasoning_prompt(F.col("question")).alias("_prompt"))
    return _generate(rows, "_prompt", generator, call_rows, call_bytes)


STORE_SCHEMA = "digest string, prediction string"
# Version 2 of this setting moves the file of a task to its place when the task ends, not when the job does.
COMMIT_BY_TASK = "mapreduce.fileoutputcommitter.algorithm.version"


def prompt_digest(name: str, prompt: Column) -> Column:
    """What a text is kept under: the generator's name and the prompt; null without prompt."""
    return F.sha2(F.concat(F.lit(f"{len(name)}:{name}:"), prompt), 256)


def _held(spark: SparkSession, store: str) -> DataFrame:
    """The texts of a store, one per digest also where two runs have written it at once."""
    try:
        rows = spark.read.schema(STORE_SCHEMA).parquet(store)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STORE_SCHEMA)
    return rows.groupBy("digest").agg(F.min("prediction").alias("prediction"))


def attach_stored_generator(
    items: DataFrame,
    key: str,
    generator: Generator,
    name: str,
    store: str,
    commit_rows: int = 50_000,
    call_rows: int = CALL_ROWS,
    call_bytes: int = CALL_BYTES,
) -> DataFrame:
    """As :func:`attach_generator`, with every text kept in the table at ``store``, so that it is generated once.

    Prompts whose text is there under the generator's ``name`` are left out before work starts. The others are
    generated in one job, equal prompts once. A task has about ``commit_rows`` prompts divided by the number of tasks that
    run at a time, and adds its texts to the table when they are all there: a run that is broken off and repeated
    has lost about ``commit_rows`` texts at most. An item without question has no prediction.
    """
    spark = items.sparkSession
    prompt = reasoning_prompt(F.col("question"))
    keyed = items.select(key, "question", "answer", prompt_digest(name, prompt).alias("digest"))
    asked = items.select(prompt_digest(name, prompt).alias("digest"), prompt.alias("prompt")).where("digest is not null")
    todo = asked.dropDuplicates(["digest"]).join(_held(spark, store), "digest", "left_anti")
    path = fresh_path(spark, "prompts")  # the job is cut by the length of this list, whatever is added meanwhile
    todo.write.parquet(path)
    listed = spark.read.parquet(path)
    rounds = -(-listed.count() // commit_rows)
    if rounds:
        # one job, of whose tasks each adds its file when it is complete
        parts = listed.repartition(rounds * spark.sparkContext.defaultParallelism, "digest")
        made = _generate(parts, "prompt", generator, call_rows, call_bytes)
        made.write.mode("append").option(COMMIT_BY_TASK, "2").parquet(store)
    return keyed.join(_held(spark, store), "digest", "left").select(key, "question", "answer", "prediction")


def grade(answered: DataFrame, key: str) -> DataFrame:
    """The detailed table: texts, extracted numbers and whether they agree."""
    extracted = answered.select(
        key,
        "question",
        F.col("answer").alias("target"),
        "prediction",
        final_number(F.col("prediction")).alias("extracted_pred"),
        final_number(F.col("answer")).alias("extracted_target"),
    )
    return extracted.withColumn(
        "correct", same_number(F.col("extracted_pred"), F.col("extracted_target"))
    )


def answer_accuracy(detail: DataFrame, name: str) -> DataFrame:
    """One row (dataset, n_correct, n_total, accuracy), also for no items at all."""
    counts = detail.agg(F.count_if("correct").alias("n_correct"), F.count("*").alias("n_total"))
    return counts.select(
        F.lit(name).alias("dataset"),
        "n_correct",
        "n_total",
        ratio(F.col("n_correct"), F.col("n_total")).alias("accuracy"),
    )
