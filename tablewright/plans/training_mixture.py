"""The training mixture: sample and format each source, combine, shuffle, write."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators import budget, chat, formatting, mixing, ranking
from tablewright.sources.sinks import write_once

# Held-out share of the worked answers, cap on subject questions.
HELD_OUT = 0.7
SUBJECT_CAP = 5000

NO_PROMPT = "prompt is missing"
NO_TARGET = "target is missing"


def source_tables(spark: SparkSession, inputs: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """(id, prompt, target) of each source that was found.

    ``inputs`` may hold ``commonsense``, ``science``, ``math`` and ``subjects``,
    each with an ``id`` column. Sampling comes before formatting. The placeholder
    code is always there.
    """
    plans = {
        "commonsense": lambda df: formatting.to_pairs(df, formatting.multiple_choice, "id"),
        "science": lambda df: formatting.to_pairs(df, formatting.multiple_choice, "id"),
        "math": lambda df: formatting.to_pairs(
            ranking.sample_fraction(df, ["id"], HELD_OUT), formatting.worked_answer, "id"
        ),
        "subjects": lambda df: formatting.to_pairs(
            ranking.sample_cap(mixing.only_subjects(df), ["id"], SUBJECT_CAP),
            formatting.multiple_choice,
            "id",
        ),
    }
    found = {name: plan(inputs[name]) for name, plan in plans.items() if name in inputs}
    code = formatting.to_pairs(mixing.placeholder_code(spark), formatting.code_pair, "id")
    tables = {**found, "code": code}
    # Inputs may number their rows or name them.
    return {name: df.withColumn("id", F.col("id").cast("string")) for name, df in tables.items()}


def mixture(spark: SparkSession, inputs: Mapping[str, DataFrame]) -> DataFrame:
    """(source, id, prompt, target) of the whole mixture, unordered."""
    return mixing.combine(source_tables(spark, inputs))


def pair_problem() -> Column:
    """Why a (prompt, target) row cannot be trained on; null if it can."""
    return F.when(F.col("prompt").isNull(), NO_PROMPT).when(F.col("target").isNull(), NO_TARGET)


def incomplete_pairs(pairs: DataFrame) -> DataFrame:
    """(dataset, reason, n_rows) of the rows of a mixture that cannot be trained on."""
    bad = pairs.select(F.col("source").alias("dataset"), pair_problem().alias("reason")).where("reason is not null")
    return bad.groupBy("dataset", "reason").agg(F.count("*").alias("n_rows"))


def training_rows(chats: DataFrame, limit: int = budget.MAX_TOKENS, **plan) -> DataFrame:
    """(epoch, position, step, micro_batch, text, n_tokens, n_cut) of a mixture's chats.

    Chats are rendered, cut to the limit and put into batches. Chats with the same
    text are alike, so the digest of the text is their key.
    """
    rendered = chats.select(chat.render_messages(F.col("messages")).alias("whole")).where("whole is not null")
    rows = budget.limit_length(rendered, "whole", limit).withColumn("chat", F.md5("whole")).drop("whole")
    rows = rows.select("chat", F.struct(F.col("kept").alias("text"), "n_tokens", "n_cut").alias("row"))
    placed = budget.batch_plan(rows, ["chat", "row"], order=["chat"], **plan)
    return placed.select("epoch", "position", "step", "micro_batch", "row.*")


def write_mixture(pairs: DataFrame, path: str) -> None:
    """The mixture's complete rows as chats in seeded order, unless it is already written."""
    ordered = ranking.shuffled(pairs.where(pair_problem().isNull()), ["source", "id"])
    chats = ordered.select(formatting.chat_pair(F.col("prompt"), F.col("target")).alias("messages"))
    write_once(chats, path)
