"""Leaderboards over the summaries of several models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Evaluated models, the first being the one compared with.
MODELS = ["baseline", "SFT_Full", "SFT_LoRA", "RL_Full", "RL_LoRA"]
SUBJECT_PREFIX = "MMLU - "


def with_subject_mean(summary: DataFrame) -> DataFrame:
    """Add per model the unweighted mean over subjects as dataset ``MMLU``."""
    mean = (
        summary.where(F.col("dataset").startswith(SUBJECT_PREFIX))
        .groupBy("model", "metric")
        .agg(F.avg("value").alias("value"))
        .withColumn("dataset", F.lit(SUBJECT_PREFIX.split(" ")[0]))
    )
    return summary.select("model", "dataset", "metric", "value").unionByName(mean)


def repeated_figures(summary: DataFrame) -> DataFrame:
    """(model, dataset, metric, n, least, greatest) of the figures that are there more than once."""
    counted = summary.groupBy("model", "dataset", "metric").agg(
        F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("greatest")
    )
    return counted.where("n > 1")


def models_of(summary: DataFrame) -> list[str]:
    """``MODELS`` and all further models with figures; one name per model comes to the driver."""
    found = {r["model"] for r in summary.select("model").distinct().collect()}
    return MODELS + sorted(found - {*MODELS, None})


def leaderboard(summary: DataFrame, models: list[str] | None = None) -> DataFrame:
    """One row per dataset and metric: each model's value and its difference from the first model's.

    Without ``models``, ``MODELS`` and all others of the summary are taken. A figure that is there
    with several values has none here; :func:`repeated_figures` lists it.
    """
    base, *others = models or models_of(summary)
    agreed = F.when(F.min("value") == F.max("value"), F.min("value"))
    table = with_subject_mean(summary).groupBy("dataset", "metric").pivot("model", [base, *others]).agg(agreed)
    return table.withColumns({f"{m}_vs_{base}": F.col(m) - F.col(base) for m in others})
