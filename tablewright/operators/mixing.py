"""Combining training sources."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The placeholder code row and how often it is repeated.
CODE_PROMPT = "# Write a python function to add two numbers.\ndef add(a, b):"
CODE_SOLUTION = "    return a + b"
CODE_ROWS = 5000

# Subjects used for training.
TRAINING_SUBJECTS = [
    "high_school_european_history",
    "high_school_us_history",
    "high_school_world_history",
    "high_school_government_and_politics",
    "high_school_geography",
    "high_school_psychology",
    "philosophy",
    "sociology",
    "public_relations",
    "security_studies",
    "us_foreign_policy",
    "econometrics",
    "international_law",
    "jurisprudence",
    "moral_disputes",
    "moral_scenarios",
    "prehistory",
    "professional_law",
    "professional_psychology",
]


def placeholder_code(spark: SparkSession, rows: int = CODE_ROWS) -> DataFrame:
    """``rows`` identical code rows with an id."""
    return spark.range(rows).select(
        "id", F.lit(CODE_PROMPT).alias("prompt"), F.lit(CODE_SOLUTION).alias("canonical_solution")
    )


def only_subjects(df: DataFrame, subjects: list[str] = TRAINING_SUBJECTS) -> DataFrame:
    """Rows of the listed subjects; a partition filter where ``subject`` is one."""
    return df.where(F.col("subject").isin(subjects))


def combine(tables: Mapping[str, DataFrame]) -> DataFrame:
    """All rows of all tables, duplicates kept, with their ``source``."""
    if not tables:
        raise ValueError("no input table was found")
    named = [df.select(F.lit(name).alias("source"), "*") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, named)


def source_counts(mixture: DataFrame) -> DataFrame:
    """Rows per source and, under ``total``, in all."""
    return (
        mixture.rollup("source")
        .agg(F.count("*").alias("n_rows"), F.grouping("source").alias("_all"))
        .select(F.when(F.col("_all") == 1, "total").otherwise(F.col("source")).alias("source"), "n_rows")
    )
