"""Multiple-choice items to scored candidates.

Every task gives the same table: (dataset, subset, example_id, context,
candidates ARRAY<STRING>, label INT), one row per item. It is a map-only
projection of the task's own table. Items without a usable label are left out,
so they count neither as right nor as wrong.

A table whose source reports damage has a ``_damage`` column; its candidates then have a
``problem`` column, and a row for each item that cannot be read.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright.operators.preference import NOT_AN_INTEGER, label_index

# Answer keys in label order.
LETTERS = ["A", "B", "C", "D", "E"]
DIGITS = ["1", "2", "3", "4"]
BLANK = "_"

DAMAGE, PROBLEM = "_damage", "problem"


def _position(key: Column, values: list[str]) -> Column:
    """0-based position of ``key`` in ``values``; null if it is not there."""
    found = F.array_position(F.array(*map(F.lit, values)), key)
    return F.when(found > 0, (found - 1).cast("int"))


def _question_context(question: Column) -> Column:
    return F.concat(F.lit("Question: "), question, F.lit("\nAnswer:"))


def _spaced(texts: Column) -> Column:
    return F.transform(texts, lambda t: F.concat(F.lit(" "), t))


def _table(df: DataFrame, dataset: str, context: Column, candidates: Column, label: Column) -> DataFrame:
    subset = F.coalesce("subject", F.lit("")) if "subject" in df.columns else F.lit("")
    problem = [F.col(DAMAGE).alias(PROBLEM)] if DAMAGE in df.columns else []
    return df.select(
        F.lit(dataset).alias("dataset"),
        subset.alias("subset"),
        "example_id",
        context.alias("context"),
        candidates.alias("candidates"),
        label.cast("int").alias("label"),
        *problem,
    )


def _usable(table: DataFrame, condition: Column) -> DataFrame:
    """Items that meet the condition, and those with a problem."""
    return table.where(condition | F.col(PROBLEM).isNotNull() if PROBLEM in table.columns else condition)


def _labelled(df: DataFrame, dataset: str, label: Column) -> DataFrame:
    table = _table(df, dataset, _question_context(F.col("question")), _spaced(F.col("choices.text")), label)
    return _usable(table, F.col("label").isNotNull() & (F.col("label") < F.size("candidates")))


def arc(df: DataFrame) -> DataFrame:
    """Answer keys are letters or digits, mapped by the key and not by ``choices.label``."""
    key = F.col("answerKey")
    return _labelled(df, "ARC", F.coalesce(_position(key, LETTERS), _position(key, DIGITS)))


def commonsense_qa(df: DataFrame) -> DataFrame:
    """Answer keys are letters only."""
    return _labelled(df, "CommonsenseQA", _position(F.col("answerKey"), LETTERS))


def piqa(df: DataFrame) -> DataFrame:
    candidates = _spaced(F.array("sol1", "sol2"))
    return _table(df, "PIQA", _question_context(F.col("goal")), candidates, F.col("label"))


def mmlu(df: DataFrame) -> DataFrame:
    """The ``subject`` column becomes the subset."""
    context = _question_context(F.col("question"))
    return _table(df, "MMLU", context, _spaced(F.col("choices")), F.col("answer"))


def hellaswag(df: DataFrame) -> DataFrame:
    """A label that is no integer stops an evaluation; where problems are reported it is one."""
    table = _table(df, "HellaSwag", F.col("ctx"), _spaced(F.col("endings")), label_index(F.col("label")))
    if PROBLEM not in table.columns:
        return table
    return table.withColumn(PROBLEM, F.coalesce(PROBLEM, F.when(F.col("label").isNull(), F.lit(NOT_AN_INTEGER))))


def winogrande(df: DataFrame) -> DataFrame:
    """The sentence is cut at its blank: context before, option plus the text up to the next blank after."""
    parts = F.split("sentence", BLANK)
    suffix = F.coalesce(F.get(parts, 1), F.lit(""))
    candidates = F.array(F.concat("option1", suffix), F.concat("option2", suffix))
    label = _position(F.col("answer"), DIGITS[:2])
    return _usable(_table(df, "Winogrande", F.get(parts, 0), candidates, label), F.col("label").isNotNull())


TASKS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "ARC": arc,
    "PIQA": piqa,
    "MMLU": mmlu,
    "HellaSwag": hellaswag,
    "CommonsenseQA": commonsense_qa,
    "Winogrande": winogrande,
}


def all_candidates(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Candidates of every known task in one table; unknown names are skipped."""
    known = [TASKS[name](df) for name, df in tables.items() if name in TASKS]
    if not known:
        raise ValueError("no known task among the inputs")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), known)


def first_rows(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """Debug run: the first ``n`` rows in the key's order, of each subject where there are subjects.

    They are taken before any label filter.
    """
    if "subject" not in df.columns:
        return df.orderBy(key).limit(n)
    rank = F.row_number().over(W.partitionBy("subject").orderBy(key))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def one_per_row(candidates: DataFrame) -> DataFrame:
    """(…, cand, candidate): one row per candidate."""
    # The outer form keeps the optimizer from adding a filter on the array's
    # size, which would compute the array twice.
    exploded = F.posexplode_outer("candidates").alias("cand", "candidate")
    return candidates.select("dataset", "subset", "example_id", "label", "context", exploded).where(
        "cand is not null"
    )
