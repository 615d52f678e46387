"""Question-answering rows to two-message chats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGES = T.ArrayType(
    T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
)

# Labels of choices that carry none.
POSITION_LABELS = ["A", "B", "C", "D", "E", "F"]


def chat_pair(user: Column, assistant: Column) -> Column:
    """Two messages, user then assistant."""
    return F.array(
        F.struct(F.lit("user").alias("role"), user.alias("content")),
        F.struct(F.lit("assistant").alias("role"), assistant.alias("content")),
    )


def pick_column(df: DataFrame, *names: str) -> Column:
    """The first of ``names`` the table has, else empty text.

    The choice is on the presence of the column; a null value stays null.
    """
    return next((F.col(n) for n in names if n in df.columns), F.lit(""))


def _choice_prompt(question: Column, labels: Column, texts: Column) -> Column:
    # zip_with pads the shorter side with null; concat makes that line null and
    # array_join leaves it out, so both sides are cut to the shorter one.
    lines = F.zip_with(labels, texts, lambda label, text: F.concat(label, F.lit(". "), text, F.lit("\n")))
    return F.concat(question, F.lit("\n\n"), F.array_join(lines, ""), F.lit("\nAnswer:"))


def _labelled(df: DataFrame) -> tuple[Column, Column]:
    prompt = _choice_prompt(F.col("question"), F.col("choices.label"), F.col("choices.text"))
    return prompt, pick_column(df, "answerKey", "answer").cast("string")


def _positional(df: DataFrame) -> tuple[Column, Column]:
    labels = F.slice(F.array(*map(F.lit, POSITION_LABELS)), F.lit(1), F.size("choices"))
    prompt = _choice_prompt(F.col("question"), labels, F.col("choices"))
    answer = pick_column(df, "answerKey", "answer")
    name = next((n for n in ("answerKey", "answer") if n in df.columns), None)
    if name and isinstance(df.schema[name].dataType, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
        # A negative index counts from the end; one out of range has no letter.
        position = F.when(answer < 0, answer).otherwise(answer + 1).cast("int")
        return prompt, F.try_element_at(labels, position)
    return prompt, answer.cast("string")


def multiple_choice(df: DataFrame) -> tuple[Column, Column]:
    """(prompt, target) of a multiple-choice table, by the type of ``choices``."""
    kind = df.schema["choices"].dataType
    if isinstance(kind, T.StructType) and {"text", "label"} <= set(kind.names):
        return _labelled(df)
    if isinstance(kind, T.ArrayType):
        return _positional(df)
    raise ValueError(f"choices must be a struct of text and label or an array, not {kind.simpleString()}")


def worked_answer(df: DataFrame) -> tuple[Column, Column]:
    """(prompt, target) of a table whose answer keeps its reasoning."""
    return F.col("question"), F.col("answer")


def code_pair(df: DataFrame) -> tuple[Column, Column]:
    """(prompt, target) of a code table under either of its column namings."""
    return (
        pick_column(df, "prompt", "instruction"),
        pick_column(df, "canonical_solution", "output"),
    )


def to_pairs(df: DataFrame, formatter, *keep: str) -> DataFrame:
    """Only ``keep`` plus ``prompt`` and ``target``; source columns are dropped."""
    prompt, target = formatter(df)
    return df.select(*keep, prompt.alias("prompt"), target.alias("target"))


def to_messages(df: DataFrame, formatter, *keep: str) -> DataFrame:
    """Only ``keep`` plus the ``messages`` chat; source columns are dropped."""
    return df.select(*keep, chat_pair(*formatter(df)).alias("messages"))
