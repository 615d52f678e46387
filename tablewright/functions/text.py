"""Text expressions: numbers in generated answers, words, percentages."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Answer marker, number pattern, tolerance.
ANSWER_MARKER = "####"
NUMBER = r"-?\p{Nd}+\.?\p{Nd}*"  # decimal digits of any script
TOLERANCE = 1e-6


def final_number(text: Column) -> Column:
    """Last number after the last answer marker, commas removed; null if none."""
    tail = F.element_at(F.split(text, ANSWER_MARKER), -1)
    found = F.regexp_extract_all(F.replace(tail, F.lit(","), F.lit("")), F.lit(NUMBER), F.lit(0))
    return F.try_element_at(found, F.lit(-1))


@cache
def _digit_tables() -> tuple[str, str]:
    digits = [c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"]
    return "".join(digits), "".join(str(unicodedata.digit(c)) for c in digits)


def to_double(number: Column) -> Column:
    """Cast a matched number, reading the decimal digits of any script."""
    source, target = _digit_tables()
    plain = F.when(number.rlike(r"[^\x00-\x7F]"), F.translate(number, source, target)).otherwise(number)
    return plain.try_cast("double")


def same_number(predicted: Column, expected: Column) -> Column:
    """True only when both are present and agree; never null.

    Numbers are compared with a tolerance, and as trimmed text where one of
    them does not cast.
    """
    left, right = to_double(predicted), to_double(expected)
    numeric = F.abs(left - right) < F.lit(TOLERANCE)
    textual = F.trim(predicted) == F.trim(expected)
    equal = F.when(left.isNotNull() & right.isNotNull(), numeric).otherwise(textual)
    return F.coalesce(predicted.isNotNull() & expected.isNotNull() & equal, F.lit(False))


def words(text: Column) -> Column:
    """Runs of non-blank characters, the default token unit."""
    return F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))


def count_words(text: Column) -> Column:
    """How many :func:`words` there are, without an array of them."""
    return F.regexp_count(text, F.lit(r"\S+"))


def last_word(text: Column) -> Column:
    """The last of :func:`words`; null where there is none. Found from the end, so that one word is looked at."""
    found = F.regexp_substr(F.reverse(text), F.lit(r"\S+"))
    return F.reverse(found)


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, as it stands; empty for 0 words."""
    pattern = F.concat(F.lit(r"^\s*+(?:\S++\s*+){"), n.cast("string"), F.lit("}+"))
    return F.regexp_replace(F.regexp_substr(text, pattern), r"\s+$", "")


def last_words(text: Column, n: Column) -> Column:
    """The text from the start of its n-th word from the end, as it stands; empty for 0 words."""
    pattern = F.concat(F.lit(r"^\s*+(?:\S++\s++){"), (F.size(words(text)) - n).cast("string"), F.lit("}+"))
    return F.regexp_replace(text, pattern, F.lit(""))


@F.pandas_udf(StringType())
def percent_text(ratio: pd.Series) -> pd.Series:
    """``40.13%`` with correctly rounded digits.

    ``format_string`` rounds decimal ties up, so the few summary rows are
    formatted in Python.
    """
    return ratio.map(lambda r: None if pd.isna(r) else f"{r:.2%}")


def percent_value(text: Column) -> Column:
    """Inverse of :func:`percent_text`, as a ratio; null for other text."""
    return F.rtrim(F.trim(text), F.lit("%")).try_cast("double") / F.lit(100.0)
