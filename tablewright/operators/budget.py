"""Length limits and batch plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.hashing import SEED
from tablewright.functions.text import count_words, first_words, last_words, words
from tablewright.operators.ranking import with_position

# Limits in tokens, and rows per device step and accumulation.
MAX_TOKENS = 2048
MAX_PROMPT_TOKENS = 1024
BATCH_ROWS = 4
ACCUMULATION = 8
EPOCHS = 2

Tokens = Callable[[Column], Column]
Cut = Callable[[Column, Column], Column]


def _count(tokens: Tokens, text: Column) -> Column:
    return count_words(text) if tokens is words else F.size(tokens(text))


def limit_length(
    df: DataFrame, text: str = "text", limit: int = MAX_TOKENS, tokens: Tokens = words, first: Cut = first_words
) -> DataFrame:
    """Add token counts and the ``kept`` text: the whole text, or up to the end of its token ``limit``.

    ``first(text, n)`` gives the text of the first n tokens as it stands there.
    """
    n = F.col("n_tokens")
    return (
        df.withColumn("n_tokens", _count(tokens, F.col(text)))
        .withColumn("n_cut", F.greatest(n - limit, F.lit(0)))
        .withColumn("kept", F.when(n > limit, first(F.col(text), F.lit(limit))).otherwise(F.col(text)))
    )


def limit_pair(
    pairs: DataFrame,
    key: str,
    prompt_limit: int = MAX_PROMPT_TOKENS,
    limit: int = MAX_TOKENS,
    tokens: Tokens = words,
) -> DataFrame:
    """Token counts of preference pairs under the prompt and total limits.

    A long prompt keeps its end, next to the answer; the answers share what is
    left of the total and keep their start.
    """
    return _pair_sizes(pairs, prompt_limit, limit, tokens).drop("prompt", "chosen", "rejected").select(
        key, *(f"{what}_{c}" for what in ("n", "kept") for c in ("prompt", "chosen", "rejected"))
    )


def _pair_sizes(pairs: DataFrame, prompt_limit: int, limit: int, tokens: Tokens) -> DataFrame:
    sizes = pairs.withColumns({f"n_{c}": _count(tokens, F.col(c)) for c in ("prompt", "chosen", "rejected")})
    room = F.lit(limit) - F.col("kept_prompt")
    return sizes.withColumn("kept_prompt", F.least(F.col("n_prompt"), F.lit(prompt_limit))).withColumns(
        {
            "kept_chosen": F.least(F.col("n_chosen"), room),
            "kept_rejected": F.least(F.col("n_rejected"), room),
        }
    )


def cut_pair(
    pairs: DataFrame,
    prompt_limit: int = MAX_PROMPT_TOKENS,
    limit: int = MAX_TOKENS,
    tokens: Tokens = words,
    first: Cut = first_words,
    last: Cut = last_words,
) -> DataFrame:
    """The pairs with their texts cut as :func:`limit_pair` counts; texts under the limits are unchanged."""
    sizes = _pair_sizes(pairs, prompt_limit, limit, tokens)

    def cut(column: str, by: Cut) -> Column:
        n, kept = F.col(f"n_{column}"), F.col(f"kept_{column}")
        return F.when(n > kept, by(F.col(column), kept)).otherwise(F.col(column))

    ways = {"prompt": last, "chosen": first, "rejected": first}
    return sizes.select(*(cut(c, ways[c]).alias(c) if c in ways else c for c in pairs.columns))


def length_report(
    df: DataFrame, by: str, text: str = "text", limit: int = MAX_TOKENS, tokens: Tokens = words
) -> DataFrame:
    """Rows, tokens and how many of each the limit cuts, per group."""
    n = _count(tokens, F.col(text)).cast("bigint")
    return (
        df.select(by, n.alias("_n"))
        .groupBy(by)
        .agg(
            F.count("*").alias("n_rows"),
            F.sum("_n").alias("n_tokens"),
            F.sum((F.col("_n") > limit).cast("bigint")).alias("rows_cut"),
            F.sum(F.greatest(F.col("_n") - limit, F.lit(0))).alias("tokens_cut"),
        )
    )


def batch_plan(
    df: DataFrame,
    keys: list[str],
    epochs: int = EPOCHS,
    batch_rows: int = BATCH_ROWS,
    accumulation: int = ACCUMULATION,
    seed: int | str = SEED,
    order: list[str] | None = None,
) -> DataFrame:
    """(epoch, step, micro_batch) of every row, reshuffled each epoch.

    The last step of an epoch keeps what is left over. ``order`` names the columns
    of ``keys`` that decide the order; all do by default.
    """
    per_step = batch_rows * accumulation
    rows = df.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    placed = with_position(rows, order or keys, within=["epoch"], seed=seed)
    position = F.col("position")
    return placed.select(
        *keys,
        "epoch",
        "position",
        F.floor(position / per_step).cast("bigint").alias("step"),
        F.floor((position % per_step) / batch_rows).cast("bigint").alias("micro_batch"),
    )
