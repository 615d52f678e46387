"""Chosen/rejected pairs and the metrics of scored pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.hashing import draw
from tablewright.operators.chat import ASSISTANT_OPEN, END, START

# Instruction sentence and default strength.
INSTRUCTION = "Complete the description with the most plausible ending:\n\n"
BETA = 0.1

NOT_AN_INTEGER = "label is not an integer"


def label_index(label: Column) -> Column:
    """A label as a 0-based index; null where it is not an integer."""
    return F.trim(label.cast("string")).try_cast("int")


def usable_pair(endings: Column, label: Column) -> Column:
    """True where an ending can be chosen and another one rejected."""
    index = label_index(label)
    return F.coalesce((index >= 0) & (index < F.size(endings)) & (F.size(endings) > 1), F.lit(False))


def preference_pairs(df: DataFrame, key: str, seed: str = "rejected") -> DataFrame:
    """One (prompt, chosen, rejected) per row of (ctx, endings, label); no shuffle.

    The rejected ending is drawn evenly from the others. Rows without a usable
    label belong to the quarantine report and are left out here.
    """
    label = label_index(F.col("label")).cast("bigint")
    others = F.greatest(F.size("endings") - 1, F.lit(1)).cast("bigint")
    rows = df.where(usable_pair(F.col("endings"), F.col("label"))).select(
        key, "ctx", "endings", label.alias("_label"), draw(seed, key, others).alias("_draw")
    )
    skip = F.when(F.col("_draw") >= F.col("_label"), F.col("_draw") + 1).otherwise(F.col("_draw"))
    return rows.select(
        key,
        F.concat(F.lit(INSTRUCTION), "ctx").alias("prompt"),
        F.get("endings", F.col("_label")).alias("chosen"),
        F.get("endings", skip).alias("rejected"),
    )


def in_chat_markers(pairs: DataFrame) -> DataFrame:
    """The same pairs with the turn markers the trained model sees."""
    return pairs.withColumns(
        {
            "prompt": F.concat(F.lit(f"{START}user\n"), "prompt", F.lit(f"{END}\n{ASSISTANT_OPEN}")),
            "chosen": F.concat("chosen", F.lit(END)),
            "rejected": F.concat("rejected", F.lit(END)),
        }
    )


def pair_margin(beta: float = BETA) -> Column:
    """Implicit reward difference from the four log-probabilities of a pair."""
    chosen = F.col("policy_chosen") - F.col("reference_chosen")
    rejected = F.col("policy_rejected") - F.col("reference_rejected")
    return F.lit(float(beta)) * (chosen - rejected)


def preference_metrics(scored: DataFrame, by: list[str], beta: float = BETA) -> DataFrame:
    """Mean margin, loss and accuracy of scored pairs per group."""
    margin = F.col("_margin")
    # -log(sigmoid(m)) without overflow for large |m|
    loss = F.greatest(-margin, F.lit(0.0)) + F.log1p(F.exp(-F.abs(margin)))
    return (
        scored.select(*by, pair_margin(beta).alias("_margin"))
        .groupBy(*by)
        .agg(
            F.count("*").alias("n_pairs"),
            F.avg("_margin").alias("margin"),
            F.avg(loss).alias("loss"),
            F.avg((margin > 0).cast("double")).alias("accuracy"),
        )
    )
