"""Exact seeded samples, caps and global positions without a one-task sort.

The digests from ``order_key`` are uniform, so a histogram over their first hex
digits splits the rows into even buckets. It has at most 16**digits rows
whatever the size of the data; that bound is what makes it safe to accumulate
in one task. Positions come from ranges of rows that are written in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright.functions.hashing import SEED, order_key
from tablewright.session import fresh_path

BUCKET_DIGITS = 4


def _bucket(digits: int) -> Column:
    return F.substring("_h", 1, digits)


def _offsets(keyed: DataFrame, within: list[str], digits: int) -> DataFrame:
    """Rows per bucket with the number of rows before it, at most 16**digits per ``within`` group."""
    histogram = keyed.groupBy(*within, _bucket(digits).alias("_b")).agg(F.count("*").alias("_n"))
    # Without ``within`` this is one task over the bounded histogram, not the data.
    before = W.partitionBy(*within).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*within)
    return histogram.select(
        *within,
        "_b",
        "_n",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias("_total"),
    )


def held_in_size(total: Column, held_out: float) -> Column:
    """Rows left after holding out ``held_out`` of them, the held-out side rounded up."""
    return (total - F.ceil(F.lit(float(held_out)) * total)).cast("bigint")


def _first_in_order(df: DataFrame, keys: list[str], wanted: Column, seed: int | str, digits: int) -> DataFrame:
    """The first ``wanted`` rows in seeded order, ``wanted`` being an expression of ``_total``.

    Two passes over the key columns find the last row to keep, by digest and then
    key; the sample itself is then a map-only filter, with no shuffle of the rows.
    Rows with the same keys are kept or left out together.
    """
    order = [f"_k{i}" for i in range(len(keys))]
    keyed = df.select(order_key(*keys, seed=seed).alias("_h"), *(F.col(k).alias(o) for k, o in zip(keys, order)))
    offsets = _offsets(keyed, [], digits).withColumn("_take", wanted - F.col("_before"))
    edge = offsets.where("_take between 1 and _n")
    # ``edge`` is one row, and one bucket's digests pass the join.
    last = (
        keyed.withColumn("_b", _bucket(digits))
        .join(F.broadcast(edge.select("_b", "_take")), "_b")
        .withColumn("_rank", F.row_number().over(W.partitionBy("_b").orderBy("_h", *order)))
        .where("_rank = _take")
        .select(F.struct("_h", *order).alias("_last"))
    )
    # structs are compared field by field, nulls first, as the window orders them
    place = F.struct(order_key(*keys, seed=seed).alias("_h"), *(F.col(k).alias(o) for k, o in zip(keys, order)))
    return df.where(place <= last.scalar())


def sample_fraction(
    df: DataFrame,
    keys: list[str],
    held_out: float = 0.7,
    seed: int | str = SEED,
    digits: int = BUCKET_DIGITS,
) -> DataFrame:
    """Exactly ``n - ceil(held_out * n)`` rows: the first ones in seeded order."""
    return _first_in_order(df, keys, held_in_size(F.col("_total"), held_out), seed, digits)


def sample_cap(
    df: DataFrame, keys: list[str], cap: int = 5000, seed: int | str = SEED, digits: int = BUCKET_DIGITS
) -> DataFrame:
    """At most ``cap`` rows, the first ones in seeded order; smaller inputs are kept whole."""
    return _first_in_order(df, keys, F.least(F.col("_total"), F.lit(cap)), seed, digits)


# Rows of offsets, at most one per partition and group, that are sent to every task.
SENT_OFFSETS = 200_000


def with_position(
    df: DataFrame,
    keys: list[str],
    within: list[str] | None = None,
    seed: int | str = SEED,
    name: str = "position",
) -> DataFrame:
    """Add the 0-based position in the seeded order, per ``within`` group if given.

    The rows are put in order once, in ranges of even size, and written to the shared
    folder; the row counts of the ranges before it are then added to a row's place in
    its own range. Rows with the same keys are alike: they are in the order of their
    number in the input, so that many of them fill several ranges and not one task.
    """
    within = within or []
    digest, number, part, place = (_unused(df, n) for n in ("_h", "_row", "_part", "_place"))
    numbered = df.withColumns({digest: order_key(*within, *keys, seed=seed), number: F.monotonically_increasing_id()})
    order = [*within, digest, *keys, number]
    ranged = numbered.repartitionByRange(*order).sortWithinPartitions(*order)
    # the low 33 bits of an id are the row's place in its partition
    placed = ranged.select(
        *df.columns,
        F.spark_partition_id().alias(part),
        F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias(place),
    )
    path = fresh_path(df.sparkSession, "positions")
    placed.write.parquet(path)
    rows = df.sparkSession.read.schema(placed.schema).parquet(path)
    return _shifted(rows, within, part, place, name).select(*df.columns, name)


def _shifted(rows: DataFrame, within: list[str], part: str, place: str, name: str) -> DataFrame:
    """Places within ranges as positions within groups."""
    counts = rows.groupBy(*within, part).agg(F.count("*").alias("_n"), F.min(place).alias("_first"))
    # Without ``within`` this is one task over a row per range, not the data.
    before = W.partitionBy(*within).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")
    marks = [_unused(rows, f"_w{i}") for i in range(len(within))]
    offsets = counts.select(*(F.col(w).alias(m) for w, m in zip(within, marks)), F.col(part).alias("_of"), shift.alias("_shift"))
    few = not within or offsets.limit(SENT_OFFSETS + 1).count() <= SENT_OFFSETS
    same = F.col(part) == F.col("_of")
    for w, m in zip(within, marks):
        same = same & F.col(w).eqNullSafe(F.col(m))
    return rows.join(F.broadcast(offsets) if few else offsets, same).withColumn(name, F.col(place) + F.col("_shift"))


def _unused(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name


def shuffled(df: DataFrame, keys: list[str], seed: int | str = SEED) -> DataFrame:
    """All rows in seeded order, range partitioned, for writing."""
    return df.withColumn("_h", order_key(*keys, seed=seed)).orderBy("_h", *keys).drop("_h")
