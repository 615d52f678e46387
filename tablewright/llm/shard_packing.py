"""Shards of near equal bytes by best-fit-decreasing bin packing.

Rows of equal text form a group that is never divided. Groups go into the bins in
descending size, each into the tightest bin that still takes it; the bins stand
in a balanced tree by remaining capacity.

The packing itself sees a bounded list however large the table is: a group of at
least 1/256 of a shard is an item of its own (at most 256 per shard), and all
smaller groups are dealt by digest into 2**14 bundles, which are items too. A
group larger than a shard keeps a bin to itself, and the others share the rest.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import full_text, stored

ROW_BYTES = 16
OWN_ITEM = 256  # a group this part of a shard, or larger, is packed on its own
BUNDLES = 1 << 14
MOST_SHARDS = 4096  # bounds the packed list at about a million items
CELLS = 256  # parts of a shard that are numbered apart
SEARCH_STEPS = 10


@dataclass
class _Node:
    key: tuple[int, int]
    rank: int
    left: _Node | None = None
    right: _Node | None = None


class CapacityTree:
    """A treap of (remaining capacity, bin), balanced by ranks that are digests of the bin."""

    def __init__(self) -> None:
        self.root: _Node | None = None
        self.state = 0x9E3779B97F4A7C15

    def _split(self, node: _Node | None, key: tuple[int, int]) -> tuple[_Node | None, _Node | None]:
        if node is None:
            return None, None
        if node.key < key:
            node.right, more = self._split(node.right, key)
            return node, more
        less, node.left = self._split(node.left, key)
        return less, node

    def _merge(self, less: _Node | None, more: _Node | None) -> _Node | None:
        if less is None or more is None:
            return less or more
        if less.rank > more.rank:
            less.right = self._merge(less.right, more)
            return less
        more.left = self._merge(less, more.left)
        return more

    def add(self, remaining: int, bin_: int) -> None:
        self.state = (self.state * 6364136223846793005 + 1442695040888963407) % 2**64
        less, more = self._split(self.root, (remaining, bin_))
        self.root = self._merge(self._merge(less, _Node((remaining, bin_), self.state >> 32)), more)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least remaining capacity of at least ``size``."""
        less, more = self._split(self.root, (size, -1))
        if more is None:
            self.root = less
            return None
        parent, node = None, more
        while node.left is not None:
            parent, node = node, node.left
        if parent is None:
            more = node.right
        else:
            parent.left = node.right
        self.root = self._merge(less, more)
        return node.key


def best_fit_decreasing(sizes: list[int], capacity: int, most: int | None = None) -> list[int] | None:
    """The bin of each item; ``sizes`` descend. None where more than ``most`` bins would be needed.

    An item larger than the capacity gets a bin of its own.
    """
    tree, bins, opened = CapacityTree(), [], 0
    for size in sizes:
        found = tree.take_tightest(size)
        if found is None:
            if opened == most:
                return None
            found = (max(capacity, size), opened)
            opened += 1
        tree.add(found[0] - size, found[1])
        bins.append(found[1])
    return bins


def near_equal(sizes: list[int], n_bins: int) -> list[int]:
    """Best fit decreasing into ``n_bins`` bins under the least capacity that suffices.

    ``sizes`` descend. An item that fills a fair share alone keeps its bin to itself.
    A capacity of a fair share and the largest item always suffices.
    """
    total, alone = sum(sizes), 0
    while alone < min(len(sizes), n_bins - 1) and sizes[alone] * (n_bins - alone) >= total:
        total -= sizes[alone]
        alone += 1
    rest = sizes[alone:]
    if not rest:
        return list(range(alone))
    left = n_bins - alone
    low = max(-(-total // left), rest[0])
    high = -(-total // left) + rest[0]
    best = None
    for _ in range(SEARCH_STEPS):
        middle = (low + high) // 2
        if found := best_fit_decreasing(rest, middle, left):
            best, high = found, middle
        else:
            low = middle + 1
        if low >= high:
            break
    best = best or best_fit_decreasing(rest, high, left)
    return list(range(alone)) + [alone + b for b in best]


def shards(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row per row of ``docs``.

    Size is the UTF-8 length of the text and 16 bytes; a null text counts as
    empty and is in one group with empty texts. Slots number a shard's rows from 0
    without gaps, repeated rows too. With fewer groups than shards some shards
    are empty; an empty table gives an empty result.
    """
    if not 1 <= n_shards <= MOST_SHARDS:
        raise ValueError(f"n_shards must be between 1 and {MOST_SHARDS}")
    spark = docs.sparkSession
    text = full_text(docs["text"])
    rows = stored(
        docs.select(
            docs["doc_id"],
            (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("digest"),
        ),
        "shard-rows",
    )
    bundle = F.pmod(F.xxhash64("digest"), F.lit(BUNDLES)).cast("int")
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    is_large = F.col("bytes") >= max(1, total // (n_shards * OWN_ITEM))
    key = F.when(is_large, F.col("digest"))
    number = F.when(is_large, F.lit(-1)).otherwise(bundle)
    # at most n_shards * OWN_ITEM large groups and BUNDLES bundles
    items = groups.groupBy(key.alias("key"), number.alias("bundle")).agg(F.sum("bytes").alias("bytes"))
    listed = [(r["bytes"], r["bundle"], r["key"]) for r in items.toArrow().to_pylist()]
    listed.sort(key=lambda r: (-r[0], r[1], bytes(r[2] or b"")))
    bins = near_equal([r[0] for r in listed], n_shards)

    def lookup(columns: dict[str, pa.Array]) -> DataFrame:
        return F.broadcast(spark.createDataFrame(pa.table(columns)))

    own = [(k, b) for (_, _, k), b in zip(listed, bins, strict=True) if k is not None]
    dealt = [(n, b) for (_, n, k), b in zip(listed, bins, strict=True) if k is None]
    large = lookup(
        {
            "digest": pa.array([k for k, _ in own], pa.binary()),
            "own_shard": pa.array([b for _, b in own], pa.int32()),
        }
    )
    small = lookup(
        {
            "bundle": pa.array([n for n, _ in dealt], pa.int32()),
            "dealt_shard": pa.array([b for _, b in dealt], pa.int32()),
        }
    )
    placed = (
        rows.join(large, "digest", "left")
        .withColumn("bundle", bundle)
        .join(small, "bundle", "left")
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.coalesce("own_shard", "dealt_shard").alias("shard"),
            F.pmod(F.xxhash64("doc_id", "digest"), F.lit(CELLS)).cast("int").alias("cell"),
        )
    )
    # at most n_shards * CELLS rows
    counts = placed.groupBy("shard", "cell").count()
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size")
    numbered = placed.withColumn("place", F.row_number().over(within) - 1)
    return numbered.join(F.broadcast(offsets), ["shard", "cell"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("offset") + F.col("place")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
