"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint's 64 bits are dealt into parts, correlated bits together, and every
part gets a threshold of its own. If the thresholds sum to the distance less the
number of parts plus one, two fingerprints within the distance agree up to the
threshold in at least one part. Number of parts and thresholds are chosen by
dynamic programming over the estimated number of probes and candidates. One side
then probes with its part value and all values within the part's threshold, the
other stands under its own value, and the join verifies the distance.

Equal fingerprints are one node. The nodes of a dense group are first linked to
the smallest node of their bucket; the full search then passes over pairs that
are connected already, so a group does not give all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import full_text, id_key, map_batches, rows_named_by, slices, stored
from tablewright.llm.components import connected_components

WORDS = 4
DISTANCE = 4
BITS = 64
SEED = 42
CHUNK = 1 << 16
SAMPLE = 3000
MOST_PARTS = 5
MOST_FLIPS = 2
# Cost of a candidate pair, in rows probed.
CANDIDATE_COST = 0.05

FINGERPRINTS = "doc_id long, print long"
FINGERPRINTS_OF_ROWS = "doc_id long, chars int, digest string, print long"


def fingerprint(text: str | None) -> int:
    """The signed 64-bit fingerprint of a whole text; 0 where it has no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(WORDS, len(words))
    starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    ones = np.zeros(BITS, np.int64)
    for low in range(0, len(starts), CHUNK):
        places = zip(starts[low : low + CHUNK].tolist(), ends[low : low + CHUNK].tolist(), strict=True)
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in places], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column is the text and becomes its fingerprint; the others stay."""
    for batch in slices(batches):
        *others, texts = batch.columns
        prints = pa.array(map(fingerprint, texts.to_pylist()), pa.int64())
        yield pa.RecordBatch.from_arrays([*others, prints], names=[*batch.schema.names[:-1], "print"])


@dataclass
class Plan:
    """Masks of the parts, and the threshold of each; -1 for a part that is not probed."""

    masks: list[int]
    thresholds: list[int]
    cost: float = 0.0

    def flips(self) -> list[tuple[int, int, int]]:
        """(part, its mask, bits to flip) of every probe of a fingerprint."""
        made = []
        for part, (mask, most) in enumerate(zip(self.masks, self.thresholds, strict=True)):
            bits = [1 << b for b in range(BITS) if mask >> b & 1]
            for n in range(most + 1):
                made += [(part, mask, sum(chosen)) for chosen in combinations(bits, n)]
        return made


def correlated_parts(prints: np.ndarray, n_parts: int) -> list[list[int]]:
    """Bits in ``n_parts`` groups of near equal width, each grown by the bit most correlated with it."""
    bits = (prints[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)
    centred = bits.astype(float) - bits.mean(0)
    scale = np.sqrt((centred**2).sum(0)) + 1e-9
    related = np.abs(centred.T @ centred / np.outer(scale, scale))
    np.fill_diagonal(related, 0.0)
    free, parts = list(range(BITS)), []
    for number in range(n_parts):
        width = len(free) // (n_parts - number)
        part = [max(free, key=lambda b: related[b, free].sum())]
        free.remove(part[0])
        while len(part) < width:
            nearest = max(free, key=lambda b: related[b, part].sum())
            part.append(nearest)
            free.remove(nearest)
        parts.append(sorted(part))
    return parts


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Least summed cost of thresholds from -1 that sum to ``total``; ``costs[i][t + 1]`` is part i at t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:  # after each part, the cheapest way to every sum of thresholds
        reached: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t, extra in enumerate(row, -1):
                entry = (cost + extra, [*chosen, t])
                if used + t not in reached or entry < reached[used + t]:
                    reached[used + t] = entry
        best = reached
    return best[total]


def choose_plan(prints: np.ndarray, n_prints: int, distance: int = DISTANCE) -> Plan:
    """The cheapest plan for ``n_prints`` fingerprints that look like the sample ``prints``.

    Any plan finds every pair within the distance; the estimates decide the cost alone.
    """
    if len(prints) < 2:
        prints = np.zeros(2, np.uint64)
    pairs = prints[:, None] ^ prints[None, :]
    n_pairs = max(1, len(prints) * (len(prints) - 1))
    plans = []
    for n_parts in range(1, MOST_PARTS + 1):
        masks = [sum(1 << b for b in part) for part in correlated_parts(prints, n_parts)]
        costs = []
        for mask in masks:
            width = mask.bit_count()
            apart = np.bincount(np.bitwise_count(pairs & np.uint64(mask)).ravel(), minlength=BITS + 1)
            apart[0] -= len(prints)
            row = [0.0]
            for t in range(min(distance, width, MOST_FLIPS) + 1):
                # sampled pairs, but at least what even bits would give
                even = sum(comb(width, k) for k in range(t + 1)) / 2.0**width
                share = max(apart[: t + 1].sum() / n_pairs, even)
                probes = n_prints * sum(comb(width, k) for k in range(t + 1))
                row.append(probes + CANDIDATE_COST * share * n_prints**2)
            costs.append(row)
        total = distance - n_parts + 1
        if total <= sum(len(row) - 2 for row in costs):
            cost, thresholds = allocate(costs, total)
            plans.append(Plan(masks, thresholds, cost + n_prints * n_parts))
    return min(plans, key=lambda p: p.cost)


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def _differing(a: Column, b: Column, mask: int | None = None) -> Column:
    x = a.bitwiseXOR(b)
    return F.bit_count(x if mask is None else x.bitwiseAND(F.lit(_signed(mask))))


def _probes(nodes: DataFrame, flips: list[tuple[int, int, int]], *extra: str) -> DataFrame:
    """(part, value, ...) of every node: its bits under the part's mask, with the given bits flipped."""
    rows = F.array(*[F.struct(*[F.lit(_signed(x)) for x in (p, m, f)]) for p, m, f in flips])
    probe = nodes.select(*extra, F.explode(rows).alias("probe"))
    part, mask, flip = (F.col(f"probe.col{i}") for i in (1, 2, 3))
    value = F.col(extra[0]).bitwiseAND(mask).bitwiseXOR(flip)
    return probe.select(part.cast("int").alias("part"), value.alias("value"), *extra)


def _bucket_links(nodes: DataFrame, plan: Plan, distance: int) -> DataFrame:
    """Links of nodes to the smallest node with the same value of a part: at most one per node and part."""
    places = [(p, m, 0) for p, m in enumerate(plan.masks)]
    placed = _probes(nodes, places, "print")
    first = placed.groupBy("part", "value").agg(F.min("print").alias("u"), F.count("*").alias("n")).where("n > 1")
    met = placed.join(first, ["part", "value"]).where("print <> u")
    return met.where(_differing(F.col("print"), F.col("u")) <= distance).select("u", F.col("print").alias("v"))


def _cross_links(nodes: DataFrame, plan: Plan, distance: int) -> DataFrame:
    """Pairs of groups with nodes within the distance, each pair of nodes met in its first part only."""
    left = _probes(nodes, plan.flips(), "print", "group").alias("l")
    kept = [(p, m, 0) for p, (m, t) in enumerate(zip(plan.masks, plan.thresholds, strict=True)) if t >= 0]
    right = _probes(nodes, kept, "print", "group").alias("r")
    a, b = F.col("l.print"), F.col("r.print")
    found = (
        (F.col("l.part") == F.col("r.part"))
        & (F.col("l.value") == F.col("r.value"))
        & (a < b)
        & (F.col("l.group") != F.col("r.group"))
        & (_differing(a, b) <= distance)
    )
    for earlier, (mask, most) in enumerate(zip(plan.masks, plan.thresholds, strict=True)):
        if most >= 0:
            found &= (F.col("l.part") <= earlier) | (_differing(a, b, mask) > most)
    groups = left.join(right, found).select(
        F.least("l.group", "r.group").alias("u"), F.greatest("l.group", "r.group").alias("v")
    )
    return groups.distinct()


def _rooted(prints: DataFrame, distance: int) -> DataFrame:
    """(print, first_id, root) of every fingerprint: its smallest doc_id, and the fingerprint that names its component."""
    nodes = stored(prints.groupBy("print").agg(F.min("doc_id").alias("first_id")), "nodes")
    n_nodes = nodes.count()
    place = F.conv(F.substring(F.md5(F.col("print").cast("string")), 1, 8), 16, 10).cast("double") / 2.0**32
    # about SAMPLE fingerprints, to plan with
    drawn = nodes.where(place < SAMPLE / max(n_nodes, 1)).select("print").toArrow()
    sample = np.sort(drawn.column("print").to_numpy()).view(np.uint64)
    plan = choose_plan(sample, n_nodes, distance)

    grouped = connected_components(_bucket_links(nodes, plan, distance))
    inner = stored(
        nodes.join(grouped, nodes["print"] == grouped["node"], "left").select(
            "print", "first_id", F.coalesce("root", "print").alias("group")
        ),
        "groups",
    )
    outer = connected_components(_cross_links(inner.select("print", "group"), plan, distance))
    return inner.join(outer, inner["group"] == outer["node"], "left").select(
        "print", "first_id", F.coalesce("root", "group").alias("root")
    )


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of ``docs``.

    Fingerprints within ``distance`` bits are linked; a component is what links
    reach, and its id the smallest doc_id there. Null texts count as empty and a
    text without words has fingerprint 0, linked like any other. A null doc_id is
    never the smallest unless there is no other. An empty table gives an empty result.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    prints = stored(map_batches(rows, _fingerprints, FINGERPRINTS), "prints")
    rooted = _rooted(prints, distance)
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(ids, "root").select("print", "component_id")
    return prints.join(named, "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each_group(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """One row of ``docs`` of every component, that with the smallest doc_id; columns unchanged.

    Rows without doc_id come after all others of their component. Of rows of a
    component that share a doc_id, or have none, the longest text stays, then the
    one with the smallest digest. The row is found again by its doc_id and text
    digest, so one doc_id may stand on rows of several components.
    """
    text = full_text(docs["text"])
    digest = F.md5(text)
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), F.char_length(text).alias("chars"), digest.alias("digest"), docs["text"]
    )
    prints = stored(map_batches(rows, _fingerprints, FINGERPRINTS_OF_ROWS), "prints")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", -F.col("chars"), "digest")
    firsts = prints.groupBy("print").agg(F.min(order).alias("first"))
    rooted = _rooted(prints, distance)
    first = firsts.join(rooted, "print").groupBy("root").agg(F.min("first").alias("first"))
    kept = first.select(id_key(F.col("first.doc_id")), "first.digest")
    return rows_named_by(docs, kept, id_key(docs["doc_id"]), digest)
