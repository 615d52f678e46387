"""Hard negatives by one-bit codes of rotated vectors, with bounds that lose nothing.

Each vector v of whole numbers is written as ``a1 c1 + a2 c2 + … + r``: at every stage the
rest is rotated, c is the unit vector of its signs, and the alignment a is its inner
product with the rest. Signs, alignments and the length of the last rest are stored.
For an anchor q, rotated and rounded to ``PLANES`` bits a place, every <q, c> comes from
population counts of its bit planes and the code. The true inner product differs from
the sum of a <q, c> by no more than the rounding allows, plus, by the Cauchy-Schwarz inequality
on the parts square to the last c, the length of r times that of q's part. A row is a
candidate where this interval can reach what is looked for; candidates alone are scored,
in whole numbers.

The positives of an anchor are its best rows of the same label, its negatives for each
positive the best rows of other labels within a band of the positive's score. Rows are
dealt by hash into slabs and anchors into blocks, both of bounded size, and every slab
meets every block in a task of its own, whatever the labels. Such a cell gives at most
``best`` rows per anchor and positive; a window with a limit per group merges them.

Rows without id, label or vector, or with a component that is missing, infinite or not
a number, take no part. Shorter vectors end in zeros. Every row counts by itself, also
where an id is there more than once; among equal scores and ids the order is that of
storing, which shows in no column. Scores a hundredfold must fit in 64 bits, else an
error says so.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import arrow_schema, map_batches, record_batch, slices, stored

STAGES = 4
PLANES = 8
SEED = 42
# Rows of a slab and anchors of a block; a task holds one of each. There are some slabs
# even for a small table, so that it is not left to one task.
SLAB_ROWS = 16_384
LEAST_SLABS = 16
BLOCK_ROWS = 4_096
# Pairs looked at together within a task.
_PAIRS = 1 << 20

CODED = "row long, id long, label long, vector {vector}, anchor boolean, codes binary, alignments array<double>, rest double"
POSITIVES = "anchor_row long, anchor_id long, row long, id long, score long"
NEGATIVES = (
    "anchor_row long, anchor_id long, positive_row long, positive_id long, positive_score long, "
    "row long, id long, score long"
)


def rotations(width: int, stages: int = STAGES, seed: int = SEED) -> np.ndarray:
    """(stages, bits, width) matrices with orthonormal columns; bits are a multiple of 64."""
    bits = -(-width // 64) * 64
    draw = np.random.default_rng(seed)
    return np.stack([np.linalg.qr(draw.normal(size=(bits, bits)))[0][:, :width] for _ in range(stages)])


def code(vectors: np.ndarray, turns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs (rows, stages, bits / 64), alignments (rows, stages) and lengths of the rests."""
    rest = vectors.astype(np.float64)
    bits = turns.shape[1]
    packed, alignments = [], []
    for turn in turns:
        turned = rest @ turn.T
        positive = turned >= 0
        signs = np.where(positive, 1.0, -1.0) / math.sqrt(bits)
        alignment = np.einsum("ij,ij->i", turned, signs)
        rest = rest - alignment[:, None] * (signs @ turn)
        packed.append(np.packbits(positive, axis=1, bitorder="little").view(np.uint64))
        alignments.append(alignment)
    # a code vector can lie partly outside the turned space, so its length there is not 1; see bounds()
    return np.stack(packed, 1), np.stack(alignments, 1), np.linalg.norm(rest, axis=1)


class Anchors:
    """Anchors rotated and cut into bit planes, one set per stage."""

    def __init__(self, vectors: np.ndarray, turns: np.ndarray) -> None:
        self.norms = np.linalg.norm(vectors.astype(np.float64), axis=1)
        self.planes, self.low, self.step, self.sums, self.off = [], [], [], [], []
        bits = turns.shape[1]
        for turn in turns:
            turned = vectors.astype(np.float64) @ turn.T
            low = turned.min(axis=1, keepdims=True)
            step = np.maximum(turned.max(axis=1, keepdims=True) - low, 1e-300) / (2**PLANES - 1)
            level = np.rint((turned - low) / step).astype(np.uint8)
            rounded = low + step * level
            planes = [
                np.packbits((level >> b) & 1, axis=1, bitorder="little").view(np.uint64) for b in range(PLANES)
            ]
            self.planes.append(np.stack(planes, 1))
            self.low.append(low)
            self.step.append(step)
            self.sums.append(rounded.sum(axis=1, keepdims=True))
            self.off.append(np.abs(turned - rounded).sum(axis=1, keepdims=True) / math.sqrt(bits))
        self.bits = bits
        self.square = bits == turns.shape[2]

    def bounds(
        self, some: np.ndarray, codes: np.ndarray, alignments: np.ndarray, rests: np.ndarray, norms: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest possible inner product of the anchors ``some`` with every row."""
        middle = np.zeros((len(some), len(codes)))
        off = np.zeros_like(middle)
        beside = np.zeros_like(middle)
        for k in range(len(self.planes)):
            counts = np.zeros(middle.shape, np.int64)
            ones = np.zeros(len(codes), np.int64)
            for w in range(codes.shape[2]):
                word = codes[:, k, w]
                ones += np.bitwise_count(word)
                for b in range(PLANES):
                    met = np.bitwise_count(self.planes[k][some, b, w][:, None] & word[None, :])
                    counts += met.astype(np.int64) << b
            low, step, sums = (x[k][some] for x in (self.low, self.step, self.sums))
            along = (2 * (low * ones + step * counts) - sums) / math.sqrt(self.bits)
            middle += alignments[:, k] * along
            off += alignments[:, k] * self.off[k][some]
            beside = np.maximum(np.abs(along) - self.off[k][some], 0.0)
        lengths = self.norms[some][:, None]
        if self.square:  # the last rest is square to the last code vector
            lengths = np.sqrt(np.maximum(lengths**2 - beside**2, 0.0))
        off += lengths * rests + 1e-9 * (self.norms[some][:, None] * norms + 1.0)
        return middle - off, middle + off


def scores_of(anchors: np.ndarray, rows: np.ndarray, mask: np.ndarray, exact: bool) -> tuple[np.ndarray, ...]:
    """Places (anchor, row) where ``mask`` holds and the whole inner products there.

    ``exact`` says that sums fit into the 53 bits of floating point numbers.
    """
    i, j = np.nonzero(mask)
    kind = np.float64 if exact else np.int64
    if 8 * len(i) > mask.size:
        found = (anchors.astype(kind) @ rows.astype(kind).T)[i, j]
    else:
        found = np.zeros(len(i), kind)
        piece = max(1, _PAIRS // max(rows.shape[1], 1))
        for low in range(0, len(i), piece):
            a, b = i[low : low + piece], j[low : low + piece]
            found[low : low + piece] = np.einsum("ij,ij->i", anchors[a].astype(kind), rows[b].astype(kind))
    return i, j, found.astype(np.int64)


def first_of_each(group: np.ndarray, score: np.ndarray, id_: np.ndarray, row: np.ndarray, best: int) -> np.ndarray:
    """Places of the ``best`` highest scores of each group, ties by id, then row."""
    order = np.lexsort((row, id_, -score, group))
    sorted_ = group[order]
    start = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])[: len(order)]
    first = np.flatnonzero(start)
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return order[rank < best]


def _kth_greatest(values: np.ndarray, k: int) -> np.ndarray:
    """Per row of a matrix; minus infinity where it has fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(values, -k, axis=1)[:, -k]


class _Cell:
    """One block of anchors and one slab of rows as arrays."""

    def __init__(self, anchors: pa.Table, rows: pa.Table, turns: np.ndarray, exact: bool) -> None:
        self.exact = exact
        width = turns.shape[2]
        self.q, self.v = (_matrix(t.column("vector"), width) for t in (anchors, rows))
        self.q_row, self.q_id, self.q_label = (anchors.column(c).to_numpy() for c in ("row", "id", "label"))
        self.row, self.id, self.label = (rows.column(c).to_numpy() for c in ("row", "id", "label"))
        words = b"".join(rows.column("codes").to_pylist())
        self.codes = np.frombuffer(words, np.uint64).reshape(len(self.row), len(turns), -1)
        self.alignments = rows.column("alignments").combine_chunks().flatten().to_numpy().reshape(len(self.row), -1)
        self.rest = rows.column("rest").to_numpy()
        self.norms = np.linalg.norm(self.v.astype(np.float64), axis=1)
        self.coded = Anchors(self.q, turns)

    def pieces(self, some: np.ndarray, others: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Anchors, rows and the bounds between them, ``_PAIRS`` at a time."""
        few = min(len(some), 64)
        many = max(1, _PAIRS // max(few, 1))
        for a in range(0, len(some), 64):
            for b in range(0, len(others), many):
                i, j = some[a : a + 64], others[b : b + many]
                low, high = self.coded.bounds(i, self.codes[j], self.alignments[j], self.rest[j], self.norms[j])
                yield i, j, low, high

    def scored(self, i: np.ndarray, j: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b, score = scores_of(self.q[i], self.v[j], mask, self.exact)
        return i[a], j[b], score

    def best(self, group: np.ndarray, j: np.ndarray, score: np.ndarray, best: int) -> np.ndarray:
        return first_of_each(group, score, self.id[j], self.row[j], best)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of whole numbers as rows, ended by zeros."""
    lists = column.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(-1, width).astype(np.int64)
    made = np.zeros((len(sizes), width), np.int64)
    made[np.arange(width) < sizes[:, None]] = flat
    return made


def _cell_positives(cell: _Cell, best: int) -> list[tuple]:
    found: list[tuple[np.ndarray, ...]] = []
    for label in np.unique(cell.q_label):
        some, others = np.flatnonzero(cell.q_label == label), np.flatnonzero(cell.label == label)
        for i, j, low, high in cell.pieces(some, others):
            other = cell.q_row[i][:, None] != cell.row[j][None, :]
            least = _kth_greatest(np.where(other, low, -np.inf), best)
            a, b, score = cell.scored(i, j, other & (high >= least[:, None]))
            kept = cell.best(a, b, score, best)
            found.append((a[kept], b[kept], score[kept]))
    if not found:
        return []
    a, b, score = (np.concatenate(x) for x in zip(*found, strict=True))
    kept = cell.best(a, b, score, best)
    a, b, score = a[kept], b[kept], score[kept]
    return list(zip(*(x.tolist() for x in (cell.q_row[a], cell.q_id[a], cell.row[b], cell.id[b], score)), strict=True))


def _cell_negatives(cell: _Cell, positives: list[list[dict]], best: int, percent: int) -> list[tuple]:
    """The best rows of another label for each positive, their score between ``percent`` of its own and its own."""
    most = max(map(len, positives), default=0)
    cap = np.full((len(positives), most), -1, np.int64)  # a score below zero has an empty band
    for i, those in enumerate(positives):
        cap[i, : len(those)] = [p["score"] for p in those]
    found: list[tuple[np.ndarray, ...]] = []
    for i, j, low, high in cell.pieces(np.arange(len(positives)), np.arange(len(cell.row))):
        other = cell.q_label[i][:, None] != cell.label[j][None, :]
        mask = np.zeros(other.shape, bool)
        for p in range(most):
            top = cap[i, p][:, None]
            bottom = np.where(top >= 0, top * (percent / 100) - 1.0, np.inf)
            sure = other & (low >= bottom + 2.0) & (high <= top)
            if (sure.sum(axis=1) >= best).any():
                bottom = np.maximum(bottom, _kth_greatest(np.where(sure, low, -np.inf), best)[:, None])
            mask |= other & (high >= bottom) & (low <= top)
        a, b, score = cell.scored(i, j, mask)
        for p in range(most):
            top = cap[a, p]
            fits = np.flatnonzero((top >= 0) & (percent * top <= 100 * score) & (score <= top))
            kept = fits[cell.best(a[fits], b[fits], score[fits], best)]
            found.append((a[kept] * most + p, b[kept], score[kept]))
    if not found:
        return []
    group, b, score = (np.concatenate(x) for x in zip(*found, strict=True))
    kept = cell.best(group, b, score, best)
    rows = []
    for g, j, s in zip(group[kept].tolist(), b[kept].tolist(), score[kept].tolist(), strict=True):
        i, positive = g // most, positives[g // most][g % most]
        rows.append(
            (int(cell.q_row[i]), int(cell.q_id[i]), positive["row"], positive["id"], positive["score"])
            + (int(cell.row[j]), int(cell.id[j]), s)
        )
    return rows


def _in_cells(anchors: DataFrame, rows: DataFrame, slabs: int, blocks: int):
    """Every block of anchors with every slab of rows."""
    slab, block = F.pmod(F.xxhash64("row"), F.lit(slabs)), F.pmod(F.xxhash64("row"), F.lit(blocks))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    # both may come from one table; columns renamed to their own name are told apart
    left = anchors.select(*(F.col(c).alias(c) for c in anchors.columns)).withColumn("block", block)
    right = rows.withColumn("slab", slab).select("*", every(blocks).alias("block"))
    return left.select("*", every(slabs).alias("slab")).groupBy("slab", "block").cogroup(right.groupBy("slab", "block"))


def coded_rows(rows: DataFrame, turns: Broadcast, vector: str) -> DataFrame:
    """The rows of (id, label, vector, anchor) with a number, codes, alignments and the length of the rest."""
    schema = CODED.format(vector=vector)
    names = [part.split()[0] for part in schema.split(", ")]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000):
            table = pa.table({n: batch.column(i) for i, n in enumerate(batch.schema.names)})
            packed, alignments, rest = code(_matrix(table.column("vector"), turns.value.shape[2]), turns.value)
            added = {
                "codes": pa.array([p.tobytes() for p in packed], pa.binary()),
                "alignments": pa.array(alignments.tolist(), pa.list_(pa.float64())),
                "rest": pa.array(rest),
            }
            yield pa.RecordBatch.from_arrays(
                [added[n] if n in added else batch.column(batch.schema.get_field_index(n)) for n in names], names=names
            )

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "id", "label", "vector", "anchor")
    return map_batches(numbered, coded, schema)


def hard_negatives(
    rows: DataFrame,
    anchor: Column,
    positives: int = 5,
    negatives: int = 5,
    percent: int = 80,
    stages: int = STAGES,
    slab_rows: int = SLAB_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` has (id, label, vector): whole numbers, the vector an array. ``anchor`` says which
    rows are anchors. For each anchor and each of its first ``positives`` rows of the same
    label, the first ``negatives`` rows of other labels with ``percent`` of the positive's
    score or more, and no more than it.
    """
    spark = rows.sparkSession
    given = rows.select("id", "label", "vector", F.coalesce(anchor, F.lit(False)).alias("anchor"))
    given = given.where("id is not null and label is not null and vector is not null")
    told = given.agg(
        F.count("*").alias("n"),
        F.count_if("anchor").alias("anchors"),
        F.max(F.size("vector")).alias("width"),
        F.max(F.array_max(F.transform("vector", F.abs))).alias("most"),
    ).head()
    width, most = max(told["width"] or 0, 1), told["most"] or 0
    if 100 * width * most**2 >= 2**63:
        raise ValueError(f"scores of components up to {most} do not fit in 64 bits")
    vector = "array<int>" if most < 2**31 else "array<long>"
    exact = width * most**2 < 2**53
    turns = spark.sparkContext.broadcast(rotations(width, stages))  # grows with the width of a vector only
    narrow = given.withColumn("vector", F.col("vector").cast(vector))
    coded = stored(coded_rows(narrow, turns, vector), "coded")
    slabs, blocks = max(LEAST_SLABS, -(-told["n"] // slab_rows)), -(-max(told["anchors"], 1) // block_rows)

    def local_positives(anchors: pa.Table, others: pa.Table) -> pa.Table:
        found = _cell_positives(_Cell(anchors, others, turns.value, exact), positives) if len(anchors) and len(others) else []
        return pa.Table.from_batches([record_batch(arrow_schema(POSITIVES), found)])

    def local_negatives(anchors: pa.Table, others: pa.Table) -> pa.Table:
        found = []
        if len(anchors) and len(others):
            cell = _Cell(anchors, others, turns.value, exact)
            found = _cell_negatives(cell, anchors.column("positives").to_pylist(), negatives, percent)
        return pa.Table.from_batches([record_batch(arrow_schema(NEGATIVES), found)])

    asked = coded.where("anchor").select("row", "id", "label", "vector")
    others = coded.select("row", "id", "label", "vector", "codes", "alignments", "rest")
    near = _in_cells(asked, others, slabs, blocks).applyInArrow(local_positives, POSITIVES)
    by_anchor = Window.partitionBy("anchor_row").orderBy(F.col("score").desc(), "id", "row")
    of_anchor = (
        near.withColumn("place", F.row_number().over(by_anchor))
        .where(F.col("place") <= positives)
        .groupBy("anchor_row")
        .agg(F.collect_list(F.struct("row", "id", "score")).alias("positives"))  # at most ``positives`` of them
        .withColumnRenamed("anchor_row", "row")
    )
    with_positives = stored(asked.join(of_anchor, "row"), "positives")
    far = _in_cells(with_positives, others, slabs, blocks).applyInArrow(local_negatives, NEGATIVES)
    by_pair = Window.partitionBy("anchor_row", "positive_row").orderBy(F.col("score").desc(), "id", "row")
    ranked = far.withColumn("rank", F.row_number().over(by_pair)).where(F.col("rank") <= negatives)
    return ranked.select(
        "anchor_id",
        "positive_id",
        F.col("rank").cast("int").alias("rank"),
        F.col("id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )


def whole_vectors(table: DataFrame, id_: str, label: Column, vector: str) -> DataFrame:
    """(id, label, vector) with each component x as floor(256 x); rows with a missing or infinite one are left out."""
    values = F.transform(F.col(vector), lambda x: x.cast("double"))
    odd = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = table.select(F.col(id_).cast("long").alias("id"), label.cast("long").alias("label"), values.alias("values"), odd.alias("odd"))
    whole = F.transform("values", lambda x: F.floor(x * F.lit(256.0)).cast("long"))
    return rows.where("values is not null and not odd").select("id", "label", whole.alias("vector"))
