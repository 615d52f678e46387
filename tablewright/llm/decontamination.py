"""Benchmark passages in training texts, by seeds and local alignment.

Every word n-gram of a benchmark item is a seed, so any copied run of ``SEED_WORDS``
words is found, however often it occurs and whatever the other documents hold. Seeds
found in a document give
the places where an item may stand, and a Smith-Waterman alignment of words scores
each: 1 for a whole copy, less for every word changed, left out or put in.

Benchmark items are the queries, taken in blocks of bounded size against all
documents; nothing is dropped for being frequent.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import arrow_schema, full_text, map_batches, record_batch, slices

SEED_WORDS = 3
LEAST_SCORE = 0.5
BLOCK_BYTES = 16 << 20

# Points of the alignment.
MATCH, MISMATCH, GAP = 2, -1, -1

FOUND = "doc_id long, item_id long, score double, start long, end long"
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """(points, start, end) of the best local alignment of two sequences of word numbers.

    Start and end are places in the passage. Of equal points the earliest end counts.
    """
    n = len(passage)
    place = np.arange(n + 1)
    points = np.zeros(n + 1, np.int64)
    origin = place.copy()
    best = (0, 0, 0)
    for word in item:
        step = points[:-1] + np.where(passage == word, MATCH, MISMATCH)
        skip = points[1:] + GAP
        score = np.concatenate([[0], np.maximum(np.maximum(step, skip), 0)])
        start = np.concatenate([[0], np.where(step >= skip, origin[:-1], origin[1:])])
        start = np.where(score > 0, start, place)
        # words of the passage left out: a running maximum of the points plus the gaps crossed
        raised = score - GAP * place
        top = np.maximum.accumulate(raised)
        source = np.maximum.accumulate(np.where(raised == top, place, 0))
        score, start = top + GAP * place, start[source]
        points = np.maximum(score, 0)
        origin = np.where(score > 0, start, place)
        end = int(points.argmax())
        if points[end] > best[0]:
            best = (int(points[end]), int(origin[end]), end)
    return best


class Block:
    """Some benchmark items with their seeds; its size is bounded by ``BLOCK_BYTES`` of text."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.number: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        for id_, text in items:
            words = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)]
            if words:
                self.items.append((id_, np.array(words, np.int64)))
        self.base = len(self.number) + 1
        self.has_short = any(len(w) < SEED_WORDS for _, w in self.items)
        # the (item, place) of every n-gram
        self.seeds: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for number, (_, item) in enumerate(self.items):
            for i, gram in enumerate(self.item_grams(item).tolist()):
                self.seeds[gram].append((number, i))
        self.sorted_seeds = np.array(sorted(self.seeds), np.int64)

    def grams(self, words: np.ndarray, width: int = SEED_WORDS) -> np.ndarray:
        """One number per run of ``width`` words; -1 where a word is in no item."""
        if len(words) < width:
            return np.zeros(0, np.int64)
        n = len(words) - width + 1
        value, known = np.zeros(n, np.int64), np.ones(n, bool)
        for i in range(width):
            value = value * self.base + words[i : i + n]
            known &= words[i : i + n] > 0
        return np.where(known, value, -1)

    def numbered(self, text: str | None) -> np.ndarray:
        get = self.number.get
        return np.array([get(w, 0) for w in words_of(text)], np.int64)

    def item_grams(self, item: np.ndarray) -> np.ndarray:
        """An item's n-grams; an item shorter than that is its words alone."""
        return self.grams(item) if len(item) >= SEED_WORDS else -1 - item

    def document_grams(self, words: np.ndarray) -> np.ndarray:
        """n-grams by place, followed by the single words that short items need."""
        grams = self.grams(words)
        return np.concatenate([grams, -1 - words]) if self.has_short else grams

    def search(self, text: str | None, least: float) -> list[tuple[int, float, int, int]]:
        """(item_id, score, start, end) of the items that align with ``text``, in words of the text."""
        words = self.numbered(text)
        grams = self.document_grams(words)
        n_grams = max(0, len(words) - SEED_WORDS + 1)
        hits = np.flatnonzero(_among(grams, self.sorted_seeds))
        regions: dict[int, list[tuple[int, int]]] = defaultdict(list)
        there = np.zeros(self.base, bool)
        there[words] = True
        # no alignment has more matches than the item's words that occur in the text
        may: dict[int, bool] = {}
        for at in hits.tolist():
            place = at if at < n_grams else at - n_grams
            for number, offset in self.seeds[int(grams[at])]:
                if number not in may:
                    item = self.items[number][1]
                    may[number] = bool(there[item].sum() >= least * len(item))
                if not may[number]:
                    continue
                # the item around the seed, with room for half its length of words put in
                length = len(self.items[number][1])
                room = length // 2 + 1
                low = max(0, place - offset - room)
                high = min(len(words), place - offset + length + room)
                old = regions[number]
                if old and low <= old[-1][1]:
                    old[-1] = (min(low, old[-1][0]), max(high, old[-1][1]))
                else:
                    old.append((low, high))
        found = []
        for number, spans in regions.items():
            id_, item = self.items[number]
            best = (0.0, 0, 0)
            for low, high in spans:
                passage = words[low:high]
                # no alignment has more matches than the item's words that occur there
                if np.isin(item, passage).sum() < least * len(item):
                    continue
                points, start, end = align(item, passage)
                score = points / (MATCH * len(item))
                if score > best[0]:
                    best = (score, low + start, low + end)
            if best[0] >= least:
                found.append((id_, *best))
        return found


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values


def blocks_of(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """The items in blocks of at most ``block_bytes`` of text, or one item where it is longer.

    Items without a word, or without an id, are in no block; of repeated ids every text counts.
    """
    rows = items.select(items["item_id"].cast("long").alias("item_id"), full_text(items["text"]).alias("text"))
    held: list[tuple[int, str]] = []
    size = 0
    for row in rows.where("item_id is not null").orderBy("item_id", "text").toLocalIterator():
        if held and size + len(row["text"]) > block_bytes:
            yield Block(held)
            held, size = [], 0
        held.append((row["item_id"], row["text"]))
        size += len(row["text"])
    if held:
        yield Block(held)


def contaminated(docs: DataFrame, items: DataFrame, least: float = LEAST_SCORE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, score, start, end): items that stand in documents, the best place of each.

    ``start`` and ``end`` count the document's words. Texts are compared by their
    lower-cased words; null texts have none and match nothing. Repeated rows give
    repeated results, and a row without doc_id one with a null. An empty table on
    either side gives an empty result.
    """
    spark = docs.sparkSession
    result = spark.createDataFrame([], FOUND)
    schema = arrow_schema(FOUND)
    rows = docs.select(docs["doc_id"].cast("long"), docs["text"])
    for block in blocks_of(items, block_bytes):
        shared = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                rows = []
                for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    rows += [(id_, *hit) for hit in shared.value.search(text, least)]
                yield record_batch(schema, rows)

        result = result.unionByName(map_batches(rows, search, FOUND))
    return result


def without_benchmark(docs: DataFrame, items: DataFrame, least: float = LEAST_SCORE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` in which no item stands; columns unchanged, and no text is shuffled."""
    spark = docs.sparkSession
    for block in blocks_of(items, block_bytes):
        shared = spark.sparkContext.broadcast(block)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
                yield batch.filter(pa.array([not shared.value.search(t, least) for t in texts], pa.bool_()))

        docs = map_batches(docs, clean, docs.schema)
    return docs
