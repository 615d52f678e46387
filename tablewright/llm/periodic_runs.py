"""Runs of repeated words, found with string synchronising sets, and texts with their repeats dropped.

A run is a longest stretch of words with smallest period q (words q apart are equal)
that is at least three periods and ``MIN_RUN`` words long. Every text is worked on
whole and on its own; several texts are worked on together in flat arrays.

- Periods below ``3 * FIRST_SCALE`` are found by comparing the words with themselves
  shifted by each of them. These are the highly periodic regions that the synchronising
  sets leave out.
- At a scale t (4, 8, 16, ... words) a position is in the set where the least hash of
  the t-word blocks that begin at it or in the t places after it is that of the first or
  the last one; blocks inside a run of period t/3 or less have no hash. The choice
  depends on 2t words only, so it is the same wherever these stand again. A run with a
  period p from 3t to below 6t holds such a position and the same one p words later:
  pairs of positions with equal 2t words in that distance propose p.
- A proposal is extended to both sides as far as words p apart are equal. Of equal
  stretches the smallest period stays, so no run is given a multiple of its period.

Blocks are compared by exact names, a doubling at a time; a name is looked at only
while its block stands in its text more than once. A hash of eight words first picks
the texts in which anything that long is repeated; the others have no run.

Null texts count as empty: no words, no runs. Of runs with the same ratio of length to
period the first, then the one with the smaller period is shown. Repeated rows are
worked on like any others.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tablewright.llm.common import arrow_schema, full_text, map_batches

MIN_RUN = 24  # words
FIRST_SCALE = 4  # words; a power of two
_SMALL = 3 * FIRST_SCALE  # smaller periods are found directly
# Texts are put together up to this many bytes; a longer one is worked on alone.
TOGETHER = 4 << 20


def mixed(values: np.ndarray) -> np.ndarray:
    """64-bit integers scattered by a fixed one-to-one map."""
    x = values.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


@dataclass
class Runs:
    """Runs in flat arrays, in order of their start and period."""

    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


def _names(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number per different key, and whether the key is there more than once."""
    _, number, count = np.unique(keys, return_inverse=True, return_counts=True)
    return number.astype(np.int64), count[number] > 1


class Blocks:
    """Names of the blocks of 1, 2, 4, ... words of a flat array of words.

    Level k has a name for every place where a block of 2**k words begins that stands in
    the array more than once, and a number of its own, below zero, everywhere else.
    """

    def __init__(self, words: np.ndarray) -> None:
        n = len(words)
        self.alone = -1 - np.arange(n)
        name, again = _names(words)
        self.levels = [np.where(again, name, self.alone)]
        while True:
            size = 1 << (len(self.levels) - 1)
            below = self.levels[-1]
            at = np.flatnonzero(below[: n - size] >= 0) if n > size else np.zeros(0, np.int64)
            at = at[below[at + size] >= 0]
            if not len(at):
                break
            name, again = _names(below[at] * n + below[at + size])
            if not again.any():
                break
            level = self.alone.copy()
            level[at[again]] = name[again]
            self.levels.append(level)

    def equal_after(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from a on equal those from b on; a < b."""
        n, done = len(self.alone), np.zeros(len(a), np.int64)
        for k in reversed(range(len(self.levels))):
            x, y = a + done, b + done
            inside = y < n
            same = np.zeros(len(a), bool)
            same[inside] = self.levels[k][x[inside]] == self.levels[k][y[inside]]
            done += same.astype(np.int64) << k
        return done

    def equal_before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before a equal those before b; a < b."""
        done = np.zeros(len(a), np.int64)
        for k in reversed(range(len(self.levels))):
            x, y = a - done - (1 << k), b - done - (1 << k)
            inside = x >= 0
            same = np.zeros(len(a), bool)
            same[inside] = self.levels[k][x[inside]] == self.levels[k][y[inside]]
            done += same.astype(np.int64) << k
        return done


def _least_of_window(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row, by running minima within pieces of that width."""
    n = len(values) - width + 1
    padded = np.concatenate([values, np.full(-len(values) % width, np.iinfo(values.dtype).max, values.dtype)])
    pieces = padded.reshape(-1, width)
    up = np.minimum.accumulate(pieces, axis=1).ravel()
    down = np.minimum.accumulate(pieces[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(down[:n], up[width - 1 : width - 1 + n])


def _shifted(words: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the longest stretches in which words ``period`` apart are equal, of three periods or more."""
    same = np.concatenate([[False], words[period:] == words[:-period], [False]])
    edges = np.flatnonzero(same[1:] != same[:-1])
    starts, lengths = edges[::2], edges[1::2] - edges[::2] + period
    long = lengths >= 3 * period
    return starts[long], lengths[long]


def _propose(blocks: Blocks, scale: int, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Positions and periods, from 3 to below 6 times ``scale``, that equal contexts at a distance propose."""
    level = scale.bit_length() - 1
    block, context = blocks.levels[level], blocks.levels[level + 1]
    n = len(block)
    # Blocks that stand once only are in no repeated context, so their hash plays no part.
    top = np.uint64(np.iinfo(np.uint64).max)
    hashes = np.minimum(mixed(block), top - np.uint64(1))
    # No hash for blocks inside runs of a period of at most a third of the scale.
    inside = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        deep = (3 * period <= scale) & (length >= scale)
        np.add.at(inside, start[deep], 1)
        np.add.at(inside, start[deep] + length[deep] - scale + 1, -1)
    hashes[np.cumsum(inside[:n]) > 0] = top
    if n <= scale:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = _least_of_window(hashes, scale + 1)
    m = len(least)
    chosen = (least != top) & ((least == hashes[:m]) | (least == hashes[scale : scale + m])) & (context[:m] >= 0)
    at = np.flatnonzero(chosen)
    at = at[np.argsort(context[at], kind="stable")]
    name = context[at]
    places, periods = [], []
    # A context can stand at most 18 times within 6 scales, else its text were highly periodic.
    step = 1
    while step < len(at):
        near = name[step:] == name[:-step]
        distance = at[step:] - at[:-step]
        near &= distance < 6 * scale
        if not near.any():
            break
        fit = near & (distance >= 3 * scale)
        places.append(at[:-step][fit])
        periods.append(distance[fit])
        step += 1
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(places), np.concatenate(periods)


def runs_of(words: np.ndarray, least: int = MIN_RUN) -> Runs:
    """All runs of an array of word numbers.

    Several texts can lie one after the other where no word of one is in another.
    """
    found = [(s, c, np.full(len(s), q)) for q in range(1, min(_SMALL, len(words))) for s, c in [_shifted(words, q)]]
    found = [_smallest(found)]
    if len(words) > 3 * _SMALL - 1:
        blocks = Blocks(words)
        scale = FIRST_SCALE
        while scale.bit_length() < len(blocks.levels) and 9 * scale <= len(words):
            at, period = _propose(blocks, scale, found)
            if len(at):
                start = at - blocks.equal_before(at, at + period)
                length = at + period + blocks.equal_after(at, at + period) - start
                long = length >= 3 * period
                found = [_smallest([*found, (start[long], length[long], period[long])])]
            scale *= 2
    start, length, period = found[0]
    kept = length >= least
    return Runs(start[kept], length[kept], period[kept])


def _smallest(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of equal stretches the one with the smallest period, in order of start and period."""
    start, length, period = (np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[first], length[first], period[first]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def periodic_copy(n: int, number: int) -> np.ndarray | None:
    """Which original word stands at each place of a text whose tail is made periodic; None where it is not.

    ``number`` is the text's unsigned crc32: of every tenth the words from a place on
    repeat the words from there with a period, both following from the number.
    """
    if number % 10 or not n:
        return None
    g = number // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % p
    return places


def _may_have_runs(words: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Whether eight words in a row stand in a text twice, per text; now and then also where they do not."""
    if len(words) < MIN_RUN:
        return np.zeros(n, bool)
    hashes = mixed(words)
    for size in (1, 2, 4):
        hashes = mixed(hashes[:-size] * np.uint64(3) + hashes[size:])
    order = np.argsort(hashes, kind="stable")
    again = order[1:][hashes[order[1:]] == hashes[order[:-1]]]
    return np.bincount(owner[again], minlength=n) > 0


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about ``TOGETHER`` bytes of text."""
    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
        low = 0
        while low < batch.num_rows:
            before = sizes[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(sizes, before + TOGETHER, "right")))
            yield batch.slice(low, high - low)
            low = high


@dataclass
class Report:
    """What is said of one text."""

    runs: Runs
    words: list[str]

    def best(self) -> tuple[int, int, int, int] | tuple[None, None, None, None]:
        """Start, length, period and thousandths of the exponent of the run with the most periods."""
        start, length, period = self.runs.start, self.runs.length, self.runs.period
        if not len(start):
            return None, None, None, None
        ratio = length / period
        near = np.flatnonzero(ratio >= ratio.max() * (1 - 1e-9)).tolist()
        i = min(near, key=lambda k: (-Fraction(int(length[k]), int(period[k])), start[k], period[k]))
        return int(start[i]), int(length[i]), int(period[i]), int(1000 * length[i] // period[i])

    def collapsed(self) -> str:
        """The words without those that repeat a run's first period, joined by a blank."""
        if not len(self.runs.start):
            return " ".join(self.words)
        dropped = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(dropped, self.runs.start + self.runs.period, 1)
        np.add.at(dropped, self.runs.start + self.runs.length, -1)
        kept = np.flatnonzero(np.cumsum(dropped[:-1]) == 0)
        return " ".join([self.words[i] for i in kept.tolist()])

    def listed(self) -> str:
        """Every run as a line of start, length and period."""
        rows = zip(self.runs.start.tolist(), self.runs.length.tolist(), self.runs.period.tolist(), strict=True)
        return "".join(f"{s},{c},{q}\n" for s, c, q in rows)


def reports(texts: pa.Array, numbers: list[int] | None = None) -> Iterator[Report]:
    """A report per text; with ``numbers`` the tails of some are made periodic first."""
    cut = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts.cast(pa.large_string())))
    flat = pc.list_flatten(cut)
    sizes = pc.list_value_length(cut).to_numpy(zero_copy_only=False).copy()
    sizes[pc.equal(pc.binary_length(pc.ascii_trim_whitespace(texts)), 0).to_numpy(zero_copy_only=False)] = 0
    flat = flat.filter(pc.greater(pc.binary_length(flat), 0))  # an empty text is cut to an empty word
    coded = flat.dictionary_encode()
    spelled = np.array(coded.dictionary.to_pylist(), object)
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    if numbers is not None:
        for i in np.flatnonzero(sizes).tolist():
            places = periodic_copy(int(sizes[i]), numbers[i])
            if places is not None:
                whole = slice(ends[i] - sizes[i], ends[i])
                codes[whole] = codes[whole][places]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    own = owner * len(spelled) + codes  # words of different texts are different
    looked_at = _may_have_runs(own, owner, len(sizes))
    chosen = looked_at[owner]
    runs = runs_of(own[chosen])
    shift = np.cumsum(np.where(looked_at, sizes, 0)) - np.where(looked_at, sizes, 0)
    text_of = np.repeat(np.flatnonzero(looked_at), sizes[looked_at])[runs.start] if len(runs.start) else runs.start
    bounds = np.searchsorted(text_of, np.arange(len(sizes) + 1))
    for i, (end, size) in enumerate(zip(ends.tolist(), sizes.tolist(), strict=True)):
        these = slice(bounds[i], bounds[i + 1])
        own_runs = Runs(runs.start[these] - shift[i], runs.length[these], runs.period[these])
        yield Report(own_runs, spelled[codes[end - size : end]].tolist())


RUN_COLUMNS = (
    "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
)


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def run_digests(docs: DataFrame, with_copies: bool = False) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) per row.

    With ``with_copies`` the texts of some rows are made periodic first, by :func:`periodic_copy`
    of the crc32 of doc_id as text (null as empty).
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = arrow_schema(RUN_COLUMNS)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _together(batches):
            ids = batch.column(0)
            numbers = [zlib.crc32(b"" if i is None else str(i).encode()) for i in ids.to_pylist()]
            said = [
                (len(r.runs.start), *r.best(), _sha256(r.listed()), _sha256(r.collapsed()))
                for r in reports(batch.column(1), numbers if with_copies else None)
            ]
            columns = [pa.array(list(c), f.type) for c, f in zip(zip(*said, strict=True), fields, strict=True)]
            yield pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", *fields.names])

    texts = docs.select(docs["doc_id"].alias("doc_id"), full_text(docs["text"]).alias("text"))
    return map_batches(texts, rows, f"doc_id {kind}, {RUN_COLUMNS}")


def without_repeats(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, text, n_runs): the words left when all but the first period of every run is dropped, joined by a blank."""
    kind = docs.schema[key].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _together(batches):
            said = [(r.collapsed(), len(r.runs.start)) for r in reports(batch.column(1))]
            texts, counts = zip(*said, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(list(texts), pa.string()), pa.array(list(counts), pa.int64())],
                names=["key", "text", "n_runs"],
            )

    given = docs.select(docs[key].alias("key"), full_text(docs[text]).alias("text"))
    return map_batches(given, rows, f"key {kind}, text string, n_runs long").withColumnRenamed("key", key)
