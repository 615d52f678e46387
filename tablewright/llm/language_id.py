"""Language identification by sparse multinomial logistic regression on character n-grams.

A text is lower-cased, its blanks are made one, and its character 1- to 3-grams are
hashed into ``BUCKETS`` features. Features are term counts times inverse document
frequency, scaled to length 1. Document frequencies are counted over every
training row. The regression is fitted on about ``PER_LANGUAGE`` rows of each
language, drawn by digest, with follow-the-regularised-leader steps under an
elastic-net penalty; a fifth of those rows is kept aside to set the temperature
of the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.hashing import order_key
from tablewright.llm.common import arrow_schema, map_batches, record_batch, slices, unsigned_crc32

BUCKETS = 1 << 15
PER_LANGUAGE = 500
MOST_LANGUAGES = 1000
PASSES = 4
CHUNK = 1 << 20
UNDETERMINED = "und"

# Step size, its smoothing, and the weights of the two penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4

PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"
_ORDERS = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]
_SHIFT = np.uint32(32 - BUCKETS.bit_length() + 1)


def ngram_counts(text: str) -> np.ndarray:
    """Counts of the hashed 1- to 3-grams of a whole text, taken in overlapping chunks."""
    plain = f" {' '.join(text.lower().split())} "
    total = np.zeros(BUCKETS, np.int64)
    for low in range(0, len(plain), CHUNK):
        part = plain[max(0, low - 2) : low + CHUNK]
        code = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        new = min(low, 2)  # characters that only lead into this chunk
        gram = np.zeros(len(code), np.uint32)
        for n, factor in enumerate(_ORDERS):
            # the n-gram that starts at each place, mixed from the shorter one
            gram = (gram[: len(code) - n] ^ code[n:]) * factor
            gram ^= gram >> np.uint32(15)
            first = max(0, new - n)
            total += np.bincount((gram[first:] * _ORDERS[0]) >> _SHIFT, minlength=BUCKETS)
            if len(gram) < 2:
                break
    return total


def _features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = ngram_counts(text)
    where = np.flatnonzero(counts)
    value = counts[where] * idf[where]
    norm = np.sqrt(value @ value)
    return where, value / norm if norm else value


def fit_weights(rows: list[tuple[np.ndarray, np.ndarray, int]], n_classes: int, passes: int = PASSES) -> np.ndarray:
    """(BUCKETS + 1, n_classes) weights, the last row for the bias, by proximal follow-the-regularised-leader."""
    z = np.zeros((BUCKETS + 1, n_classes))
    n = np.zeros((BUCKETS + 1, n_classes))

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        step = (BETA + np.sqrt(n[at])) / ALPHA + L2
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / step)

    for _ in range(passes):
        for where, value, label in rows:
            at, x = np.append(where, BUCKETS), np.append(value, 1.0)
            w = weights(at)
            error = softmax(x @ w)
            error[label] -= 1.0
            gradient = x[:, None] * error
            grown = n[at] + gradient**2
            z[at] += gradient - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * w
            n[at] = grown
    return weights(np.arange(BUCKETS + 1))


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max())
    return e / e.sum()


def fit_temperature(logits: list[np.ndarray], labels: list[int]) -> float:
    """The temperature of least cross-entropy, by golden section over its logarithm."""
    if not logits:
        return 1.0

    def loss(log_t: float) -> float:
        t = np.exp(log_t)
        return -sum(np.log(softmax(x / t)[y] + 1e-300) for x, y in zip(logits, labels, strict=True))

    low, high, ratio = -4.0, 4.0, (np.sqrt(5) - 1) / 2
    for _ in range(30):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


@dataclass
class LanguageModel:
    """Weights, inverse document frequencies and temperature; its size does not depend on the table."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.languages or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0
        where, value = _features(text, self.idf)
        chance = softmax((value @ self.weights[where] + self.weights[-1]) / self.temperature)
        best = int(chance.argmax())
        return self.languages[best], float(chance[best])


def is_held_out() -> Column:
    return F.pmod(unsigned_crc32("doc_id"), F.lit(4)) == 2


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(BUCKETS + 1, np.int64), 0
    for batch in slices(batches):
        for text in batch.column(0).to_pylist():
            total[:-1] += ngram_counts(text) > 0
            n += 1
    total[-1] = n
    where = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays(
        [pa.array(where, pa.int32()), pa.array(total[where], pa.int64())], names=["bucket", "n_docs"]
    )


def _sparse_rows(idf: np.ndarray):
    schema = arrow_schema("lang string, place string, buckets array<int>, values array<float>")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, lang, place in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                where, value = _features(text, idf)
                rows.append((lang, place, where.astype(np.int32), value.astype(np.float32)))
            yield record_batch(schema, rows)

    return sparse


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """A model of the languages of the training rows: text and lang not null, not held out.

    Of each language about ``per_language`` rows are fitted, all where it has fewer,
    and at most ``MOST_LANGUAGES`` languages learned, the most frequent ones. Without training
    rows every prediction is ``und``.
    """
    rows = docs.where(docs["lang"].isNotNull() & docs["text"].isNotNull() & ~is_held_out()).select(
        docs["text"], docs["lang"], docs["doc_id"]
    )
    counted = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()
    languages = sorted(r["lang"] for r in counted)
    if not languages:
        return LanguageModel([], np.zeros(BUCKETS), np.zeros((BUCKETS + 1, 0)), 1.0)

    found = map_batches(rows.select("text"), _document_counts, "bucket int, n_docs long")
    summed = found.groupBy("bucket").agg(F.sum("n_docs").alias("n_docs")).toArrow()  # at most BUCKETS + 1 rows
    frequency = np.zeros(BUCKETS + 1)
    frequency[summed.column("bucket").to_numpy()] = summed.column("n_docs").to_numpy()
    idf = np.log((1 + frequency[-1]) / (1 + frequency[:-1])) + 1

    place = order_key("doc_id", seed="language")
    share = F.create_map(
        *[F.lit(x) for r in counted for x in (r["lang"], min(1.0, per_language / r["count"]))]
    )
    draw = F.conv(F.substring(place, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    drawn = rows.withColumn("place", place).where(draw < F.try_element_at(share, F.col("lang")))
    sparse = map_batches(
        drawn.select("text", "lang", "place"),
        _sparse_rows(idf), "lang string, place string, buckets array<int>, values array<float>"
    )
    number = {lang: i for i, lang in enumerate(languages)}
    sample = [
        (np.array(r["buckets"]), np.array(r["values"], np.float64), number[r["lang"]])
        for r in sorted(sparse.toArrow().to_pylist(), key=lambda r: (r["place"], r["lang"]))
    ]
    aside, fitted = sample[::5], [r for i, r in enumerate(sample) if i % 5]
    weights = fit_weights(fitted or sample, len(languages))
    logits = [value @ weights[where] + weights[-1] for where, value, _ in aside]
    return LanguageModel(languages, idf, weights, fit_temperature(logits, [label for *_, label in aside]))


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row per row of ``docs``.

    A null text, or one without a letter, is ``und`` with score 0. Only the text is
    looked at; a null doc_id counts as the empty key for ``held_out``.
    """
    schema = arrow_schema(PREDICTED)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, held, texts = (batch.column(i).to_pylist() for i in range(3))
            rows = [(i, h, *shared.value.predict(t)) for i, h, t in zip(ids, held, texts, strict=True)]
            yield record_batch(schema, rows)

    rows = docs.select(docs["doc_id"].cast("long"), is_held_out().alias("held_out"), docs["text"])
    return map_batches(rows, predicted, PREDICTED)
