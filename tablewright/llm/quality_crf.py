"""Document quality from a linear-chain conditional random field over lines.

Every line of a document is good or bad. A line's features are measures of its
characters and words, and those of its two neighbours. The field is trained on a
bounded sample of labelled documents whose lines all carry the document's label;
forward and backward sums give the chance that a line is good, and the
chances, weighted by line length, make the document's score.
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

SAMPLE_PER_LABEL = 1000
STEPS = 120
RATE = 0.15
PENALTY = 1e-3
KEEP_AT = 0.3
SCORED_TOGETHER = 2048  # documents whose chains are summed side by side

SCORED = "doc_id long, held_out boolean, score double, predicted int"

# Character classes of the line measures.
_LOWER, _UPPER, _DIGIT, _SPACE, _STOP, _PAUSE, _SYMBOL, _OTHER = range(8)
_CLASS = np.full(256, _OTHER, np.uint8)
for _code in range(256):
    _c = chr(_code)
    if _c.isalpha():
        _CLASS[_code] = _UPPER if _c.isupper() else _LOWER
    elif _c.isdigit():
        _CLASS[_code] = _DIGIT
    elif _c.isspace():
        _CLASS[_code] = _SPACE
    elif _c in ".?":
        _CLASS[_code] = _STOP
    elif _c in ",;:'\"()-":
        _CLASS[_code] = _PAUSE
    elif _code < 128:
        _CLASS[_code] = _SYMBOL
N_CLASSES = 8
N_WORDS = 7
N_LINE = N_CLASSES + N_WORDS
N_FEATURES = 3 * N_LINE + 1


def _words_of(line: str, seen: set[str]) -> tuple[float, ...]:
    words = line.split()
    n = len(words)
    if not n:
        return (0.0,) * N_WORDS
    again = float(line in seen)
    seen.add(line)
    return (
        min(1.0, np.log1p(n) / 6),
        len(set(words)) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        min(2.0, len(line) / n / 8),
        float(line[-1] in ".?\"'"),
        float(line[0].isupper()),
        again,
    )


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(lines x N_FEATURES features, line lengths) of a whole text.

    Lines end at line feeds; an empty text is one empty line.
    """
    lines = text.split("\n")
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _CLASS[np.minimum(code, 255)]
    # letters beyond the table count as lower case
    kind[code > 255] = _LOWER
    length = np.array([len(line) for line in lines])
    number = np.repeat(np.arange(len(lines)), length)
    inside = code != 10
    counts = np.bincount(number * N_CLASSES + kind[inside], minlength=len(lines) * N_CLASSES)
    shares = counts.reshape(len(lines), N_CLASSES) / np.maximum(length, 1)[:, None]
    seen: set[str] = set()
    own = np.hstack([shares, np.array([_words_of(line, seen) for line in lines])])
    features = np.zeros((len(lines), N_FEATURES))
    features[:, :N_LINE] = own
    features[1:, N_LINE : 2 * N_LINE] = own[:-1]
    features[:-1, 2 * N_LINE : 3 * N_LINE] = own[1:]
    features[:, -1] = 1.0
    return features, length


def marginals(unary: list[np.ndarray], transition: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, float]:
    """Chances of the good state per line, expected transitions, and the summed log partition.

    ``unary`` holds a chain's log potentials of the good state; the bad state's are 0.
    Chains are worked on together, longest first, in the log domain.
    """
    order = sorted(range(len(unary)), key=lambda i: -len(unary[i]))
    n, longest = len(unary), len(unary[order[0]]) if unary else 0
    lengths = np.array([len(unary[i]) for i in order])
    active = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(longest + 1)]
    alpha = [np.zeros((active[t], 2)) for t in range(longest)]
    potential = []
    starts = np.concatenate([[0], np.cumsum(lengths)])
    flat = np.concatenate([unary[i] for i in order]) if n else np.zeros(0)
    for t in range(longest):
        score = np.zeros((active[t], 2))
        score[:, 1] = flat[starts[: active[t]] + t]
        potential.append(score)
        if t == 0:
            alpha[t] = score
        else:
            before = alpha[t - 1][: active[t], :, None] + transition
            alpha[t] = np.logaddexp(before[:, 0], before[:, 1]) + score
    beta = np.zeros((n, 2))
    log_z = np.zeros(n)
    for t in range(longest):
        ending = lengths[: active[t]] == t + 1
        log_z[: active[t]][ending] = np.logaddexp(alpha[t][ending, 0], alpha[t][ending, 1])
    good = np.zeros(len(flat))
    pairs = np.zeros((2, 2))
    for t in range(longest - 1, -1, -1):
        k = active[t]
        good[starts[:k] + t] = np.exp(alpha[t][:, 1] + beta[:k, 1] - log_z[:k])
        if t:
            after = potential[t] + beta[:k]
            joint = alpha[t - 1][:k, :, None] + transition + after[:, None, :] - log_z[:k, None, None]
            pairs += np.exp(joint).sum(0)
            moved = transition + after[:, None, :]
            beta[:k] = np.logaddexp(moved[:, :, 0], moved[:, :, 1])
    chances: list[np.ndarray] = [np.zeros(0)] * n
    for place, i in enumerate(order):
        chances[i] = good[starts[place] : starts[place + 1]]
    return chances, pairs, float(log_z.sum())


@dataclass
class QualityField:
    """Weights of the good state, transitions, and the scale of the features."""

    weights: np.ndarray
    transition: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def unary(self, features: np.ndarray) -> np.ndarray:
        return ((features - self.mean) / self.spread) @ self.weights

    def line_chances(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(chance of good, length) of every line of every text."""
        made = [line_features(t) for t in texts]
        chances, _, _ = marginals([self.unary(f) for f, _ in made], self.transition)
        return [(c, length) for c, (_, length) in zip(chances, made, strict=True)]

    def scores(self, texts: list[str]) -> list[float]:
        """Length-weighted means of the line chances; where all lines are empty, their plain mean."""
        return [
            float(min(1.0, max(0.0, chance @ length / length.sum() if length.any() else chance.mean())))
            for chance, length in self.line_chances(texts)
        ]


def train(documents: list[np.ndarray], labels: list[int], steps: int = STEPS) -> QualityField:
    """Maximise the penalised likelihood by Adam; both labels weigh the same in all.

    Without documents of both labels the field scores by their share alone.
    """
    if not documents:
        flat = np.zeros(N_FEATURES)
        return QualityField(flat, np.zeros((2, 2)), flat, np.ones(N_FEATURES))
    lines = np.vstack(documents)
    mean, spread = lines.mean(0), lines.std(0) + 1e-3
    mean[-1], spread[-1] = 0.0, 1.0
    scaled = [(d - mean) / spread for d in documents]
    stacked = np.vstack(scaled)
    ends = np.cumsum([len(d) for d in documents])[:-1]
    target = np.repeat(labels, [len(d) for d in documents])
    inner = np.array([len(d) - 1 for d in documents])
    observed = np.diag([inner[np.array(labels) == y].sum() for y in (0, 1)]).astype(float)
    theta = np.zeros(N_FEATURES + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        weights, transition = theta[:-4], theta[-4:].reshape(2, 2)
        chances, pairs, _ = marginals(np.split(stacked @ weights, ends), transition)
        gradient = np.concatenate([stacked.T @ (np.concatenate(chances) - target), (pairs - observed).ravel()])
        gradient = gradient / len(target) + PENALTY * theta
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        theta -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return QualityField(theta[:-4], theta[-4:].reshape(2, 2), mean, spread)


def is_held_out() -> Column:
    return F.pmod(unsigned_crc32("doc_id"), F.lit(5)) == 0


def _sampled_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = arrow_schema("place string, quality int, lines int, features array<float>")
    for batch in batches:
        rows = []
        for text, quality, place in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            features, _ = line_features(text or "")
            rows.append((place, quality, len(features), features.astype(np.float32).ravel()))
        yield record_batch(schema, rows)


def fit(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> QualityField:
    """A field trained on about ``per_label`` documents of each quality, drawn by digest.

    Held-out documents are never among them. A document with several labels has the
    lowest; labels other than 0 and 1, and those of unknown documents, are passed over.
    """
    known = labels.where(labels["quality"].isin(0, 1) & labels["doc_id"].isNotNull() & ~is_held_out())
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    sizes = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    place = order_key("doc_id", seed="quality")
    draw = F.conv(F.substring(place, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    share = F.lit(0.0)
    for quality, n in sizes.items():
        share = F.when(F.col("quality") == quality, min(1.0, per_label / n)).otherwise(share)
    drawn = known.where(draw < share).select(F.col("doc_id").alias("drawn_id"), "quality", place.alias("place"))
    # the draw holds about 2 * per_label small rows
    texts = docs.select(docs["doc_id"], docs["text"]).join(
        F.broadcast(drawn), F.col("doc_id") == F.col("drawn_id")
    )
    sample = map_batches(
        texts.select("text", "quality", "place"),
        _sampled_features, "place string, quality int, lines int, features array<float>"
    )
    rows = sorted(sample.toArrow().to_pylist(), key=lambda r: (r["place"], r["lines"], r["features"][:N_LINE]))
    documents = [np.array(r["features"], np.float64).reshape(r["lines"], N_FEATURES) for r in rows]
    return train(documents, [r["quality"] for r in rows])


def score(docs: DataFrame, field: QualityField) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs``.

    Only the text is looked at. A null text counts as empty, an empty text is one
    empty line, and a null doc_id counts as the empty key for ``held_out``.
    """
    schema = arrow_schema(SCORED)
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SCORED_TOGETHER):
            ids, held, texts = (batch.column(i).to_pylist() for i in range(3))
            scores = shared.value.scores([t or "" for t in texts])
            predicted = [int(s >= KEEP_AT) for s in scores]
            yield record_batch(schema, list(zip(ids, held, scores, predicted, strict=True)))

    rows = docs.select(docs["doc_id"].cast("long"), is_held_out().alias("held_out"), docs["text"])
    return map_batches(rows, scored, SCORED)


def of_good_quality(docs: DataFrame, field: QualityField) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``KEEP_AT``; columns unchanged.

    The rows pass through the tasks that score them, so no text is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SCORED_TOGETHER):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            scores = shared.value.scores([t or "" for t in texts])
            yield batch.filter(pa.array([s >= KEEP_AT for s in scores]))

    return map_batches(docs, kept, docs.schema)
