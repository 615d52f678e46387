"""Hard negatives against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import negative_mining as mining

ROWS = "vec_id long, embedding array<float>, label int, score double, row int, anchor string"


def plain(rows, percent=80, best=5, every=100):
    """(id, label, vector) rows by way of all scores."""
    found = []
    for i, (anchor, label, v) in enumerate(rows):
        if anchor is None or anchor % every:
            continue
        scored = sorted(
            ((-sum(a * b for a, b in zip(v, w)), other, same == label) for j, (other, same, w) in enumerate(rows) if j != i),
            key=lambda s: s[:2],
        )
        for score, positive, _ in [s for s in scored if s[2]][:best]:
            band = [(n, -s) for s, n, same in scored if not same and percent * -score <= 100 * -s <= 100 * -score]
            found += [(anchor, positive, k + 1, n, -score, s) for k, (n, s) in enumerate(band[:best])]
    return sorted(found)


def whole(rows):
    return [(i, label, [int(np.floor(256 * np.float64(np.float32(x)))) for x in e]) for i, e, label in rows]


def mined(spark, rows, **limits):
    table = spark.createDataFrame([(i, e, label, 0.5, 7, "x") for i, e, label in rows], ROWS)
    given = mining.whole_vectors(table, "vec_id", F.col("label"), "embedding")
    return sorted(map(tuple, mining.hard_negatives(given, F.col("id") % 100 == 0, **limits).collect()))


def some_rows(seed, n, width, labels=3, copies=0):
    draw = np.random.default_rng(seed)
    vectors = draw.normal(size=(n, width)).astype(np.float32)
    vectors[: n // 2] += 1.5 * draw.normal(size=width)
    for k in range(copies):
        vectors[draw.integers(n)] = vectors[0]
    return [(i, vectors[i].tolist(), int(draw.integers(labels))) for i in range(n)]


@pytest.mark.parametrize("width", [1, 3, 64, 70, 200])
def test_equal_to_all_pairs(spark, width):
    rows = some_rows(width, 420, width)
    assert mined(spark, rows, slab_rows=10, block_rows=2) == plain(whole(rows)) != []


def test_ties_and_copies(spark):
    rows = some_rows(5, 400, 8, labels=2, copies=150)
    assert mined(spark, rows) == plain(whole(rows))
    flat = [(i, [0.0, 0.0], i % 2) for i in range(300)]  # every score is 0
    assert mined(spark, flat) == plain(whole(flat))


def test_other_bounds(spark):
    rows = some_rows(6, 350, 16)
    assert mined(spark, rows, positives=2, negatives=3, percent=50, stages=1) == [
        r for r in plain(whole(rows), percent=50, best=5) if r[2] <= 3 and r[1] in {p[1] for p in plain(whole(rows), 50, 2) if p[0] == r[0]}
    ]


def test_rows_that_take_no_part(spark):
    rows = some_rows(7, 300, 4)
    odd = [(300, [1.0, float("nan"), 0.0, 0.0], 1), (301, [float("inf")] * 4, 1), (302, None, 1), (303, [1.0, None, 0.0, 1.0], 1), (304, [2.0] * 4, None), (None, [1.0] * 4, 1)]
    assert mined(spark, rows + odd) == plain(whole(rows))


def test_shorter_vectors_and_repeated_rows(spark):
    rows = some_rows(8, 250, 6)
    rows[3] = (3, rows[3][1][:2], 1)
    rows[100] = (100, [], 2)
    rows += [rows[0], rows[0], rows[17], rows[17]]
    padded = [(i, label, v + [0] * (6 - len(v))) for i, label, v in whole(rows)]
    assert mined(spark, rows) == plain(padded)


def test_no_rows_and_no_anchors(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []


def test_large_numbers(spark):
    rows = [(i, [float((i * 7919) % 1000 - 500) * 1200.0, float(i)], i % 3) for i in range(250)]
    assert mined(spark, rows) == plain(whole(rows))  # sums beyond 53 bits
    with pytest.raises(ValueError, match="64 bits"):
        mined(spark, [(0, [1e30], 1), (1, [1.0], 1)])


def test_bounds_hold_the_score():
    draw = np.random.default_rng(3)
    for width in (5, 64, 130):
        turns = mining.rotations(width)
        q, v = draw.integers(-300, 300, (20, width)), draw.integers(-300, 300, (500, width))
        codes, alignments, rest = mining.code(v, turns)
        norms = np.linalg.norm(v, axis=1)
        low, high = mining.Anchors(q, turns).bounds(np.arange(20), codes, alignments, rest, norms)
        score = q @ v.T
        assert (low <= score).all() and (score <= high).all()
        assert (high - low).mean() < 0.6 * (np.linalg.norm(q, axis=1)[:, None] * norms).mean()


def test_a_hot_label_is_spread(spark):
    """Rows are dealt by their number, so one label or vector does not fill a task."""
    rows = spark.range(4000).select("id", F.lit(1).alias("label"), F.expr("array(3L, 4L)").alias("vector"))
    cells = rows.withColumn("row", F.monotonically_increasing_id()).groupBy(F.pmod(F.xxhash64("row"), F.lit(16))).count()
    sizes = [r["count"] for r in cells.collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * 4000 / 16
