"""Benchmark passages against alignments over whole documents."""

import random

import numpy as np
import pytest
from odd import ODD

from tablewright.llm.decontamination import align, contaminated, without_benchmark, words_of

ITEMS = "item_id long, text string, doc_id long, score double, `start` long"


def plain_points(item, passage):
    table = np.zeros((len(item) + 1, len(passage) + 1), int)
    for i, a in enumerate(item, 1):
        for j, b in enumerate(passage, 1):
            table[i, j] = max(
                0, table[i - 1, j - 1] + (2 if a == b else -1), table[i - 1, j] - 1, table[i, j - 1] - 1
            )
    return table.max()


def test_alignment_points():
    draw = np.random.default_rng(2)
    for _ in range(200):
        item, passage = draw.integers(0, 5, draw.integers(1, 12)), draw.integers(0, 5, draw.integers(0, 30))
        points, start, end = align(item, passage)
        assert points == plain_points(item, passage)
        assert 0 <= start <= end <= len(passage)
        if points:
            # the place alone gives the same points
            assert plain_points(item, passage[start:end]) == points


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)]
    text = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    items = [(i, text(draw.randint(14, 50))) for i in range(12)]
    docs = []
    for i in range(120):
        words = text(draw.randint(5, 300))
        if i % 3 == 0:
            _, item = draw.choice(items)
            item = list(item)
            for _ in range(len(item) * (i % 5) // 12):
                item[draw.randrange(len(item))] = "edited"
            at = draw.randrange(len(words))
            words[at:at] = item
        docs.append((i, " ".join(words)))
    return docs, [(i, " ".join(w).capitalize() + ".") for i, w in items]


def items_of(spark, items):
    return spark.createDataFrame([(*i, 1, 1.0, 2) for i in items], ITEMS)


@pytest.mark.parametrize("block_bytes", [10, 1 << 20])
def test_hits_are_those_of_whole_alignments(spark, documents, corpus, block_bytes):
    docs, items = corpus
    rows = contaminated(documents(docs), items_of(spark, items), block_bytes=block_bytes).collect()
    expected = {}
    for d, text in docs:
        for i, item in items:
            a, b = words_of(item), words_of(text)
            score = plain_points(a, b) / (2 * len(a)) if len(set(a) & set(b)) > 2 else 0
            if score >= 0.5:
                expected[d, i] = score
    assert len(expected) >= 30
    assert {(r["doc_id"], r["item_id"]): r["score"] for r in rows} == pytest.approx(expected)


def test_edited_copy_of_a_passage_that_many_documents_hold(spark, documents):
    words = [f"q{i}" for i in range(15)]
    edited = [f"edit{i}" if i in (2, 5, 8, 9) else w for i, w in enumerate(words)]
    docs = [(i, f"some text {i} " + " ".join(words)) for i in range(300)] + [(300, "else " + " ".join(edited) + " end")]
    item = items_of(spark, [(1, " ".join(words))])
    rows = {r["doc_id"]: r["score"] for r in contaminated(documents(docs), item).collect()}
    assert rows == pytest.approx({i: 1.0 for i in range(300)} | {300: 0.6})
    assert without_benchmark(documents(docs), item).collect() == []


def test_documents_left(spark, documents, corpus):
    docs, items = corpus
    df = documents(docs)
    hit = {r["doc_id"] for r in contaminated(df, items_of(spark, items)).collect()}
    left = without_benchmark(df, items_of(spark, items))
    assert left.schema == df.schema and {r["doc_id"] for r in left.collect()} == {d for d, _ in docs} - hit


def test_odd_rows(spark, odd, empty):
    items = items_of(spark, [(1, None), (2, ""), (None, "one two three four five"), (3, "One, two; THREE four five"), (4, "中文"), (5, "no id")])
    rows = {(r["doc_id"], r["item_id"], r["score"]) for r in contaminated(odd, items).collect()}
    assert rows == {(1, 3, 1.0), (2, 3, 1.0), (7, 3, 1.0), (6, 4, 1.0), (None, 5, 1.0), (10, 5, 1.0)}
    assert contaminated(empty, items).collect() == []
    assert contaminated(odd, items.limit(0)).collect() == []
