"""Runs of repeated words against a look at every period, and what is left of the texts."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from odd import ODD

from tablewright.llm import periodic_runs
from tablewright.llm.common import table
from tablewright.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words, least=24):
    found = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 3 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def as_rows(runs):
    return list(zip(runs.start.tolist(), runs.length.tolist(), runs.period.tolist()))


def repetitive(draw):
    """Words with repeats inside repeats, cut and disturbed."""
    if draw.random() < 0.3:
        return draw.choices([0, 1], k=draw.randint(0, 260))
    words = draw.choices(range(draw.choice([2, 50])), k=draw.randint(0, 30))
    for _ in range(draw.randint(1, 4)):
        base = draw.choices(range(draw.choice([1, 2, 50])), k=draw.randint(1, 40))
        if draw.random() < 0.5:
            inner = draw.choices(range(3), k=draw.randint(1, 4)) * draw.randint(1, 20)
            base = base[: draw.randint(0, 20)] + inner + base[20:]
        words += (base * 6)[: draw.randint(1, 5 * len(base))]
        if draw.random() < 0.2:
            words[draw.randrange(len(words))] = 9
    return (words * 3 if draw.random() < 0.2 else words)[:900]


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_a_look_at_every_period(seed):
    draw = random.Random(seed)
    for _ in range(250):
        words = repetitive(draw)
        assert as_rows(periodic_runs.runs_of(np.array(words, np.int64))) == plain_runs(words)


def test_fibonacci_and_thue_morse_words():
    a, b = [0], [0, 1]
    while len(b) < 800:
        a, b = b, b + a
    assert as_rows(periodic_runs.runs_of(np.array(b))) == plain_runs(b) != []
    morse = [bin(i).count("1") % 2 for i in range(800)]
    assert as_rows(periodic_runs.runs_of(np.array(morse))) == plain_runs(morse) == []


@pytest.mark.parametrize("period", [1, 2, 11, 12, 13, 23, 24, 47, 48, 100, 333])
def test_one_run_of_each_length(period):
    for length in (3 * period - 1, 3 * period, 3 * period + 1, 5 * period):
        body = [i % period for i in range(length)]
        words = [1000, 1001, *body, 1002]
        expected = [(2, length, period)] if length >= max(24, 3 * period) else []
        assert as_rows(periodic_runs.runs_of(np.array(words))) == expected


def plain_row(doc_id, text):
    """The contract, word for word."""
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (len(runs), *shown, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_query_equals_the_contract(spark, folder):
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op13_periodic_runs"](spark, folder).collect()}
    docs = table(spark, folder, "documents").select("doc_id", "text").collect()
    small = [r for r in docs if len(WORD.findall(r["text"] or "")) <= 2500]
    assert len(small) > 0.9 * len(docs) and set(got) == {r["doc_id"] for r in docs}
    assert all(got[r["doc_id"]] == plain_row(r["doc_id"], r["text"]) for r in small)
    assert sum(row[0] > 0 for row in got.values()) > 0.05 * len(got)


def test_odd_rows(odd, empty):
    rows = periodic_runs.run_digests(odd).collect()
    assert len(rows) == len(ODD)
    found = {r["doc_id"]: r for r in rows}
    assert tuple(found[8])[1:6] == (1, 0, 30000, 1, 30_000_000)
    assert found[3]["n_runs"] == 0 and found[3]["start"] is None
    assert found[3]["collapsed_sha256"] == found[5]["collapsed_sha256"] == hashlib.sha256(b"").hexdigest()
    assert periodic_runs.run_digests(empty).collect() == []


def test_texts_without_repeats(documents):
    texts = [(1, "a b c " * 20 + "d"), (2, "x y"), (3, None), (4, " ".join(f"w{i % 30}" for i in range(95)))]
    rows = {r["doc_id"]: (r["text"], r["n_runs"]) for r in periodic_runs.without_repeats(documents(texts), "doc_id").collect()}
    assert rows == {1: ("a b c d", 1), 2: ("x y", 0), 3: ("", 0), 4: (" ".join(f"w{i}" for i in range(30)), 1)}


def test_texts_are_kept_apart():
    """Texts worked on together give what each gives alone."""
    draw = random.Random(9)
    texts = [" ".join(map(str, repetitive(draw))) for _ in range(40)] + ["", " \n", "a " * 30]
    together = [(r.words, as_rows(r.runs)) for r in periodic_runs.reports(pa.array(texts))]
    alone = [(r.words, as_rows(r.runs)) for t in texts for r in periodic_runs.reports(pa.array([t]))]
    assert together == alone


def test_long_texts_take_little_time():
    import time

    start = time.time()
    for text in ("word " * 200_000, " ".join(f"w{i % 5000}" for i in range(200_000)), " ".join(f"w{i * i % 99991}" for i in range(200_000))):
        list(periodic_runs.reports(pa.array([text])))
    assert time.time() - start < 60
