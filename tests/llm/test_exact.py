"""Exact de-duplication against plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from odd import ODD
from pyspark.sql import functions as F

from tablewright.llm import exact_index

BLANKS = re.compile(r"[\x20\x09-\x0D]")


def expected(pairs):
    groups = defaultdict(list)
    for id_, text in pairs:
        groups[BLANKS.sub("", text or "")].append((id_, text or ""))
    rows = []
    for plain, members in groups.items():
        best = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        kept = False
        for m in members:
            stays = m == best and not kept
            kept |= stays
            rows.append((m[0], best[0], len(members), stays, hashlib.sha256(plain.encode()).hexdigest()))
    return Counter(rows)


def found(df):
    return Counter(tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())


def test_odd_rows(odd):
    assert found(exact_index.exact_groups(odd)) == expected(ODD)


@pytest.mark.parametrize("bits", [0, 3])
def test_collisions_are_told_apart_by_their_bytes(documents, bits):
    pairs = [(i, f"text {i % 40}" + " " * (i % 3)) for i in range(300)]
    df = documents(pairs).repartition(7)
    few = lambda plain: F.xxhash64(plain).bitwiseAND(F.lit((1 << bits) - 1))
    assert found(exact_index.exact_groups(df, hash_of=few, capacity=4)) == expected(pairs)


def test_entries_are_written_before_memory_fills(documents):
    pairs = [(i, f"text {i % 5}") for i in range(100)]
    assert found(exact_index.exact_groups(documents(pairs), held_bytes=300)) == expected(pairs)


def test_empty_table(empty):
    assert exact_index.exact_groups(empty).collect() == []
    assert exact_index.without_repeats(empty).columns == empty.columns


def test_rows_left_are_whole_and_unique(odd):
    left = exact_index.without_repeats(odd)
    assert left.columns == odd.columns
    texts = [BLANKS.sub("", r["text"] or "") for r in left.collect()]
    assert sorted(texts) == sorted({BLANKS.sub("", t or "") for _, t in ODD})


def test_directory_doubles_until_buckets_fit():
    cells = np.zeros(1 << 16, np.int64)
    cells[:8] = 10
    made = exact_index.Directory.grown(cells, capacity=10)
    assert made.depth == 16 and len(made.slots) == 1 << 16
    hashes = (np.arange(8, dtype=np.uint64) << np.uint64(48)).view(np.int64)
    assert len(set(made.bucket(hashes).tolist())) == 8
    # every slot names the bucket whose prefix it has
    for slot in range(0, 1 << 16, 999):
        prefix, local = made.buckets[made.slots[slot]]
        assert slot >> (16 - local) == prefix


def test_an_overfull_deepest_bucket_overflows():
    cells = np.zeros(1 << 16, np.int64)
    cells[5] = 1000
    assert exact_index.Directory.grown(cells, capacity=10).depth == 16
