"""Best-fit-decreasing packing and gapless slots."""

import random
import zlib
from collections import defaultdict

import pytest
from odd import ODD

from tablewright.llm import shard_packing
from tablewright.llm.shard_packing import best_fit_decreasing, near_equal


def plain_best_fit(sizes, capacity):
    left, bins = [], []
    for size in sizes:
        fits = [(r, i) for i, r in enumerate(left) if r >= size]
        if fits:
            _, i = min(fits)
        else:
            left.append(max(capacity, size))
            i = len(left) - 1
        left[i] -= size
        bins.append(i)
    return bins


def test_tree_packs_like_a_plain_scan():
    draw = random.Random(3)
    for _ in range(30):
        sizes = sorted((draw.randint(1, 60) for _ in range(draw.randint(0, 200))), reverse=True)
        assert best_fit_decreasing(sizes, 50) == plain_best_fit(sizes, 50)


def test_near_equal_uses_no_more_bins_and_balances():
    draw = random.Random(4)
    sizes = sorted((draw.randint(1, 100) for _ in range(3000)), reverse=True)
    bins = near_equal(sizes, 40)
    loads = [0] * 40
    for size, b in zip(sizes, bins, strict=True):
        loads[b] += size
    assert max(loads) <= 1.01 * sum(sizes) / 40


def test_a_group_beyond_a_fair_share_is_alone():
    bins = near_equal([1000, 10, 10, 10, 10], 3)
    assert bins.count(bins[0]) == 1 and set(bins) == {0, 1, 2}
    assert near_equal([], 3) == [] and near_equal([5], 1) == [0]


def test_shards(documents):
    pairs = [*ODD, *[(100 + i, "copy" * 50) for i in range(400)], *[(600 + i, f"text {i} " * (i % 9)) for i in range(900)]]
    rows = shard_packing.shards(documents(pairs), 7).collect()
    assert len(rows) == len(pairs)
    shard_of, slots, loads = {}, defaultdict(list), defaultdict(int)
    text_of = defaultdict(set)
    for id_, text in pairs:
        text_of[id_].add(text or "")
    for r in rows:
        matching = [t for t in text_of[r["doc_id"]] if len(t.encode()) + 16 == r["size"]]
        assert matching and r["text_crc32"] in {zlib.crc32(t.encode()) for t in matching}
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 7
        assert shard_of.setdefault((r["size"], r["text_crc32"]), r["shard"]) == r["shard"]
        slots[r["shard"]].append(r["slot"])
        loads[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # the long text and the copies are larger than a share; the others are even
    rest = sorted(loads.values())[:-2]
    assert max(rest) <= 1.05 * min(rest)


def test_empty_table_and_bounds(empty):
    assert shard_packing.shards(empty).collect() == []
    with pytest.raises(ValueError):
        shard_packing.shards(empty, 0)
