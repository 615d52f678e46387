"""SimHash links against all pairs."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from odd import ODD

from tablewright.llm import simhash_links
from tablewright.llm.components import connected_components
from tablewright.llm.simhash_links import allocate, choose_plan, fingerprint


def plain_print(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    k = min(4, len(words))
    hashes = [xxhash.xxh64(" ".join(words[i : i + k]).encode(), seed=42).intdigest() for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def expected(pairs):
    prints = [plain_print(t) for _, t in pairs]
    close = [
        (i, j) for i in range(len(pairs)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4
    ]
    root = roots(len(pairs), close)
    least = {}
    for r, (id_, _) in zip(root, pairs, strict=True):
        ids = [x for x in (least.get(r), id_) if x is not None]
        least[r] = min(ids) if ids else None
    return sorted(
        ((id_, f"{p:016x}", least[r]) for (id_, _), p, r in zip(pairs, prints, root, strict=True)), key=repr
    )


def near_copies(seed, n):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    bases = [[draw.choice(vocabulary) for _ in range(150)] for _ in range(6)]
    made = []
    for i in range(n):
        words = list(draw.choice(bases))
        for _ in range(draw.randint(0, 3)):
            words[draw.randrange(150)] = draw.choice(vocabulary)
        made.append((i * 3 + 1, " ".join(words)))
    return made


@pytest.mark.parametrize("text", [t for _, t in ODD if t is None or len(t) < 1000] + ["A b c", "Éa B c d e"])
def test_fingerprints(text):
    assert fingerprint(text) % 2**64 == plain_print(text)


def test_fingerprint_in_chunks(monkeypatch):
    text = " ".join(f"w{i * i % 97}" for i in range(1000))
    monkeypatch.setattr(simhash_links, "CHUNK", 64)
    assert fingerprint(text) % 2**64 == plain_print(text)


@pytest.mark.parametrize("seed", [1, 2])
def test_components_are_those_of_all_pairs(documents, seed):
    pairs = near_copies(seed, 150)
    rows = simhash_links.near_duplicates(documents(pairs)).collect()
    assert sorted((tuple(r) for r in rows), key=repr) == expected(pairs)


def test_odd_rows(odd, empty):
    rows = simhash_links.near_duplicates(odd).collect()
    assert sorted((tuple(r) for r in rows), key=repr) == expected(ODD)
    assert simhash_links.near_duplicates(empty).collect() == []


def test_one_row_of_each_group_stays(odd):
    left = simhash_links.one_of_each_group(odd)
    assert left.columns == odd.columns
    components = {r["component_id"] for r in simhash_links.near_duplicates(odd).collect()}
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(components)


def test_one_row_of_every_component_stays_whatever_its_id(documents):
    draw = random.Random(11)
    text = lambda n: " ".join(f"v{draw.randrange(5000)}" for _ in range(n))
    anonymous = [text(60) for _ in range(5)]
    shared_a, shared_b = text(60), text(90)
    pairs = [(None, t) for t in anonymous]
    pairs += [(None, anonymous[0].upper()), (None, anonymous[1] + "\n\n")]  # near copies without id: the longer stays
    pairs += [(5, shared_a), (8, shared_a), (5, shared_b), (9, shared_b), (3, anonymous[2])]
    rows = [(r["doc_id"], r["text"]) for r in simhash_links.one_of_each_group(documents(pairs)).collect()]
    least = min(anonymous[0], anonymous[0].upper(), key=lambda t: hashlib.md5(t.encode()).hexdigest())
    assert sorted(rows, key=repr) == sorted(
        [(None, least), (None, anonymous[1] + "\n\n"), (3, anonymous[2]), (None, anonymous[3]), (None, anonymous[4])]
        + [(5, shared_a), (5, shared_b)],
        key=repr,
    )


@pytest.mark.parametrize("n", [10, 10**4, 10**6, 10**9])
def test_any_plan_finds_every_pair(n):
    draw = np.random.default_rng(n)
    plan = choose_plan(draw.integers(0, 2**63, 200, dtype=np.uint64), n)
    assert sum(plan.thresholds) == 4 - len(plan.masks) + 1
    assert sum(plan.masks) == 2**64 - 1
    for _ in range(300):
        x = sum(1 << int(b) for b in draw.choice(64, draw.integers(0, 5), replace=False))
        assert any((x & m).bit_count() <= t for m, t in zip(plan.masks, plan.thresholds, strict=True))


def test_allocation_is_the_least_of_all():
    draw = random.Random(5)
    for _ in range(50):
        costs = [[draw.random() for _ in range(4)] for _ in range(3)]
        from itertools import product

        least = min(
            sum(row[t + 1] for row, t in zip(costs, ts, strict=True)) for ts in product(range(-1, 3), repeat=3) if sum(ts) == 2
        )
        assert abs(allocate(costs, 2)[0] - least) < 1e-12


def test_connected_components(spark):
    draw = random.Random(7)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(170)] + [(400 + i, 401 + i) for i in range(60)]
    root = roots(600, links)
    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert found == {x: root[x] for x in linked}
