"""Samples, positions and pairs: sizes, membership, independence of the partitioning."""

import hashlib
import math

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tablewright.operators import budget, preference, ranking


def digest(*keys):
    written = [f":{k}" for k in keys] if len(keys) == 1 else [f":{len(str(k))}:{k}" for k in keys]
    return hashlib.md5(("42" + "".join(written)).encode()).hexdigest()


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000])
@pytest.mark.parametrize("digits", [1, 4])
def test_sample_is_exact(spark, n, digits):
    got = ranking.sample_fraction(spark.range(n), ["id"], 0.7, digits=digits)
    expected = sorted(range(n), key=digest)[: n - math.ceil(0.7 * n)]
    assert sorted(r.id for r in got.collect()) == sorted(expected)


@pytest.mark.parametrize("partitions", [1, 7])
def test_results_do_not_depend_on_partitions(spark, partitions):
    df = spark.range(500).repartition(partitions)
    sample = {r.id for r in ranking.sample_fraction(df, ["id"]).collect()}
    assert sample == set(sorted(range(500), key=digest)[:150])
    capped = {r.id for r in ranking.sample_cap(df, ["id"], 20).collect()}
    assert capped == set(sorted(range(500), key=digest)[:20])
    positions = {r.id: r.position for r in ranking.with_position(df, ["id"]).collect()}
    assert positions == {i: p for p, i in enumerate(sorted(range(500), key=digest))}


def test_shuffle_is_a_permutation_in_order(spark):
    rows = [r.id for r in ranking.shuffled(spark.range(300), ["id"]).collect()]
    assert rows == sorted(range(300), key=digest)


def test_cap_keeps_smaller_inputs_whole(spark):
    assert ranking.sample_cap(spark.range(10), ["id"], 20).count() == 10


def test_batch_plan(spark):
    plan = budget.batch_plan(spark.range(70), ["id"], epochs=2, batch_rows=4, accumulation=8).collect()
    for epoch in (0, 1):
        rows = sorted((r for r in plan if r.epoch == epoch), key=lambda r: r.position)
        assert [r.id for r in rows] == sorted(range(70), key=lambda i: digest(epoch, i))
        assert [r.step for r in rows] == [p // 32 for p in range(70)]
        assert [r.micro_batch for r in rows] == [p % 32 // 4 for p in range(70)]


def test_rejected_is_never_the_label_and_every_other_ending_occurs(spark, views):
    rows = (
        spark.range(400)
        .select("id", F.lit("c").alias("ctx"), F.expr("array('0','1','2','3')").alias("endings"),
                (F.col("id") % 4).cast("string").alias("label"))
    )
    got = preference.preference_pairs(rows, "id").collect()
    assert all(r.chosen == str(r.id % 4) and r.rejected != r.chosen for r in got) and len(got) == 400
    assert len({(r.chosen, r.rejected) for r in got}) == 12


def test_length_limits(spark):
    df = spark.createDataFrame([(1, "a b  c\nd"), (2, ""), (3, None)], "id int, text string")
    got = {r.id: r for r in budget.limit_length(df, limit=3).collect()}
    assert (got[1].n_tokens, got[1].n_cut, got[1].kept) == (4, 1, "a b  c")
    assert got[1].kept == "a b  c"
    assert (got[2].n_tokens, got[2].n_cut, got[2].kept) == (0, 0, "")
    whole = budget.limit_length(df, limit=4).where("id = 1").head()
    assert whole.kept == whole.text
    letters = budget.limit_length(df, limit=3, tokens=lambda t: F.split(t, "")).where("id = 1").head()
    assert letters.n_tokens == 8


@pytest.mark.parametrize("cap", [1, 2, 3, 5])
def test_keys_with_nulls_and_colons_count_apart(spark, cap):
    rows = [(None, "c"), ("c", None), ("a:b", "c"), ("a", "b:c"), (None, None), ("", "")]
    df = spark.createDataFrame(rows, "x string, y string")
    assert ranking.sample_cap(df, ["x", "y"], cap).count() == cap
    assert ranking.sample_fraction(df, ["x", "y"], 0.5).count() == 3


def test_cap_has_no_one_task_funnel(spark):
    plan = ranking.sample_cap(spark.range(100), ["id"], 5)._jdf.queryExecution().toString()
    assert "TakeOrdered" not in plan


def test_pairs_are_cut_and_not_respaced(spark):
    rows = [(1, "p1  p2\np3 ", "c1 c2\tc3", "r1"), (2, "short", "a  b", "")]
    df = spark.createDataFrame(rows, "id int, prompt string, chosen string, rejected string")
    got = {r.id: tuple(r)[1:] for r in budget.cut_pair(df, prompt_limit=2, limit=4).collect()}
    assert got == {1: ("p2\np3 ", "c1 c2", "r1"), 2: ("short", "a  b", "")}


def test_long_texts_are_cut(spark):
    df = spark.createDataFrame([("w  " * 30000,)], "text string")
    row = budget.limit_length(df).head()
    assert row.n_cut == 30000 - 2048 and row.kept == ("w  " * 2048).rstrip()


def test_equal_rows_fill_several_ranges(spark):
    """One text a hundred thousand times is put in order by all tasks."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        df = spark.range(100_500, numPartitions=8).select(
            F.when(F.col("id") < 100_000, "same").otherwise(F.col("id").cast("string")).alias("k")
        )
        placed = ranking.with_position(df, ["k"])
        written = {f.removeprefix("file://") for f in placed.inputFiles()}
        per_range = [n for n in (pq.ParquetFile(f).metadata.num_rows for f in written) if n]
    finally:
        spark.conf.set(name, before)
    assert len(per_range) == 8 and max(per_range) < 2 * 100_500 / 8
    rows = placed.collect()
    assert sorted(r.position for r in rows) == list(range(100_500))
    same = sorted(r.position for r in rows if r.k == "same")
    assert same == list(range(same[0], same[0] + 100_000))
    by_digest = sorted({r.k for r in rows}, key=digest)
    assert [r.k for r in sorted(rows, key=lambda r: r.position) if r.k != "same"] == [k for k in by_digest if k != "same"]


def test_positions_within_groups_and_odd_names(spark):
    rows = [(g, i, i % 2) for g in ("a", "b", None) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, _h int, _row int").repartition(3)
    got = ranking.with_position(df, ["_h"], within=["g"]).collect()
    for g in ("a", "b", None):
        assert sorted(r.position for r in got if r.g == g) == list(range(40))
    assert ranking.with_position(df.where("false"), ["_h"]).collect() == []


@pytest.mark.parametrize("cap", [1, 500, 3000, 9_000, 10_050])
def test_samples_of_repeated_keys(spark, cap):
    """The counts show that the last row is not where uniform digests would have it."""
    df = spark.range(10_000).select(F.lit("often").alias("k")).unionByName(spark.range(100).select(F.col("id").cast("string").alias("k")))
    kept = [r.k for r in ranking.sample_cap(df, ["k"], cap).collect()]
    ordered = sorted(["often"] * 10_000 + [str(i) for i in range(100)], key=digest)
    last = digest(ordered[cap - 1])
    assert sorted(kept) == sorted(k for k in ordered if digest(k) <= last)
