"""Results of a model are replaced as a whole, and inspection and chats of odd tables."""

import json

import pytest
from pyspark.sql import functions as F
from tablewright.operators import chat, inspection
from tablewright.sources import manifests, sinks

SCHEMA = "model string, x long"


def rows(spark, pairs):
    return spark.createDataFrame(pairs, SCHEMA).repartition(2)


def held(spark, path, models=None):
    return sorted(map(tuple, sinks.read_detail(spark, str(path), SCHEMA, models).collect()))


def test_a_model_is_replaced_and_others_stay(spark, tmp_path):
    path = tmp_path / "detail"
    sinks.write_detail(rows(spark, [("a", 1), ("a", 2), ("b", 3), ("c d/e=f", 4)]), str(path))
    sinks.write_detail(rows(spark, [("a", 9)]), str(path))
    assert held(spark, path) == [("a", 9), ("b", 3), ("c d/e=f", 4)]
    assert held(spark, path, ["c d/e=f"]) == [("c d/e=f", 4)] and held(spark, path, ["none"]) == []
    # also without the manifests
    assert sorted(r.x for r in spark.read.json(str(path)).collect()) == [3, 4, 9]


def test_a_model_without_rows_has_none(spark, tmp_path):
    path = tmp_path / "detail"
    sinks.write_detail(rows(spark, [("a", 1), ("b", 3)]), str(path))
    sinks.write_detail(rows(spark, []), str(path), ["a"])
    assert held(spark, path) == [("b", 3)] and held(spark, path, ["a"]) == []
    sinks.write_detail(rows(spark, []), str(path))
    assert held(spark, path) == [("b", 3)]
    sinks.write_detail(rows(spark, []), str(tmp_path / "new"), ["a"])
    assert held(spark, tmp_path / "new") == []


@pytest.mark.parametrize("step", ["move", "replace", "delete"])
def test_a_write_that_breaks_off_leaves_whole_results(spark, tmp_path, monkeypatch, step):
    path = tmp_path / "detail"
    sinks.write_detail(rows(spark, [("a", 1), ("a", 2)]), str(path))
    real, calls = getattr(manifests.Files, step), []

    def breaks(self, *args):
        calls.append(args)
        if step == "move" and len(calls) == 1:
            return real(self, *args)  # one file is moved, the next is not
        raise OSError("the store is gone")

    with monkeypatch.context() as patched:
        patched.setattr(manifests.Files, step, breaks)
        with pytest.raises(OSError, match="gone"):
            sinks.write_detail(rows(spark, [("a", 8), ("a", 9), ("a", 10)]), str(path))
    new = [("a", 8), ("a", 9), ("a", 10)]
    assert held(spark, path) == (new if step == "delete" else [("a", 1), ("a", 2)])
    sinks.write_detail(rows(spark, new), str(path))
    assert held(spark, path) == new and len(spark.read.json(str(path)).collect()) == 3


def test_a_rows_write_that_fails_leaves_the_old_ones(spark, tmp_path):
    path = tmp_path / "detail"
    sinks.write_detail(rows(spark, [("a", 1)]), str(path))
    with pytest.raises(Exception, match="broken"):
        sinks.write_detail(rows(spark, [("a", 2)]).withColumn("x", F.raise_error(F.lit("broken")).cast("long")), str(path))
    assert held(spark, path) == [("a", 1)]


def test_summaries_follow_their_manifests(spark, tmp_path):
    summary = spark.createDataFrame([("a b", "ARC", "40.00%")], "model string, Dataset string, Accuracy string")
    sinks.write_summary(summary, str(tmp_path / "s"))
    (folder,) = (tmp_path / "s").glob("model=*")
    (folder / "part-left-over.csv").write_text("Dataset,Accuracy\nARC,99.00%\n")
    (tmp_path / "s/other").mkdir()
    (tmp_path / "s/other/mine.csv").write_text("Dataset,Accuracy\nPIQA,50.00%\n")
    got = {(r.model, r.dataset): r.value for r in sinks.read_summaries(spark, str(tmp_path / "s")).collect()}
    assert got == {("a b", "ARC"): 0.4, ("other", "PIQA"): 0.5}
    sinks.write_summary(summary.where("false"), str(tmp_path / "s"), ["a b"])
    assert [r.model for r in sinks.read_summaries(spark, str(tmp_path / "s")).collect()] == ["other"]
    assert json.loads((folder / manifests.MANIFEST).read_text()) == {"files": []}


def test_profiles_of_empty_tables_and_null_keys(spark):
    df = spark.createDataFrame([(None, "b"), (None, "a")], "k int, t string")
    shown = lambda d, *keys: [tuple(r)[1:] for r in inspection.table_profile(d, "x", *keys).orderBy("ordinal").collect()]
    assert shown(df, "k") == [(1, "k", None), (2, "t", "a")]
    assert shown(df.where("false"), "k") == [(1, "k", None), (2, "t", None)]
    assert shown(df.where("false")) == [(1, "k", None), (2, "t", None)]
    both = spark.createDataFrame([(None, "b"), (3, "c"), (4, "a")], "k int, t string")
    assert shown(both, "k") == [(1, "k", "3"), (2, "t", "c")]


TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("render", [chat.render_turns, chat.render_template])
def test_turns_without_conversation_are_left_out(spark, render):
    turns = spark.createDataFrame([(None, 0, "user", "a"), (None, 1, "user", "b"), (1, 0, "user", "c"), (None, 0, None, "d")], TURNS)
    assert [r.conv_id for r in render(turns).collect()] == [1]
    assert [tuple(r) for r in chat.bad_turns(turns).collect()] == [(chat.NO_CONVERSATION, 3, 0)]


def test_repeated_turn_numbers_make_sections(spark):
    rows = [(1, 7, "user", f"t{i:03d}") for i in range(250)] + [(1, 3, "user", "first"), (1, 9, "user", "last")]
    turns = spark.createDataFrame(rows, TURNS).repartition(5)
    (row,) = chat.render_turns(turns, part_turns=10).collect()
    texts = [p.split("\n", 1)[1] for p in row.text.split(chat.START)[1:]]
    assert row.n_turns == 252 and [t.removesuffix(chat.END + "\n") for t in texts] == ["first", *(f"t{i:03d}" for i in range(250)), "last"]
    plan = chat.render_turns(turns, part_turns=10)._jdf.queryExecution().optimizedPlan().toString()
    assert "section" in plan
