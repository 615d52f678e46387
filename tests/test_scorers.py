"""Scorers and generators that see many items at once, fail, or are called again."""

import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from tablewright.functions import batches
from tablewright.operators import answers, candidates, scoring

# the workers do not see this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ITEMS = "dataset string, subset string, example_id long, label int, context string, candidates array<string>"


def items(spark, rows, problem=False):
    df = spark.createDataFrame([("d", "", i, 0, c, t) for i, (c, t) in enumerate(rows)], ITEMS)
    return df.withColumn("problem", F.lit(None).cast("string")) if problem else df


def lengths(context, texts):
    return [float(len(context) + len(t)) for t in texts]


def some_groups(n, seed=0):
    draw = random.Random(seed)
    text = lambda most: " ".join(["w"] * draw.randint(0, most))
    return [(text(draw.choice([3, 200])), [text(9) for _ in range(draw.randint(1, 5))]) for _ in range(n)]


@pytest.mark.parametrize("tokens", [1, 50, 400, 5000])
def test_calls_are_bounded_and_hold_everything(tokens):
    groups = some_groups(300)
    calls = scoring.calls_of(groups, tokens)
    assert sorted(i for call in calls for i in call) == list(range(300))
    padding = total = 0
    for call in calls:
        sizes = [[scoring.words_of(groups[i][0]) + scoring.words_of(t) for t in groups[i][1]] for i in call]
        longest, n = max(map(max, sizes)), sum(map(len, sizes))
        assert len(call) == 1 or longest * n <= tokens
        padding += longest * n - sum(map(sum, sizes))
        total += sum(map(sum, sizes))
    if tokens == 5000:
        assert len(calls) < 60 and padding < 0.5 * total  # in the order of the items it is several times as much


def test_equal_contexts_are_one_group():
    groups = [("long context here", ["a", "b"]), ("x", ["c"]), ("long context here", ["d"])]
    (call,) = scoring.calls_of(groups, 1000)
    joined, places = scoring._joined([groups[i] for i in call])
    assert joined == [("long context here", ["a", "b", "d"]), ("x", ["c"])]
    assert [joined[g][1][at] for g, at in places] == ["a", "d", "c"]


@pytest.mark.parametrize(("tokens", "rows"), [(0, 5000), (1, 7), (300, 5000), (10**6, 1), (10**6, 5000)])
def test_batched_scores_equal_those_one_by_one(spark, tokens, rows):
    groups = some_groups(120, seed=3) + [("same", ["a", "bb"])] * 5 + [("none", [])]
    df = items(spark, groups).repartition(3)
    plain = {r.example_id: r.scores for r in scoring.attach_scorer(df, lengths).collect()}
    together = lambda given: [lengths(*g) for g in given]
    got = scoring.attach_batch_scorer(df, together, call_tokens=tokens, window_rows=rows, window_bytes=2000)
    assert {r.example_id: r.scores for r in got.collect()} == plain
    assert plain == {i: lengths(*g) for i, g in enumerate(groups)}


def test_calls_are_fewer_than_items(spark):
    calls = spark.sparkContext.accumulator(0)

    def together(groups):
        calls.add(1)
        return [lengths(*g) for g in groups]

    df = items(spark, some_groups(1000, seed=5)).coalesce(1)
    assert scoring.attach_batch_scorer(df, together, call_tokens=20_000).count() == 1000
    assert 1 < calls.value < 40


def test_errors_of_a_scorer(spark):
    def fails(context, texts):
        if "bad" in context:
            raise RuntimeError("no such word")
        return lengths(context, texts)

    groups = [("good", ["a"]), ("bad one", ["a"]), ("fine", ["b", "c"]), ("bad two", ["a"])]
    with pytest.raises(Exception, match="no such word"):
        scoring.attach_scorer(items(spark, groups), fails).collect()
    for scored in (
        scoring.attach_scorer(items(spark, groups, True), fails),
        scoring.attach_batch_scorer(items(spark, groups, True), lambda given: [fails(*g) for g in given]),
    ):
        got = {r.example_id: (r.problem, r.scores) for r in scored.collect()}
        assert got[0] == (None, [5.0]) and got[2] == (None, [5.0, 5.0])
        assert got[1] == got[3] == ("scorer: RuntimeError: no such word", None)
    wrong = scoring.attach_batch_scorer(items(spark, groups, True), lambda given: [[1.0, 2.0, 3.0]] * len(given))
    assert all("another number of scores" in r.problem for r in wrong.collect())


def test_items_with_a_problem_are_not_scored(spark):
    df = items(spark, [("c", ["t"]), (None, None)], True)
    df = df.withColumn("problem", F.when(F.col("context").isNull(), F.lit("unread")))
    rows = {r.example_id: r for r in scoring.predict(scoring.attach_scorer(df, lengths)).collect()}
    assert rows[0].prediction == 0 and rows[1].problem == "unread" and rows[1].prediction is None


def test_pieces_are_bounded_by_bytes():
    import pyarrow as pa

    texts = ["x" * n for n in (10, 10, 5000, 10, 10, 10)]
    batch = pa.RecordBatch.from_pydict({"t": texts, "l": [[t, None, t] for t in texts], "n": range(6)})
    assert batches.row_bytes(batch).tolist() == [3 * len(t) + 8 for t in texts]
    assert [p.num_rows for p in batches.pieces([batch], 100, 80)] == [2, 1, 2, 1]
    assert [p.num_rows for p in batches.pieces([batch.slice(1)], 2, 10**6)] == [2, 2, 1]
    nulls = pa.RecordBatch.from_pydict({"t": pa.array([None, "ab"]), "l": pa.array([None, ["abc"]], pa.list_(pa.string()))})
    assert batches.row_bytes(nulls).tolist() == [0, 5] and list(batches.pieces([batch.slice(6)])) == []


QUESTIONS = "example_id long, question string, answer string"


class Counted:
    """A generator that notes its prompts in a folder, and fails once some are there."""

    def __init__(self, folder, fails_after=None):
        self.folder, self.fails_after = folder, fails_after
        folder.mkdir(exist_ok=True)

    def __call__(self, prompts):
        import uuid

        if self.fails_after is not None and len(self.noted()) >= self.fails_after:
            raise RuntimeError("out of memory")
        (self.folder / uuid.uuid4().hex).write_text("\0".join(prompts))
        return [p.upper() for p in prompts]

    def noted(self):
        return [p for f in self.folder.iterdir() for p in f.read_text().split("\0") if p]


@pytest.fixture
def questions(spark):
    rows = [(i, f"What is {i % 80}?", "#### 1") for i in range(100)] + [(100, None, "#### 1")]
    return spark.createDataFrame(rows, QUESTIONS)


def generated(questions, generator, store, name="m", **options):
    rows = answers.attach_stored_generator(questions, "example_id", generator, name, str(store), **options)
    return {r.example_id: r.prediction for r in rows.collect()}


def test_texts_are_generated_once(questions, tmp_path):
    first = Counted(tmp_path / "one")
    got = generated(questions, first, tmp_path / "store", commit_rows=25, call_rows=7)
    assert len(first.noted()) == len(set(first.noted())) == 80  # equal prompts once, none without question
    assert got.pop(100) is None and all(f"WHAT IS {i % 80}?" in text for i, text in got.items()) and len(got) == 100
    second = Counted(tmp_path / "two")
    assert generated(questions, second, tmp_path / "store")[7] == got[7] and second.noted() == []
    other = Counted(tmp_path / "three")
    generated(questions, other, tmp_path / "store", name="other model")
    assert len(other.noted()) == 80


def test_a_run_that_was_broken_off_goes_on(spark, questions, tmp_path):
    broken = Counted(tmp_path / "one", fails_after=30)
    with pytest.raises(Exception, match="out of memory"):
        generated(questions, broken, tmp_path / "store", commit_rows=16, call_rows=3)
    committed = spark.read.parquet(str(tmp_path / "store")).count()
    assert 0 < committed < 80
    again = Counted(tmp_path / "two")
    got = generated(questions, again, tmp_path / "store", commit_rows=16)
    assert len(again.noted()) == 80 - committed and len([p for p in got.values() if p]) == 100


def test_no_questions(spark, tmp_path):
    none = spark.createDataFrame([], QUESTIONS)
    assert generated(none, Counted(tmp_path / "one"), tmp_path / "store") == {}


def test_calls_of_a_generator_are_bounded(spark, questions):
    sizes = spark.sparkContext.accumulator(0)

    def generator(prompts):
        if len(prompts) > 10 or sum(map(len, prompts)) > 400:
            sizes.add(1)
        return prompts

    rows = answers.attach_generator(questions.where("question is not null").coalesce(1), "example_id", generator, 10, 400)
    assert rows.count() == 100 and sizes.value == 0
    with pytest.raises(Exception, match="another number of texts"):
        answers.attach_generator(questions, "example_id", lambda prompts: prompts[1:]).collect()


def test_subjects_fail_on_their_own(spark, tmp_path):
    """One subject's scorer and another's file fail; the third has its accuracy."""
    import pyarrow as pa
    from tablewright.operators import results
    from tablewright.plans import jobs
    from tablewright.sources import sinks

    for subject in ("history", "logic", "virology"):
        table = pa.table({"question": [f"{subject} {i}" for i in range(8)], "choices": [["a", "bb"]] * 8, "answer": pa.array([1] * 8, pa.int32())})
        path = tmp_path / f"root/cais___mmlu/{subject}/m-test.arrow"
        path.parent.mkdir(parents=True)
        with pa.ipc.new_stream(str(path), table.schema) as writer:
            writer.write_table(table)
    path.write_bytes(path.read_bytes()[:-300])
    piqa = tmp_path / "root/baber___piqa/p-test.arrow"
    piqa.parent.mkdir()
    piqa.write_bytes(b"nothing")

    def scorer(context, texts):
        if "logic 5" in context:
            raise ValueError("odd")
        return lengths(context, texts)

    for options in ({"scorer": scorer}, {"scorer": None, "batch_scorer": lambda given: [scorer(*g) for g in given]}, {"scorer": scorer, "debug": True}):
        out = str(tmp_path / f"s{len(options)}{'debug' in options}")
        bad = jobs.evaluate_choices(spark, str(tmp_path / "root"), model=results.MODELS[0], output=out, **options)
        reasons = {r.dataset: (r.reason, r.n_rows) for r in bad.collect()}
        figures = {r.dataset: r.value for r in sinks.read_summaries(spark, out).collect()}
        if "debug" in options:  # the first five items have no question five
            assert set(figures) == {"MMLU - history", "MMLU - logic"}
            continue
        assert figures == {"MMLU - history": 1.0}
        assert reasons["MMLU - logic"] == ("scorer: ValueError: odd", 1) and reasons["MMLU - virology"][1] == 1
        assert "PIQA" in reasons and set(reasons) == {"MMLU - logic", "MMLU - virology", "PIQA"}


def test_candidates_keep_their_form_without_reports(views):
    assert "problem" not in candidates.all_candidates(views.tasks()).columns


def test_damaged_answers_are_reported(spark, tmp_path):
    import pyarrow as pa
    from tablewright.plans import jobs

    table = pa.table({"question": [f"What is {i}?" for i in range(30)], "answer": ["#### 1"] * 30})
    path = tmp_path / "root/gsm8k/main/g-test.arrow"
    path.parent.mkdir(parents=True)
    with pa.ipc.new_stream(str(path), table.schema) as writer:
        writer.write_table(table, max_chunksize=5)
    told = [str(tmp_path / n) for n in ("detail", "summary")]
    asked = Counted(tmp_path / "asked")
    assert jobs.evaluate_answers(spark, str(tmp_path / "root"), asked, "m", *told).count() == 0
    assert len(asked.noted()) == 30
    path.write_bytes(path.read_bytes()[:-400])
    (bad,) = jobs.evaluate_answers(spark, str(tmp_path / "root"), asked, "m2", *told).collect()
    assert (bad.dataset, bad.n_rows) == ("GSM8K", 1) and bad.reason.startswith("DamagedFile")
    path.write_bytes(b"")
    (bad,) = jobs.evaluate_answers(spark, str(tmp_path / "root"), asked, "m2", *told).collect()
    assert bad.dataset == "GSM8K" and len(asked.noted()) == 30
    assert not (tmp_path / "detail/model=m2").exists()
    (bad,) = jobs.evaluate_answers(spark, str(tmp_path / "elsewhere"), asked, "m2", *told).collect()
    assert "gsm8k" in bad.reason
