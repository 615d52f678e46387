"""Edge cases with expected values worked out by hand."""

import pytest
from pyspark.sql import functions as F
from tablewright.functions.hashing import draw
from tablewright.functions.text import final_number, percent_text, percent_value, same_number
from tablewright.operators import candidates, formatting, metrics, preference, quarantine, scoring


def one(df, column):
    return df.select(column.alias("x")).head().x


@pytest.mark.parametrize(
    "text, number",
    [
        ("The answer is 42", "42"),
        ("a #### 1,234.50", "1234.50"),
        ("#### 7.", "7."),
        ("x=7-3", "-3"),
        ("no digits", None),
        ("", None),
        ("12 #### none", None),
        ("3 #### 4 #### 5 6", "6"),
        ("$1,000.", "1000."),
        ("1.2.3", "3"),
        ("#####5", "5"),
        (".5", "5"),
        ("-  3", "3"),
        ("1e5", "5"),
        ("٤٢", "٤٢"),
        (None, None),
    ],
)
def test_final_number(spark, text, number):
    df = spark.createDataFrame([(text,)], "t string")
    assert one(df, final_number(F.col("t"))) == number


@pytest.mark.parametrize(
    "predicted, expected, equal",
    [
        ("42", "42.", True),
        ("42", "42.0000001", True),
        ("42", "42.00001", False),
        ("-3", "3", False),
        (None, None, False),
        (None, "3", False),
        ("3", None, False),
        ("٤٢", "٤٢", True),
        ("٤٢", "42.0", True),
        ("9" * 400, "9" * 400, False),  # both overflow; their difference is not a number
    ],
)
def test_same_number(spark, predicted, expected, equal):
    df = spark.createDataFrame([(predicted, expected)], "p string, e string")
    assert one(df, same_number(F.col("p"), F.col("e"))) is equal


def test_draw(spark):
    df = spark.range(4).select(draw("42", "id", 1 << 40).alias("x"), draw("42", "id", 3).alias("y"))
    assert [r.x for r in df.orderBy("id").collect()] == [2836948935, 1494077868, 2010484695, 1061633326]
    assert [r.y for r in df.orderBy("id").collect()] == [0, 0, 0, 1]


@pytest.mark.parametrize("ratio, text", [(1 / 32, "3.12%"), (0.4013, "40.13%"), (0.0, "0.00%"), (1.0, "100.00%")])
def test_percent_text(spark, ratio, text):
    df = spark.createDataFrame([(ratio,)], "r double")
    assert one(df, percent_text("r")) == text
    assert one(df, percent_value(F.lit(text))) == float(text[:-1]) / 100


def test_labelled_choices(spark):
    schema = "question string, choices struct<text array<string>, label array<string>>, answerKey string"
    rows = [("q", (["x", "y"], ["A", "B"]), "B"), ("q", (["x", "y"], ["A"]), "A"), ("q", (["x"], ["A", "B"]), "A")]
    got = formatting.to_pairs(spark.createDataFrame(rows, schema), formatting.multiple_choice).collect()
    assert got[0].prompt == "q\n\nA. x\nB. y\n\nAnswer:" and got[0].target == "B"
    assert got[1].prompt == got[2].prompt == "q\n\nA. x\n\nAnswer:"


def test_positional_choices(spark):
    schema = "question string, choices array<string>, answer int"
    rows = [("q", list("abcdefgh"), 5), ("q", list("abcd"), -1), ("q", list("abcd"), 4)]
    got = formatting.to_pairs(spark.createDataFrame(rows, schema), formatting.multiple_choice).collect()
    assert got[0].prompt == "q\n\nA. a\nB. b\nC. c\nD. d\nE. e\nF. f\n\nAnswer:" and got[0].target == "F"
    assert got[1].target == "D" and got[2].target is None


def test_positional_choices_with_text_answer(spark):
    df = spark.createDataFrame([("q", ["a", "b"], "B")], "question string, choices array<string>, answer string")
    assert formatting.to_pairs(df, formatting.multiple_choice).head().target == "B"


def test_unknown_choices_are_an_error(spark):
    with pytest.raises(ValueError):
        formatting.multiple_choice(spark.createDataFrame([("q", "c")], "question string, choices string"))


def test_key_choice_is_by_presence(spark):
    schema = "answerKey string, answer string"
    df = spark.createDataFrame([(None, "x")], schema)
    assert one(df, formatting.pick_column(df, "answerKey", "answer")) is None
    assert one(df, formatting.pick_column(df, "key", "other")) == ""


@pytest.mark.parametrize(
    "sentence, context, first",
    [("a _ b _ c", "a ", "o b "), ("abc", "abc", "o"), ("_ b", "", "o b")],
)
def test_winogrande(spark, sentence, context, first):
    schema = "example_id int, sentence string, option1 string, option2 string, answer string"
    df = candidates.winogrande(spark.createDataFrame([(1, sentence, "o", "p", "2")], schema))
    row = df.head()
    assert (row.context, row.candidates[0], row.label) == (context, first, 1)


def test_answer_keys(spark):
    schema = "example_id int, question string, choices struct<text array<string>, label array<string>>, answerKey string"
    keys = ["A", "D", "E", "1", "4", "5", "F", None]
    rows = [(i, "q", (list("wxyz"), list("ABCD")), k) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, schema)
    assert {r.example_id: r.label for r in candidates.arc(df).collect()} == {0: 0, 1: 3, 3: 0, 4: 3}
    assert {r.example_id: r.label for r in candidates.commonsense_qa(df).collect()} == {0: 0, 1: 3}


@pytest.mark.parametrize(
    "total, ctx_len, reference, exact",
    [(6, 4, 0.16, 0.24), (5, 4, -9999.0, 0.08), (5, 5, -9999.0, -9999.0)],
)
def test_candidate_scores(spark, total, ctx_len, reference, exact):
    # index j holds 0.01 * 2**j
    rows = [(1, j, 0.01 * 2**j, ctx_len) for j in range(total - 1)]
    df = spark.createDataFrame(rows, "id int, pos int, lp double, ctx_len int")
    for mode, value in (("reference", reference), ("exact", exact)):
        assert scoring.candidate_scores(df, ["id"], mode).head().score == pytest.approx(value)


@pytest.mark.parametrize(
    "scores, best",
    [([1.0, 3.0, 3.0], 1), ([-9999.0, -9999.0], 0), ([float("nan"), -5.0], 1), ([float("-inf"), float("nan")], 0)],
)
def test_predict_takes_the_first_highest(spark, scores, best):
    wide = spark.createDataFrame([("d", "", 1, 0, scores)], "dataset string, subset string, example_id int, label int, scores array<double>")
    assert scoring.predict(wide).head().prediction == best
    long = wide.select("dataset", "subset", "example_id", "label", F.posexplode("scores").alias("cand", "score"))
    assert scoring.predict(long).head().prediction == best


def test_accuracy_of_a_dataset_without_usable_rows_is_zero(spark):
    rows = spark.createDataFrame([("ARC", 1, 1), ("ARC", 0, 1)], "dataset string, prediction int, label int")
    table = metrics.choice_accuracy(rows, ["dataset"], ["ARC", "PIQA"])
    assert {r.dataset: r.accuracy for r in table.collect()} == {"ARC": 0.5, "PIQA": 0.0}


def test_pass_at_k(spark):
    rows = [("a", i < 2) for i in range(5)] + [("b", True)] + [("c", i < 4) for i in range(5)]
    df = spark.createDataFrame(rows, "task string, ok boolean")
    got = {r.task: r.pass_at_k for r in metrics.pass_at_k(df, "task", F.col("ok"), k=2).collect()}
    assert got["a"] == pytest.approx(1 - 3 / 10) and got["b"] is None and got["c"] == 1.0


def test_pairs_and_quarantine_split_the_rows(spark):
    rows = [
        (1, "c", ["x", "y"], "0"), (2, "c", ["x", "y"], ""), (3, "c", ["x", "y"], "2"),
        (4, "c", ["x"], "0"), (5, "c", ["x", "y"], "-1"), (6, "c", ["x", "y"], None),
    ]
    df = spark.createDataFrame(rows, "id int, ctx string, endings array<string>, label string")
    pairs = preference.preference_pairs(df, "id").collect()
    assert [(p.id, p.chosen, p.rejected) for p in pairs] == [(1, "x", "y")]
    bad = quarantine.bad_rows([("d", df, quarantine.continuation_problem(F.col("endings"), F.col("label")))])
    assert {r.reason: r.n_rows for r in bad.collect()} == {
        quarantine.NOT_AN_INTEGER: 2, quarantine.OUT_OF_RANGE: 2, quarantine.NOTHING_TO_REJECT: 1,
    }


def test_chat_markers(spark):
    df = spark.createDataFrame([("p", "c", "r")], "prompt string, chosen string, rejected string")
    row = preference.in_chat_markers(df).head()
    assert row.prompt == "<|im_start|>user\np<|im_end|>\n<|im_start|>assistant\n"
    assert (row.chosen, row.rejected) == ("c<|im_end|>", "r<|im_end|>")


def test_preference_metrics(spark):
    import math

    rows = [("g", -1.0, -2.0, -5.0, -3.0), ("g", -4.0, -1.0, -1.0, -1.0)]
    schema = "g string, policy_chosen double, reference_chosen double, policy_rejected double, reference_rejected double"
    row = preference.preference_metrics(spark.createDataFrame(rows, schema), ["g"]).head()
    margins = [0.3, -0.3]
    assert row.margin == pytest.approx(0.0) and row.accuracy == 0.5
    assert row.loss == pytest.approx(sum(math.log(1 + math.exp(-m)) for m in margins) / 2)
