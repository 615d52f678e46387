"""Whole jobs over a small folder of datasets."""

import json

import pytest
from pyspark.sql import functions as F
from tablewright.plans import jobs
from tablewright.sources import cache, readers, sinks


def put(df, root, name):
    """One parquet file under the given name."""
    import pyarrow.parquet as pq

    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    pq.write_table(df.drop("example_id").toArrow(), path)


@pytest.fixture(scope="module")
def root(views, tmp_path_factory):
    root = tmp_path_factory.mktemp("cache")
    put(views.arc(), root, "allenai___ai2_arc/ARC-Challenge/arc-train.parquet")
    put(views.arc().limit(30), root, "allenai___ai2_arc/ARC-Challenge/arc-test.parquet")
    put(views.csqa(), root, "tau___commonsense_qa/default/csqa-train.parquet")
    put(views.csqa().limit(20), root, "tau___commonsense_qa/default/csqa-validation.parquet")
    put(views.hella(), root, "Rowan___hellaswag/default/h-train-00000-of-00002.parquet")
    put(views.hella(), root, "Rowan___hellaswag/default/h-train-00001-of-00002.parquet")
    put(views.hella_damaged(), root, "Rowan___hellaswag/default/h-validation.parquet")
    put(views.piqa(), root, "baber___piqa/p-test.parquet")
    put(views.gsm(), root, "gsm8k/main/gsm-train.parquet")
    for subject, split in [("sociology", "test"), ("prehistory", "dev"), ("virology", "test")]:
        rows = views.mmlu().drop("subject").limit(40 if split == "test" else 5)
        put(rows, root, f"cais___mmlu/{subject}/m-{split}.parquet")
    put(views.gsm().limit(3), root, "unknown/x-train.parquet")
    return root


@pytest.fixture
def longest():
    return lambda context, texts: [float(len(t)) for t in texts]


@pytest.fixture
def zero():
    return lambda prompts: ["The answer is 0."] * len(prompts)


def test_choice_of_splits(spark, root):
    tasks = cache.load_tasks(spark, str(root))
    assert {t: df.count() for t, df in tasks.items()} == {
        "ARC": 30, "CommonsenseQA": 20, "HellaSwag": 200, "PIQA": 200, "MMLU": 85,
    }
    assert {r.subject for r in tasks["MMLU"].collect()} == {"sociology", "prehistory", "virology"}
    ids = tasks["HellaSwag"].select("example_id").distinct().count()
    assert ids == 200
    sources = cache.load_training_sources(spark, str(root))
    assert {n: df.count() for n, df in sources.items()} == {
        "commonsense": 200, "science": 200, "math": 1500, "subjects": 45,
    }
    assert cache.load_pair_source(spark, str(root)).count() == 400


def test_prepare_mixture(spark, root, tmp_path):
    out = str(tmp_path / "mixture")
    jobs.prepare_mixture(spark, str(root), out)
    rows = readers.read_jsonl(spark, out, readers.MIXTURE_SCHEMA)
    assert rows.count() == 200 + 200 + 450 + 45 + 5000
    jobs.prepare_mixture(spark, str(root), out)  # already there
    assert rows.count() == 5895


def test_prepare_pairs(spark, root, tmp_path):
    bad = jobs.prepare_pairs(spark, str(root), str(tmp_path / "pairs"))
    rows = readers.read_jsonl(spark, str(tmp_path / "pairs"), readers.PAIR_SCHEMA)
    assert rows.count() == 400 and bad.count() == 0
    assert rows.where("endswith(chosen, '<|im_end|>') and endswith(rejected, '<|im_end|>')").count() == 400


def test_evaluate_choices(spark, root, longest, tmp_path):
    out = str(tmp_path / "summary")
    jobs.evaluate_choices(spark, str(root), longest, "baseline", out)
    got = {r.dataset: r.value for r in sinks.read_summaries(spark, out).collect()}
    # the continuation dataset has unlabelled rows
    assert set(got) == {
        "ARC", "CommonsenseQA", "PIQA", "MMLU - sociology", "MMLU - prehistory", "MMLU - virology",
    }
    piqa = cache.load_tasks(spark, str(root))["PIQA"]
    right = F.when(F.length("sol2") > F.length("sol1"), 1).otherwise(0) == F.col("label")
    assert got["PIQA"] == pytest.approx(piqa.agg(F.avg(right.cast("int"))).head()[0], abs=5e-5)


def test_evaluate_choices_debug(spark, root, longest, tmp_path):
    out = str(tmp_path / "summary")
    jobs.evaluate_choices(spark, str(root), longest, "baseline", out, debug=True)
    got = {r.dataset: r.value for r in sinks.read_summaries(spark, out).collect()}
    assert all(round(a * 60) == pytest.approx(a * 60, abs=0.01) for a in got.values())  # fifths or less


def test_evaluate_answers(spark, root, zero, tmp_path):
    detail, summary = str(tmp_path / "detail"), str(tmp_path / "summary")
    jobs.evaluate_answers(spark, str(root), zero, "SFT_LoRA", detail, summary)
    lines = [json.loads(x) for p in (tmp_path / "detail/model=SFT_LoRA").glob("*.json") for x in p.read_text().splitlines()]
    assert len(lines) == 1500
    assert set(lines[0]) == {"question", "target", "prediction", "extracted_pred", "extracted_target", "correct"}
    row = sinks.read_summaries(spark, summary).head()
    assert (row.model, row.dataset, row.metric) == ("SFT_LoRA", "GSM8K", "Accuracy")
    assert row.value == pytest.approx(sum(x["correct"] for x in lines) / 1500, abs=5e-5)


def put_arrow(df, root, name, batch_rows=1000, indexed=True):
    import pyarrow as pa

    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    table = df.toArrow()
    new = pa.ipc.new_file if indexed else pa.ipc.new_stream
    with new(str(path), table.schema) as writer:
        writer.write_table(table, max_chunksize=batch_rows)


@pytest.fixture(scope="module")
def arrow_root(views, tmp_path_factory):
    """Arrow datasets with keys of their own, two configurations, several splits and shards."""
    root = tmp_path_factory.mktemp("arrow, cache")
    arc = views.arc().withColumn("id", F.lit("own"))
    put_arrow(arc.limit(30), root, "allenai___ai2_arc/ARC-Challenge/0.0.0/arc-test-00000-of-00002.arrow", 7)
    put_arrow(arc.limit(12), root, "allenai___ai2_arc/ARC-Challenge/0.0.0/arc-test-00001-of-00002.arrow", 7, indexed=False)
    put_arrow(arc.limit(50), root, "allenai___ai2_arc/ARC-Easy/0.0.0/arc-test.arrow")
    put_arrow(arc, root, "allenai___ai2_arc/ARC-Challenge/0.0.0/arc-train.arrow")
    for subject in ("virology", "sociology"):
        put_arrow(views.mmlu().drop("subject", "example_id").limit(40), root, f"cais___mmlu/{subject}/m-test.arrow", 3)
    gsm = views.gsm()
    put_arrow(gsm.limit(30), root, "gsm8k/main/gsm-train.arrow")
    put_arrow(gsm.limit(10), root, "gsm8k/main/gsm-test.arrow")
    put_arrow(gsm.limit(10), root, "gsm8k/socratic/gsm-test.arrow")
    return root


def test_one_split_of_one_configuration(spark, arrow_root):
    tasks = cache.load_tasks(spark, str(arrow_root))
    assert {t: df.count() for t, df in tasks.items()} == {"ARC": 42, "MMLU": 80}
    assert "id" not in tasks["ARC"].columns and tasks["ARC"].select("example_id").distinct().count() == 42
    assert cache.load_answers(spark, str(arrow_root)).count() == 10
    sources = cache.load_training_sources(spark, str(arrow_root))
    assert {n: df.count() for n, df in sources.items()} == {"science": 200, "math": 30, "subjects": 40}


def test_keys_do_not_hold_the_place_of_the_folder(spark, arrow_root, tmp_path):
    import shutil

    moved = tmp_path / "elsewhere"
    shutil.copytree(arrow_root, moved)
    keys = [sorted(r.id for r in cache.load_training_sources(spark, str(r))["science"].collect()) for r in (arrow_root, moved)]
    assert keys[0] == keys[1] and keys[0][0].startswith("allenai___ai2_arc/ARC-Challenge/0.0.0/arc-train.arrow#")


def test_items_are_scored_once(spark, arrow_root, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def scorer(context, texts):
        calls.add(1)
        return [float(len(t)) for t in texts]

    from tablewright.operators import candidates, scoring
    from tablewright.plans import choice_eval

    tables = cache.load_tasks(spark, str(arrow_root))
    n_items = candidates.all_candidates(tables).count()
    jobs.evaluate_choices(spark, str(arrow_root), scorer, "baseline", str(tmp_path / "s"))
    assert calls.value == n_items
    summary = choice_eval.whole_summary(scoring.predict(scoring.attach_scorer(candidates.all_candidates(tables), scorer)), tables)
    assert summary._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_debug_takes_the_first_rows_of_every_subject(spark, arrow_root):
    from tablewright.operators.candidates import first_rows

    tasks = cache.load_tasks(spark, str(arrow_root))
    rows = first_rows(tasks["MMLU"], cache.KEY).collect()
    assert sorted((r.subject, r.example_id[-25:]) for r in rows) == [
        (s, f"{b:012d}#{i:012d}") for s in ("sociology", "virology") for b, i in [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1)]
    ]
    rows = first_rows(tasks["ARC"], cache.KEY).collect()
    assert [r.example_id[-1] for r in rows] == list("01234")


def test_two_models_share_their_folders(spark, arrow_root, zero, tmp_path):
    from tablewright.operators import results

    detail, summary = str(tmp_path / "detail"), str(tmp_path / "summary")
    right = lambda prompts: ["The answer is 7."] * len(prompts)
    for model, generator in (("baseline", zero), ("mine", right), ("baseline", zero)):
        jobs.evaluate_answers(spark, str(arrow_root), generator, model, detail, summary)
    jobs.evaluate_choices(spark, str(arrow_root), lambda c, t: [1.0] * len(t), "mine", str(tmp_path / "summary/choices"))
    assert spark.read.json(detail).count() == 20
    figures = sinks.read_summaries(spark, summary)
    assert results.repeated_figures(figures).count() == 0
    board = {r.dataset: r for r in results.leaderboard(figures).collect()}
    assert board["GSM8K"]["mine"] == 0.0 and board["GSM8K"]["mine_vs_baseline"] == 0.0 and board["ARC"]["mine"] > 0
    assert board["ARC"]["baseline"] is None


def test_repeated_figures_are_reported_and_not_chosen(spark):
    from tablewright.operators import results

    rows = [("baseline", "GSM8K", "Accuracy", 0.229), ("baseline", "GSM8K", "Accuracy", 0.6808)]
    figures = spark.createDataFrame(rows, "model string, dataset string, metric string, value double")
    assert results.repeated_figures(figures).head().n == 2
    assert results.leaderboard(figures).head()["baseline"] is None


def test_a_broken_write_is_replaced(spark, tmp_path):
    (tmp_path / "out/_temporary").mkdir(parents=True)
    sinks.write_once(spark.range(3), str(tmp_path / "out"))
    sinks.write_once(spark.range(9), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_arrow_files_are_split_by_batches(spark, arrow_root):
    name = str(arrow_root / "allenai___ai2_arc/ARC-Challenge/0.0.0/arc-test-00000-of-00002.arrow")
    from tablewright.sources.arrow_files import ArrowFiles

    spark.dataSource.register(ArrowFiles)
    read = spark.read.format("arrow_files").option("split_bytes", "1000").load(name)
    # ranges of bytes, found without opening the file; five of them hold a batch
    assert read.rdd.getNumPartitions() >= 5 and read.count() == 30
    assert sum(1 for p in read.rdd.glom().collect() if p) == 5
    stream = name.replace("00000-of", "00001-of")
    assert readers.read_columnar(spark, name, stream, format="arrow_files").count() == 42


def test_mixture_leaves_out_rows_without_target(spark, views, tmp_path):
    inputs = {"subjects": views.mmlu().withColumnRenamed("example_id", "id").withColumn("answer", F.col("answer") * 5)}
    from tablewright.plans import training_mixture

    pairs = training_mixture.mixture(spark, inputs)
    bad = training_mixture.incomplete_pairs(pairs).collect()
    assert len(bad) == 1 and bad[0].reason == training_mixture.NO_TARGET
    training_mixture.write_mixture(pairs, str(tmp_path / "m"))
    rows = readers.read_jsonl(spark, str(tmp_path / "m"), readers.MIXTURE_SCHEMA)
    assert rows.count() == pairs.count() - bad[0].n_rows
    assert rows.where("messages[1].content is null").count() == 0


def test_training_rows_and_pairs(spark, root, tmp_path):
    jobs.prepare_mixture(spark, str(root), str(tmp_path / "m"))
    jobs.prepare_training(spark, str(tmp_path / "m"), str(tmp_path / "rows"), epochs=1)
    rows = spark.read.parquet(str(tmp_path / "rows"))
    assert rows.count() == 5895 and rows.agg(F.max("position")).head()[0] == 5894
    assert rows.where("startswith(text, '<|im_start|>user')").count() == 5895
    jobs.prepare_pairs(spark, str(root), str(tmp_path / "p"))
    jobs.prepare_training_pairs(spark, str(tmp_path / "p"), str(tmp_path / "cut"))
    assert readers.read_jsonl(spark, str(tmp_path / "cut"), readers.PAIR_SCHEMA).count() == 400
