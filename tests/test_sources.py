import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.errors import AnalysisException
from tablewright.operators import results, runs
from tablewright.plans import training_mixture
from tablewright.sources import files, readers, sinks

FILES = "dataset string, subset string, path string"


def resolved(spark, names, *args, **kwargs):
    df = spark.createDataFrame([("d", "s", n and f"/x/{n}") for n in names], FILES)
    return files.resolve_split(df, *args, **kwargs).head()


def test_split_choice(spark):
    assert resolved(spark, ["x-test.arrow", "x-train.arrow"]).path == "/x/x-test.arrow"
    assert resolved(spark, ["x-dev.arrow"]).path == "/x/x-dev.arrow"
    assert resolved(spark, [None]).path is None
    both = resolved(spark, ["a-train-00001-of-00002.arrow", "a-train-00000-of-00002.arrow"])
    assert both.path.endswith("00000-of-00002.arrow") and both.n_files == 2
    sharded = resolved(spark, ["a-train-00000-of-00002.arrow"], ["train"], "suffix", "none")
    assert sharded.path is None and sharded.n_files == 0
    chain = resolved(spark, ["a-dev.arrow", "a-train.arrow"], ["test", "dev"], "suffix", "none")
    assert chain.path == "/x/a-dev.arrow"
    # the folder name does not count
    assert resolved(spark, ["test/x-train.arrow", "a-validation.arrow"]).path == "/x/a-validation.arrow"


def test_files_of_split_falls_back_to_all(spark):
    rows = [("d", "", "/d/a-train.arrow"), ("d", "", "/d/a-test.arrow"), ("e", "", "/e/a-dev.arrow"), ("e", "", "/e/a-test.arrow")]
    df = spark.createDataFrame(rows, FILES)
    strict = files.files_of_split(df, ["train"])
    assert {r.path for r in strict.collect()} == {"/d/a-train.arrow"}
    loose = files.files_of_split(df, ["train"], fall_back_to_all=True)
    assert {r.path for r in loose.collect()} == {"/d/a-train.arrow", "/e/a-dev.arrow", "/e/a-test.arrow"}


def test_list_files(spark, tmp_path):
    for name in ("one/sub/a-train.parquet", "one/sub/a-test.parquet", "two/b-test.parquet"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        pq.write_table(pa.table({"x": [1]}), tmp_path / name)
    listed = files.list_files(spark, str(tmp_path), "*.parquet")
    assert sorted((r.dataset, r.subset) for r in listed.collect()) == [("one", "sub"), ("one", "sub"), ("two", "")]
    chosen = files.resolve_split(listed, extension=".parquet")
    assert {r.dataset: r.path.rsplit("/", 1)[1] for r in chosen.collect()} == {"one": "a-test.parquet", "two": "b-test.parquet"}
    assert readers.read_split(spark, str(tmp_path), "test").count() == 2


@pytest.mark.parametrize("new", [pa.ipc.new_stream, pa.ipc.new_file])
def test_arrow_files(spark, tmp_path, new):
    table = pa.table({"id": [1, 2, 3], "choices": [["a"], [], None], "s": [{"x": "p"}, {"x": None}, None]})
    for name in ("one.arrow", "deep/two.arrow"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        with new(str(tmp_path / name), table.schema) as writer:
            writer.write_table(table, max_chunksize=2)
    df = readers.read_columnar(spark, str(tmp_path), format="arrow_files")
    assert df.rdd.getNumPartitions() == 2
    rows = df.orderBy("id").collect()
    assert [r.id for r in rows] == [1, 1, 2, 2, 3, 3]
    assert rows[0].choices == ["a"] and rows[0].s.x == "p" and rows[4].choices is None
    one = readers.read_columnar(spark, str(tmp_path / "one.arrow"), format="arrow_files")
    assert one.count() == 3


def test_missing_inputs(spark, folder):
    found, missing = readers.read_available(spark, {"a": f"{folder}/part.parquet", "b": f"{folder}/nothing"})
    assert list(found) == ["a"] and missing == ["b"]
    with pytest.raises(FileNotFoundError):
        readers.read_available(spark, {"b": f"{folder}/nothing"})
    with pytest.raises(AnalysisException):
        readers.read_jsonl(spark, f"{folder}/nothing", "x int").count()


def test_jsonl_keeps_null_fields_and_unicode(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.write_jsonl(spark.createDataFrame([("é", None)], "prompt string, chosen string"), path)
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("*.json"))
    assert text == '{"prompt":"é","chosen":null}\n'


def test_write_once(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.write_once(spark.range(3), path)
    sinks.write_once(spark.range(9), path)
    assert readers.read_jsonl(spark, path, "id long").count() == 3


def test_mixture_is_written_in_order(spark, views, tmp_path):
    path = str(tmp_path / "mixture")
    mixture = training_mixture.mixture(spark, views.mixture_inputs())
    training_mixture.write_mixture(mixture, path)
    written = readers.read_jsonl(spark, path, readers.MIXTURE_SCHEMA)
    assert written.count() == mixture.count()
    assert {m.role for m in written.head().messages} == {"user", "assistant"}


def test_published_summaries(spark, tmp_path):
    """Folders per model with a two-column summary each."""
    shown = {"baseline": ["MMLU - a,27.27%", "MMLU - b,30.00%", "ARC,40.13%"], "SFT_Full": ["MMLU - a,50.00%", "ARC,38.80%"]}
    for model, lines in shown.items():
        (tmp_path / model).mkdir()
        (tmp_path / model / "mc_summary.txt").write_text("\n".join(["Dataset,Accuracy", *lines]) + "\n")
        (tmp_path / model / "other_summary.txt").write_text("Dataset,Metric,Value\nGSM8K,Accuracy,22.90%\n")
    read = sinks.read_summaries(spark, str(tmp_path))
    got = {(r.model, r.dataset, r.metric): round(r.value, 4) for r in read.collect()}
    assert len(got) == 7
    assert got[("baseline", "ARC", "Accuracy")] == 0.4013 and got[("SFT_Full", "GSM8K", "Accuracy")] == 0.229
    board = {r.dataset: r for r in results.leaderboard(read).collect()}
    assert board["ARC"].SFT_Full_vs_baseline == pytest.approx(-0.0133)
    assert board["MMLU"].baseline == pytest.approx(0.28635) and board["MMLU"].SFT_Full == 0.5
    assert board["MMLU - b"].SFT_Full is None and board["ARC"].RL_Full is None
    one_kind = sinks.read_summaries(spark, str(tmp_path), "other_*.txt")
    assert {(r.model, r.dataset) for r in one_kind.collect()} == {("baseline", "GSM8K"), ("SFT_Full", "GSM8K")}


def test_newest_run(spark, tmp_path):
    import os

    runs_found = {
        "sft_2025-01-01_00-00-00/final_model/config.json": 10,
        "sft_2025-02-01_00-00-00/checkpoint-500/config.json": 30,
        "sft_2025-02-01_00-00-00/checkpoint-1000/config.json": 40,
        "dpo_a_2025-01-01_00-00-00/checkpoint-9/config.json": 50,
        "dpo_a_2025-01-01_00-00-00/final_model/config.json": 20,
        "dpo_b_2025-01-01_00-00-00/trace.log": 20,
    }
    for name, when in runs_found.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
        os.utime(tmp_path / name, (when, when))
    entries = files.list_runs(spark, str(tmp_path))
    got = {r.prefix: (r.run_dir[-19:], r.entry) for r in runs.latest_run(entries).collect()}
    assert got == {
        "sft": ("2025-02-01_00-00-00", "checkpoint-1000"),
        "dpo_a": ("2025-01-01_00-00-00", "final_model"),
        "dpo_b": ("2025-01-01_00-00-00", None),
    }
    assert {r.prefix: r.entry for r in runs.latest_run(entries, checkpoints=False).collect()}["sft"] is None


def test_unreadable_folders_are_skipped_and_reported(spark, tmp_path):
    from tablewright.operators.inspection import profile_folders

    spark.range(3).write.parquet(str(tmp_path / "good"))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/x.parquet").write_text("not parquet")
    paths = {n: str(tmp_path / n) for n in ("good", "bad", "missing")}
    profiles, skipped = profile_folders(spark, paths)
    assert [(r.table_name, r.column_name, r.example) for r in profiles.collect()] == [("good", "id", "0")]
    assert set(skipped) == {"bad", "missing"} and all(skipped.values())
    assert profile_folders(spark, {"missing": paths["missing"]})[0] is None
