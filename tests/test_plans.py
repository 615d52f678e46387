"""Physical plans: no one-task sorts, no needless shuffles, no Python where it is not meant to be."""

import re

import pytest
from pyspark.sql import functions as F
from tablewright.demo.queries import QUERIES
from tablewright.operators import bigrams, ranking

MAP_ONLY = [
    "gsm_prompt", "sft_labelled", "sft_positional", "sft_qa", "sft_code", "sft_rendered", "cand_arc",
    "cand_mmlu", "cand_csqa", "token_logprob",
]
ACTIONS = {  # these write before they return a plan
    "summary_read", "leaderboard", "detail_round_trip", "jsonl_round_trip",
    "pairs_round_trip", "write_once", "arrow_scan", "load_task_arrow", "load_answers", "evaluate_choices_job",
    "training_rows", "damaged_dataset_reported", "model_results_replaced", "arrow_stream_scan", "arrow_index_scan",
    "generator_resumed",
}
PYTHON = {"generator_pandas", "scorer_pandas", "scorer_batched", "mc_accuracy_failed_left_out", "summary_text"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", MAP_ONLY)
def test_map_only(spark, folder, name):
    assert "Exchange" not in plan(QUERIES[name](spark, folder))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - ACTIONS))
def test_no_python_no_cross_join(spark, folder, name):
    text = plan(QUERIES[name](spark, folder))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", text)
    if name not in PYTHON:
        assert not re.search("Python|Pandas|InArrow", text)


@pytest.mark.parametrize("name", ["mixture_shuffle", "batch_plan", "chat_render_template", "mc_predict", "latest_run"])
def test_rows_are_not_gathered_in_one_task(spark, folder, name):
    """A single-partition exchange only ever follows an aggregate: a histogram or one row."""
    lines = plan(QUERIES[name](spark, folder)).splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            assert "HashAggregate" in lines[i + 1]


def test_cap_does_not_sort_the_rows(spark, folder):
    df = ranking.sample_cap(spark.read.parquet(f"{folder}/lineitem.parquet"), ["l_orderkey", "l_linenumber"])
    main, subquery = plan(df).split("Subquery", 1)
    assert "Exchange" not in main and "TakeOrdered" not in subquery and "rangepartitioning" not in subquery


def test_sample_does_not_shuffle_its_rows(spark, folder):
    df = ranking.sample_fraction(spark.read.parquet(f"{folder}/documents.parquet"), ["doc_id"])
    main = plan(df).split("Subquery")[0]
    assert "Exchange" not in main
    scans = re.findall(r"ReadSchema: (\S+)", plan(df))
    assert sum("text" in s for s in scans) == 1 and all(s == "struct<doc_id:bigint>" for s in scans if "text" not in s)


def test_subject_filter_reaches_the_partitions(spark, views, tmp_path):
    from tablewright.operators import mixing

    views.mmlu().write.partitionBy("subject").parquet(str(tmp_path / "m"))
    df = mixing.only_subjects(spark.read.parquet(str(tmp_path / "m")), ["sociology", "virology"])
    assert "PartitionFilters: [subject" in plan(df) and df.select("subject").distinct().count() == 2


def test_hot_pair_is_split_by_adaptive_execution(spark):
    """One pair holds nearly all rows of the join; its partition is read in several pieces."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        items = spark.range(4000, numPartitions=8).select(
            F.lit("d").alias("dataset"), F.lit("").alias("subset"), F.col("id").alias("example_id"),
            F.lit(0).alias("label"), F.lit("start").alias("context"),
            F.array(F.lit(" the end the end the end"), F.concat(F.lit(" w"), F.col("id").cast("string"), F.lit(" x"))).alias("candidates"),
        )
        model = bigrams.BigramModel(spark.createDataFrame([("the end of the day",), ("the end the end",)], "text string"))
        scored = bigrams.bigram_scores(items, model)
        rows = scored.collect()
        assert "skewed" in scored._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    plain = {(r.example_id, r.cand): r.score for r in bigrams.bigram_scores(items, model).collect()}
    assert len(rows) == 8000
    assert all(abs(r.score - plain[(r.example_id, r.cand)]) < 1e-9 for r in rows)
