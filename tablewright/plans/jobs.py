"""Whole jobs over a folder of datasets: prepare the mixture and the pairs, evaluate a model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators import answers, budget, candidates, metrics, preference, quarantine, scoring
from tablewright.plans import choice_eval, training_mixture
from tablewright.session import fresh_path
from tablewright.sources import cache, readers, sinks

ANSWER_TASK = "GSM8K"


def prepare_mixture(spark: SparkSession, root: str, output: str) -> DataFrame:
    """Write the training mixture of the sources found, unless it is there; the result counts the rows left out."""
    pairs = training_mixture.mixture(spark, cache.load_training_sources(spark, root))
    training_mixture.write_mixture(pairs, output)
    return training_mixture.incomplete_pairs(pairs)


def prepare_training(spark: SparkSession, mixture: str, output: str, **plan) -> None:
    """From the written mixture to rendered, cut and batched training rows, as parquet in batch order."""
    chats = readers.read_jsonl(spark, mixture, readers.MIXTURE_SCHEMA)
    rows = training_mixture.training_rows(chats, **plan)
    rows.orderBy("epoch", "position").write.parquet(output)


def prepare_training_pairs(spark: SparkSession, pairs: str, output: str) -> None:
    """The written pairs with their texts cut to the limits, as JSON lines."""
    sinks.write_jsonl(budget.cut_pair(readers.read_jsonl(spark, pairs, readers.PAIR_SCHEMA)), output)


def prepare_pairs(spark: SparkSession, root: str, output: str) -> DataFrame:
    """Write the preference pairs, unless they are there; the result counts the rows left out."""
    source = cache.load_pair_source(spark, root)
    pairs = preference.in_chat_markers(preference.preference_pairs(source, "example_id"))
    sinks.write_once(pairs.drop("example_id"), output)
    problem = quarantine.continuation_problem(F.col("endings"), F.col("label"))
    return quarantine.bad_rows([("HellaSwag", source, problem)])


def evaluate_choices(
    spark: SparkSession,
    root: str,
    scorer: scoring.Scorer | None,
    model: str,
    output: str,
    debug: bool = False,
    batch_scorer: scoring.BatchScorer | None = None,
    index: str | None = None,
) -> DataFrame:
    """Score every task found and write the model's summary; the result counts what was left out.

    Every item is scored once, by ``scorer`` on its own or by ``batch_scorer`` with others. A dataset, or subject
    of one, is left out where a file or batch of it cannot be read, a label is unreadable or the scorer
    raises an error; the others are not held up. The result has (dataset, reason, n_rows).
    ``debug`` takes the first rows of each task only, or of each of its subjects.
    """
    tables, failed = cache.load_tasks_reporting(spark, root, index)
    if debug:
        tables = {task: _first_rows(df) for task, df in tables.items()}
    bad = quarantine.failed_tasks(spark, failed)
    summary = spark.createDataFrame([], "dataset string, accuracy double")
    if tables:
        items = candidates.all_candidates(tables)
        scored = scoring.attach_batch_scorer(items, batch_scorer) if batch_scorer else scoring.attach_scorer(items, scorer)
        # scored once for the summary and the report; a lost executor costs no scores
        path = fresh_path(spark, "predictions")
        scoring.predict(scored).write.parquet(path)
        predictions = spark.read.parquet(path)
        if candidates.PROBLEM in predictions.columns:
            bad = quarantine.failed_datasets(predictions).unionByName(bad)
            predictions = predictions.where("problem is null").drop("problem")
        summary = metrics.leave_out_failed(choice_eval.whole_summary(predictions, tables), bad)
    sinks.write_summary(sinks.choice_summary(summary.withColumn("model", F.lit(model))), output, [model])
    return bad


def _first_rows(table: DataFrame) -> DataFrame:
    """The first readable rows, and a row for all that cannot be read."""
    if candidates.DAMAGE not in table.columns:
        return candidates.first_rows(table, cache.KEY)
    damaged = F.col(candidates.DAMAGE).isNotNull()
    return candidates.first_rows(table.where(~damaged), cache.KEY).unionByName(table.where(damaged))


def evaluate_answers(
    spark: SparkSession,
    root: str,
    generator: answers.Generator,
    model: str,
    detail_output: str,
    summary_output: str,
    debug: bool = False,
    store: str | None = None,
) -> DataFrame:
    """Generate and grade an answer per question; write the details and the summary.

    The summary is read from the written details, so every text is generated once. With ``store`` the
    texts are kept there, and a repeated run generates only those that are missing. Where a file or batch of the
    dataset cannot be read, nothing is generated or written; the result says so in (dataset, reason, n_rows).
    """
    try:
        items = cache.load_answers(spark, root, report=True)
    except cache.UNREADABLE as error:
        return quarantine.failed_tasks(spark, {ANSWER_TASK: cache.first_line(error)})
    damage = F.col(candidates.DAMAGE)
    bad = items.where(damage.isNotNull()).groupBy(F.lit(ANSWER_TASK).alias("dataset"), damage.alias("reason"))
    bad = bad.agg(F.count("*").alias("n_rows"))
    if not bad.isEmpty():
        return bad
    items = items.drop(candidates.DAMAGE)
    if debug:
        items = candidates.first_rows(items, "example_id")
    if store:
        answered = answers.attach_stored_generator(items, "example_id", generator, model, store)
    else:
        answered = answers.attach_generator(items, "example_id", generator)
    detail = answers.grade(answered, "example_id").drop("example_id").withColumn("model", F.lit(model))
    sinks.write_detail(detail, detail_output, [model])
    written = sinks.read_detail(spark, detail_output, "correct boolean, model string", [model])
    summary = answers.answer_accuracy(written, ANSWER_TASK).withColumn("model", F.lit(model))
    sinks.write_summary(sinks.metric_summary(summary), summary_output, [model])
    return bad
