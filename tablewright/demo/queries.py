"""The registered queries: every operator over the driver tables."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.demo.staging import damage_first_file, stage_arrow_files
from tablewright.demo.views import KEYS, Views
from tablewright.functions.text import percent_text
from tablewright.operators import (
    answers,
    bigrams,
    budget,
    candidates,
    chat,
    formatting,
    inspection,
    metrics,
    mixing,
    preference,
    quarantine,
    ranking,
    results,
    runs,
    scoring,
)
from tablewright.plans import choice_eval, jobs, training_mixture
from tablewright.session import fresh_path
from tablewright.sources import cache, files, readers, sinks
from tablewright.sources.arrow_files import index_arrow_files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    QUERIES[build.__name__] = lambda spark, folder: build(Views(spark, folder))
    return build


# -- generated answers -------------------------------------------------------


def _graded(v: Views) -> DataFrame:
    return answers.grade(
        answers.attach_predictions(v.gsm(), v.gsm_predictions(), "example_id"), "example_id"
    )


@query
def gsm_prompt(v):
    return v.gsm().select("example_id", answers.reasoning_prompt(F.col("question")).alias("prompt"))


@query
def gsm_extract(v):
    return _graded(v).select("example_id", "extracted_pred", "extracted_target")


@query
def gsm_match(v):
    return _graded(v).select("example_id", "correct")


@query
def gsm_detail(v):
    return _graded(v)


@query
def gsm_accuracy(v):
    return answers.answer_accuracy(_graded(v), "GSM8K")


def read_back_numbers(prompts: list[str]) -> list[str]:
    """A generator that computes the answer from the two numbers of the prompt."""
    numbers = [[int(n) for n in re.findall(r"\d+", p)] for p in prompts]
    return [f"So it is {n[0] * 1000 + n[1]:,}." for n in numbers]


@query
def generator_pandas(v):
    return answers.grade(
        answers.attach_generator(v.gsm(), "example_id", read_back_numbers), "example_id"
    )


@query
def generator_resumed(v):
    """A second run meets the texts of the first, which had every other question, and generates the others only."""
    store = fresh_path(v.spark, "texts")
    half = v.gsm().where("example_id % 2 = 0")
    answers.attach_stored_generator(half, "example_id", read_back_numbers, "baseline", store)
    nothing = lambda prompts: ["Nothing."] * len(prompts)
    return answers.attach_stored_generator(v.gsm(), "example_id", nothing, "baseline", store, commit_rows=4000).select(
        "example_id", "prediction"
    )


@query
def pass_at_k(v):
    return metrics.pass_at_k(v.table("events"), "user_id", F.col("event_type") == "click", k=3).select(
        "user_id", "n", "c", F.round("pass_at_k", 6).alias("pass_at_k")
    )


@query
def pass_at_1_mean(v):
    per_task = metrics.pass_at_k(v.table("events"), "user_id", F.col("event_type") == "click")
    return metrics.mean_pass_at_k(per_task).select("n_tasks", F.round("pass_at_k", 6).alias("pass_at_k"))


# -- sampling, union, order --------------------------------------------------


@query
def sample_fraction(v):
    return ranking.sample_fraction(v.table("documents"), ["doc_id"])


@query
def sample_cap(v):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "quantity"]
    rows = v.table("lineitem").withColumn("quantity", F.col("l_quantity").cast("bigint"))
    return ranking.sample_cap(rows.select(*keys, "l_extendedprice"), keys)


@query
def sample_cap_noop(v):
    # more rows than the cap are only there at larger scale factors
    return ranking.sample_cap(v.table("part").select("p_partkey", "p_name"), ["p_partkey"], cap=25_000)


def _mixture(v: Views) -> DataFrame:
    return training_mixture.mixture(v.spark, v.mixture_inputs())


@query
def mixture_union(v):
    return _mixture(v)


@query
def mixture_counts(v):
    return mixing.source_counts(_mixture(v))


@query
def mixture_shuffle(v):
    return ranking.with_position(_mixture(v), ["source", "id"])


# -- formatting --------------------------------------------------------------


@query
def sft_labelled(v):
    both = [formatting.to_pairs(df, formatting.multiple_choice, "example_id") for df in (v.arc(), v.csqa())]
    return mixing.combine({"science": both[0], "commonsense": both[1]})


@query
def sft_positional(v):
    return formatting.to_pairs(v.mmlu(), formatting.multiple_choice, "example_id")


@query
def sft_qa(v):
    return formatting.to_pairs(v.gsm(), formatting.worked_answer, "example_id")


@query
def sft_code(v):
    return formatting.to_pairs(v.code(), formatting.code_pair, "id")


@query
def sft_rendered(v):
    chats = formatting.to_messages(v.arc(), formatting.multiple_choice, "example_id")
    return chats.select("example_id", chat.render_messages(F.col("messages")).alias("text"))


# -- preference pairs --------------------------------------------------------


@query
def dpo_pairs(v):
    return preference.preference_pairs(v.hella(), "example_id")


@query
def dpo_pairs_wrapped(v):
    return preference.in_chat_markers(preference.preference_pairs(v.hella_damaged(), "example_id"))


@query
def preference_metrics(v):
    table = preference.preference_metrics(v.pairs_scored(), ["l_returnflag", "l_linestatus"])
    rounded = {c: F.round(c, 5) for c in ("margin", "loss", "accuracy")}
    return table.withColumns(rounded)


# -- chat rendering, limits, batches -----------------------------------------


@query
def chat_render(v):
    return chat.render_turns(v.table("conversations"))


@query
def chat_render_prompted(v):
    return chat.render_turns(v.table("conversations"), generation_prompt=True)


@query
def chat_render_batched(v):
    return chat.render_batches(v.batches(), "doc_id")


@query
def chat_render_template(v):
    return chat.render_template(v.turns_extra())


@query
def chat_render_template_prompted(v):
    return chat.render_template(v.turns_extra(), generation_prompt=True, thinking=False)


@query
def bad_turns(v):
    """Conversations left out for turns without role or text."""
    conv, turn = F.col("conv_id"), F.col("turn")
    turns = v.turns_extra().withColumns(
        {
            "role": F.when((conv % 17 == 3) & (turn == 1), None).otherwise(F.col("role")),
            "text": F.when((conv + turn) % 11 == 0, None).otherwise(F.col("text")),
        }
    )
    return chat.bad_turns(turns)


@query
def length_budget(v):
    return budget.limit_length(v.documents().select("doc_id", "text")).drop("text")


@query
def pair_budget(v):
    return budget.limit_pair(preference.preference_pairs(v.hella(), "example_id"), "example_id")


@query
def pair_cut(v):
    return budget.cut_pair(preference.preference_pairs(v.hella(), "example_id"))


@query
def length_report(v):
    return budget.length_report(v.documents(), "source")


@query
def batch_plan(v):
    return budget.batch_plan(v.table("documents"), ["doc_id"])


# -- multiple choice ---------------------------------------------------------


def _shown(items: DataFrame) -> DataFrame:
    return candidates.one_per_row(items).drop("dataset", "subset")


@query
def cand_arc(v):
    return _shown(candidates.arc(v.arc()))


@query
def cand_piqa(v):
    return _shown(candidates.piqa(v.piqa()))


@query
def cand_mmlu(v):
    return candidates.one_per_row(candidates.mmlu(v.mmlu())).drop("dataset")


@query
def cand_hellaswag(v):
    return _shown(candidates.hellaswag(v.hella()))


@query
def cand_csqa(v):
    return _shown(candidates.commonsense_qa(v.csqa()))


@query
def cand_winogrande(v):
    return _shown(candidates.winogrande(v.wino()))


@query
def debug_head(v):
    return _shown(candidates.arc(candidates.first_rows(v.arc(), "example_id")))


@query
def token_logprob(v):
    lp = scoring.token_log_prob(F.col("embedding"), F.col("label"))
    return v.table("embeddings").select("vec_id", F.round(lp, 6).alias("lp"))


def _token_log_probs(v: Views) -> DataFrame:
    lp = scoring.token_log_prob(F.col("embedding"), F.col("target"))
    return v.tokens().withColumn("lp", lp).drop("embedding", "target")


def _token_scores(v: Views, mode: str) -> DataFrame:
    scores = scoring.candidate_scores(_token_log_probs(v), ["example_id", "cand"], mode)
    return scores.withColumn("score", F.round("score", 5))


@query
def cand_score_reference(v):
    return _token_scores(v, "reference")


@query
def cand_score_exact(v):
    return _token_scores(v, "exact")


@query
def token_predict(v):
    """Hellaswag-like items scored by a table of token log-probabilities; most have none."""
    items = candidates.one_per_row(candidates.hellaswag(v.hella()))
    scored = scoring.attach_token_scores(items, _token_log_probs(v), ["example_id", "cand"])
    rounded = scored.withColumn("score", F.round("score", 5))
    return scoring.predict(rounded).drop("dataset", "subset")


@query
def bigram_score(v):
    items = candidates.hellaswag(v.hella())
    scored = bigrams.bigram_scores(items, bigrams.BigramModel(v.documents()))
    return scored.select("example_id", "cand", F.round("score", 4).alias("score"))


@query
def bigram_score_exact(v):
    items = candidates.mmlu(v.mmlu())
    scored = bigrams.bigram_scores(items, bigrams.BigramModel(v.documents()), mode="exact")
    return scored.select("example_id", "cand", F.round("score", 4).alias("score"))


def vowels_per_length(context: str | None, texts: list[str | None]) -> list[float]:
    """A scorer without a model: the share of ``a`` in context and candidate.

    As in the SQL, 0 / 0 of two empty texts comes before all numbers, and a missing text after them.
    """
    return [_share_of_a(context + t) if context is not None and t is not None else math.nan for t in texts]


def _share_of_a(text: str) -> float:
    return text.count("a") / len(text) if text else math.inf


@query
def scorer_pandas(v):
    scored = scoring.attach_scorer(candidates.hellaswag(v.hella()), vowels_per_length)
    return scoring.predict(scored).drop("dataset", "subset")


@query
def scorer_batched(v):
    """The same scores from a function of many items at once, of like length."""
    together = lambda groups: [vowels_per_length(*group) for group in groups]
    scored = scoring.attach_batch_scorer(candidates.hellaswag(v.hella()), together)
    return scoring.predict(scored).drop("dataset", "subset")


def _bigram_predictions(v: Views) -> DataFrame:
    return choice_eval.bigram_predictions(v.tasks(), v.documents())


@query
def mc_predict(v):
    return _bigram_predictions(v)


@query
def mc_accuracy(v):
    return choice_eval.dataset_accuracy(_bigram_predictions(v), candidates.TASKS)


@query
def mc_accuracy_subject(v):
    return choice_eval.subject_accuracy(_bigram_predictions(v))


@query
def mc_accuracy_failed_left_out(v):
    tables = {**v.tasks(), "HellaSwag": v.hella_damaged()}
    scored = scoring.attach_scorer(candidates.all_candidates(tables), vowels_per_length)
    summary = choice_eval.dataset_accuracy(scoring.predict(scored), tables)
    unreadable = quarantine.unreadable_label(F.col("label"))
    return metrics.leave_out_failed(summary, quarantine.bad_rows([("HellaSwag", tables["HellaSwag"], unreadable)]))


def _staged_tasks(v: Views) -> str:
    """A folder of Arrow datasets as they are published: several configurations, splits and shards."""
    root = fresh_path(v.spark, "datasets")
    _stage_arc(v, root)
    stage_arrow_files(v.piqa().drop("example_id"), f"{root}/baber___piqa", "piqa-validation")
    stage_arrow_files(v.mmlu().drop("example_id"), f"{root}/cais___mmlu", "mmlu-test", by="subject")
    # some labels are unreadable
    stage_arrow_files(v.hella_damaged().drop("example_id"), f"{root}/Rowan___hellaswag/default", "hellaswag-validation")
    stage_arrow_files(v.csqa().drop("example_id"), f"{root}/tau___commonsense_qa/default", "csqa-validation", indexed=True)
    stage_arrow_files(v.wino().drop("example_id"), f"{root}/winogrande/winogrande_xl", "wino-validation")
    return root


def _stage_arc(v: Views, root: str) -> None:
    """Two configurations of which one counts, and two splits of which one does."""
    arc = v.arc().drop("example_id").withColumn("id", F.lit("own"))
    stage_arrow_files(arc, f"{root}/allenai___ai2_arc/ARC-Challenge", "arc-test", indexed=True)
    stage_arrow_files(arc.limit(7), f"{root}/allenai___ai2_arc/ARC-Challenge", "arc-train")
    stage_arrow_files(arc.limit(9), f"{root}/allenai___ai2_arc/ARC-Easy", "arc-test")


@query
def load_task_arrow(v):
    root = fresh_path(v.spark, "datasets")
    _stage_arc(v, root)
    loaded = candidates.arc(cache.load_tasks(v.spark, root)["ARC"])
    return candidates.one_per_row(loaded).select("label", "context", "cand", "candidate")


@query
def load_answers(v):
    """The test split of the first configuration only."""
    root = fresh_path(v.spark, "datasets")
    rows = v.gsm().select("question", "answer", (F.col("example_id") % 3 == 0).alias("held"))
    stage_arrow_files(rows.where("held").drop("held"), f"{root}/gsm8k/main", "gsm8k-test")
    stage_arrow_files(rows.where("not held").drop("held"), f"{root}/gsm8k/main", "gsm8k-train")
    stage_arrow_files(rows.where("held").drop("held"), f"{root}/gsm8k/socratic", "gsm8k-test")
    return cache.load_answers(v.spark, root).select("question", "answer")


@query
def evaluate_choices_job(v):
    """The whole job over staged folders: its summary read back, and what it left out."""
    summary = fresh_path(v.spark, "summary")
    bad = jobs.evaluate_choices(v.spark, _staged_tasks(v), vowels_per_length, results.MODELS[0], summary)
    return _with_failures(sinks.read_summaries(v.spark, summary), bad)


def _with_failures(summary: DataFrame, bad: DataFrame) -> DataFrame:
    return summary.select("dataset", "value").unionByName(bad, allowMissingColumns=True)


@query
def damaged_dataset_reported(v):
    """One dataset has a file cut short, another a scorer that fails on it; the third is evaluated."""
    root, summary = fresh_path(v.spark, "datasets"), fresh_path(v.spark, "summary")
    _stage_arc(v, root)
    stage_arrow_files(v.piqa().drop("example_id"), f"{root}/baber___piqa", "piqa-validation", batch_rows=100)
    damage_first_file(f"{root}/baber___piqa")
    stage_arrow_files(v.mmlu().drop("example_id"), f"{root}/cais___mmlu", "mmlu-test", by="subject")

    def scorer(context: str, texts: list[str]) -> list[float]:
        if len(texts) > 4:  # a few items of a subject
            raise RuntimeError("too many candidates")
        return vowels_per_length(context, texts)

    bad = jobs.evaluate_choices(v.spark, root, scorer, results.MODELS[0], summary)
    kinds = bad.withColumn("reason", F.substring_index("reason", ":", 2))
    kinds = kinds.withColumn("reason", F.when(F.col("dataset") == "PIQA", F.substring_index("reason", ":", 1)).otherwise(F.col("reason")))
    return _with_failures(sinks.read_summaries(v.spark, summary), kinds)


@query
def bad_rows(v):
    hella, mmlu = v.hella_damaged(), v.mmlu().withColumn("answer", F.col("answer") * 3)
    return quarantine.bad_rows(
        [
            ("HellaSwag", hella, quarantine.continuation_problem(F.col("endings"), F.col("label"))),
            ("MMLU", mmlu, quarantine.positional_problem(F.col("choices"), F.col("answer"))),
        ]
    )


# -- results and runs --------------------------------------------------------


def _accuracies(v: Views) -> DataFrame:
    table = metrics.choice_accuracy(v.results(), ["model", "dataset", "subset"])
    name = metrics.display_name(F.col("dataset"), F.col("subset"))
    return table.select("model", name.alias("dataset"), "accuracy")


@query
def summary_text(v):
    return _accuracies(v).select("model", "dataset", percent_text("accuracy").alias("accuracy"))


def _written_summaries(v: Views) -> DataFrame:
    """Both kinds of summary in one folder, read back."""
    path = fresh_path(v.spark, "results")
    sinks.write_summary(sinks.choice_summary(_accuracies(v)), f"{path}/choices")
    graded = answers.answer_accuracy(_graded(v), "GSM8K").withColumn("model", F.lit(results.MODELS[0]))
    sinks.write_summary(sinks.metric_summary(graded), f"{path}/answers")
    return sinks.read_summaries(v.spark, path)


@query
def summary_read(v):
    return _written_summaries(v)


@query
def leaderboard(v):
    board = results.leaderboard(_written_summaries(v))
    values = board.columns[2:]
    return board.select("dataset", "metric", *(F.round(c, 8).alias(c) for c in values))


@query
def leaderboard_pivot(v):
    """A leaderboard of figures that are tables already, without files."""
    figures = _accuracies(v).select("model", "dataset", F.lit(sinks.ACCURACY).alias("metric"), F.col("accuracy").alias("value"))
    board = results.leaderboard(figures, results.MODELS)
    return board.select("dataset", "metric", *(F.round(c, 8).alias(c) for c in board.columns[2:]))


@query
def detail_round_trip(v):
    path = fresh_path(v.spark, "detail")
    detail = _graded(v)
    sinks.write_detail(detail.withColumn("model", F.lit("baseline")), path)
    schema = "model string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in detail.schema)
    return readers.read_jsonl(v.spark, path, schema)


@query
def model_results_replaced(v):
    """Results of two models are written again: one has fewer rows then, the other none."""
    path = fresh_path(v.spark, "detail")
    graded = _graded(v).select("example_id", "correct")
    models = F.explode(F.array(*map(F.lit, results.MODELS[:3])))
    sinks.write_detail(graded.withColumn("model", models), path)
    again = graded.where("correct").withColumn("model", F.lit(results.MODELS[0]))
    sinks.write_detail(again, path, results.MODELS[:2])
    return sinks.read_detail(v.spark, path, "model string, example_id bigint, correct boolean")


@query
def latest_run(v):
    return runs.latest_run(v.run_entries())


@query
def latest_final_run(v):
    return runs.latest_run(v.run_entries(), checkpoints=False)


# -- sources and sinks -------------------------------------------------------


@query
def resolve_split(v):
    return _chosen(files.resolve_split(v.files()))


@query
def resolve_suffix(v):
    return _chosen(files.resolve_split(v.files(), ["train"], "suffix", "none"))


@query
def resolve_fallback(v):
    return _chosen(files.resolve_split(v.files(), ["test", "dev"], "suffix", "none"))


@query
def resolve_any(v):
    return _chosen(files.resolve_split(v.files(), []))


def _chosen(table: DataFrame) -> DataFrame:
    return table.select("dataset", "subset", "path", "n_files")


@query
def split_files(v):
    return files.files_of_split(v.files(), ["train"], fall_back_to_all=True)


@query
def table_profile(v):
    tables = {name: (v.table(name), keys) for name, keys in KEYS.items()}
    # whole numbers, which every engine spells alike
    millionths = F.expr("transform(embedding, x -> cast(round(cast(x as double) * 1000000) as bigint))")
    tables["embeddings"] = (v.table("embeddings").withColumn("embedding", millionths), KEYS["embeddings"])
    return inspection.profile_tables(tables)


@query
def arrow_scan(v):
    path = fresh_path(v.spark, "arrow")
    stage_arrow_files(
        v.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), path
    )
    return readers.read_columnar(v.spark, path, format="arrow_files")


def _staged_orders(v: Views) -> str:
    """Streams of many small batches."""
    path = fresh_path(v.spark, "arrow")
    orders = v.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    stage_arrow_files(orders.sort("o_orderkey"), path, batch_rows=500)
    return path


@query
def arrow_stream_scan(v):
    """Streams cut into ranges of bytes, each read by a task of its own."""
    read = readers.read_columnar(v.spark, _staged_orders(v), format="arrow_files", split_bytes=str(1 << 14))
    return read.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query
def arrow_index_scan(v):
    """Streams read by an index of their batches, of which filters leave a few."""
    path, index = _staged_orders(v), fresh_path(v.spark, "index")
    index_arrow_files(v.spark, path, index, ["o_orderkey", "o_orderstatus"])
    read = readers.read_columnar(v.spark, path, format="arrow_files", index=index)
    highest = v.table("orders").agg(F.max("o_orderkey")).head()[0]
    return read.where((F.col("o_orderkey") > highest // 2) & (F.col("o_orderkey") <= highest // 2 + 2000))


@query
def jsonl_round_trip(v):
    path = fresh_path(v.spark, "mixture")
    training_mixture.write_mixture(_mixture(v), path)
    chats = readers.read_jsonl(v.spark, path, readers.MIXTURE_SCHEMA)
    return chats.select(
        F.expr("messages[0].content").alias("prompt"), F.expr("messages[1].content").alias("target")
    )


@query
def training_rows(v):
    """From a written mixture to rendered, cut and batched rows."""
    path = fresh_path(v.spark, "mixture")
    training_mixture.write_mixture(_mixture(v), path)
    return training_mixture.training_rows(readers.read_jsonl(v.spark, path, readers.MIXTURE_SCHEMA), limit=20)


@query
def pairs_round_trip(v):
    path = fresh_path(v.spark, "pairs")
    pairs = preference.in_chat_markers(preference.preference_pairs(v.hella(), "example_id"))
    sinks.write_jsonl(pairs.drop("example_id"), path)
    return readers.read_jsonl(v.spark, path, readers.PAIR_SCHEMA)


@query
def write_once(v):
    """The second write finds the output and leaves it alone."""
    path = fresh_path(v.spark, "once")
    sinks.write_once(v.table("orders").select("o_orderkey", "o_custkey"), path)
    sinks.write_once(v.table("orders").select("o_orderkey", F.lit(-1).cast("bigint").alias("o_custkey")), path)
    return readers.read_jsonl(v.spark, path, "o_orderkey bigint, o_custkey bigint")


@query
def missing_input_skipped(v):
    found, missing = readers.read_available(
        v.spark, {n: f"{v.folder}/{n}.parquet" for n in ("orders", "no_such_table", "part")}
    )
    keyed = {name: df.select(F.col(df.columns[0]).alias("id")) for name, df in found.items()}
    return mixing.source_counts(mixing.combine(keyed)).withColumn("n_missing", F.lit(len(missing)))
