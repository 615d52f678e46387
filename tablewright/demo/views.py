"""Stand-ins for question-answering datasets, derived row by row from the driver tables.

Each view covers its whole table and whole texts; ``sql_views`` holds the same
views in SQL for the oracles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.hashing import draw
from tablewright.operators.mixing import TRAINING_SUBJECTS
from tablewright.operators.results import MODELS

# Subjects that are evaluated but not used for training.
OTHER_SUBJECTS = ["abstract_algebra", "anatomy", "astronomy", "virology", "world_religions"]
SUBJECTS = TRAINING_SUBJECTS + OTHER_SUBJECTS

# Columns that order a table.
KEYS = {
    "region": ["r_regionkey"],
    "nation": ["n_nationkey"],
    "customer": ["c_custkey"],
    "supplier": ["s_suppkey"],
    "part": ["p_partkey"],
    "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
    "events": ["event_id"],
    "documents": ["doc_id"],
    "embeddings": ["vec_id"],
    "pages": ["page_id"],
    "benchmark": ["item_id"],
    "labels": ["doc_id"],
    "conversations": ["conv_id", "turn"],
}


class Views:
    """The views over one folder of driver tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def documents(self) -> DataFrame:
        return self.table("documents")

    # -- documents ---------------------------------------------------------

    def _cut(self, parts: int) -> tuple[DataFrame, Callable[[int | Column], Column]]:
        """Documents and the expression of the i-th of ``parts`` equal consecutive parts of a text."""
        rows = self.documents().select(
            F.col("doc_id").alias("example_id"),
            "text",
            F.expr(f"(length(text) + {parts - 1}) div {parts}").cast("int").alias("_s"),
        )
        return rows, lambda i: F.substring("text", 1 + i * F.col("_s"), F.col("_s"))

    def hella(self) -> DataFrame:
        """Fifths of a text: the context and four endings, the true one at the label."""
        rows, part = self._cut(5)
        label = draw("lab", "example_id", 4).cast("int")
        endings = F.array(*(part(1 + F.pmod(F.lit(i) - label, F.lit(4))) for i in range(4)))
        return rows.select(
            "example_id", part(0).alias("ctx"), endings.alias("endings"), label.cast("string").alias("label")
        )

    def hella_damaged(self) -> DataFrame:
        """The same with some unlabelled rows, labels out of range and single endings."""
        kind = F.col("example_id") % 17
        return self.hella().select(
            "example_id",
            "ctx",
            F.when(kind == 2, F.slice("endings", 1, 1)).otherwise(F.col("endings")).alias("endings"),
            F.when(kind == 0, F.lit(""))
            .when(kind == 1, F.lit("7"))
            .when(kind == 2, F.lit("0"))
            .otherwise(F.col("label"))
            .alias("label"),
        )

    def piqa(self) -> DataFrame:
        """Thirds of a text: the goal and two solutions, the true one at the label."""
        rows, part = self._cut(3)
        label = draw("piqa", "example_id", 2).cast("int")
        return rows.select(
            "example_id",
            part(0).alias("goal"),
            part(1 + label).alias("sol1"),
            part(2 - label).alias("sol2"),
            label.alias("label"),
        )

    def wino(self) -> DataFrame:
        """Quarters of a text: a sentence with none, one or two blanks, and two options."""
        rows, part = self._cut(4)
        kind = F.col("example_id") % 20
        middle = F.when(kind == 1, F.lit("")).otherwise(F.lit("_"))
        tail = F.when(kind == 0, F.concat(F.lit("_"), part(2))).otherwise(F.lit(""))
        side = (draw("wino", "example_id", 2) + 1).cast("string")
        return rows.select(
            "example_id",
            F.concat(part(0), middle, part(1), tail).alias("sentence"),
            part(2).alias("option1"),
            part(3).alias("option2"),
            F.when(F.col("example_id") % 25 == 0, F.lit("")).otherwise(side).alias("answer"),
        )

    def batches(self) -> DataFrame:
        """Each text as a batch of up to three conversations; every fourth batch is empty."""
        rows = self.documents().select(
            "doc_id", "text", F.expr("doc_id % 4").alias("c"),
            F.expr("(length(text) + 2 * greatest(doc_id % 4, 1) - 1) div (2 * greatest(doc_id % 4, 1))").alias("s"),
        )
        messages = """
            transform(slice(sequence(0L, 2L), 1, cast(c as int)), i -> array(
                struct('user' as role, substring(text, cast(1 + 2 * i * s as int), cast(s as int)) as content),
                struct('assistant' as role, substring(text, cast(1 + (2 * i + 1) * s as int), cast(s as int)) as content)
            ))"""
        return rows.select("doc_id", F.expr(messages).alias("messages"))

    def files(self) -> DataFrame:
        """One data file per document: (dataset, subset, path), some folders empty."""
        split = F.element_at(
            F.array(*map(F.lit, ["validation", "test", "train", "train", "dev", "data"])),
            (draw("split", "doc_id", 6) + 1).cast("int"),
        )
        shard = F.when(draw("shard", "doc_id", 2) == 0, F.lit("")).otherwise(F.lit("-00000-of-00002"))
        folder = F.concat(F.lit("cache/"), "source", F.lit("/"), "subset", F.lit("/set"))
        path = F.concat(folder, F.col("doc_id").cast("string"), F.lit("-"), split, shard, F.lit(".arrow"))
        named = self.table("documents").select(
            "doc_id", "source", F.concat("lang", F.lit("-"), (F.col("doc_id") % 3).cast("string")).alias("subset")
        )
        return named.select(
            F.col("source").alias("dataset"),
            "subset",
            F.when(~((F.col("doc_id") % 3 == 2) & F.col("subset").startswith("de")), path).alias("path"),
        )

    # -- part --------------------------------------------------------------

    def _brand(self, step: int, choices: int) -> Column:
        text = f"concat('Brand#', cast(1 + (p_partkey + {step} * i) % 25 as string), ' ', p_type)"
        return F.expr(f"transform(sequence(0, {choices - 1}), i -> {text})")

    def _question(self) -> Column:
        return F.concat(
            F.lit("Which brand makes the "), "p_name", F.lit(" number "), F.col("p_partkey").cast("string"), F.lit("?")
        )

    def arc(self) -> DataFrame:
        """Four choices with letter or digit labels; some keys name no choice."""
        key = F.col("p_partkey")
        labels = F.expr(
            "if(p_partkey % 10 = 0, array('1', '2', '3', '4'), array('A', 'B', 'C', 'D'))"
        )
        answer = (
            F.when(key % 50 == 7, F.lit("F"))
            .when(key % 50 == 9, F.lit("E"))
            .when(key % 50 == 10, F.lit("5"))
            .otherwise(F.get(labels, draw("arc", "p_partkey", 4).cast("int")))
        )
        return self.table("part").select(
            key.alias("example_id"),
            self._question().alias("question"),
            F.struct(self._brand(7, 4).alias("text"), labels.alias("label")).alias("choices"),
            answer.alias("answerKey"),
        )

    def csqa(self) -> DataFrame:
        """Five lettered choices; some keys are digits."""
        letters = F.expr("array('A', 'B', 'C', 'D', 'E')")
        pick = draw("csqa", "p_partkey", 5)
        answer = F.when(F.col("p_partkey") % 10 == 0, (pick + 1).cast("string")).otherwise(
            F.get(letters, pick.cast("int"))
        )
        return self.table("part").select(
            F.col("p_partkey").alias("example_id"),
            self._question().alias("question"),
            F.struct(self._brand(3, 5).alias("text"), letters.alias("label")).alias("choices"),
            answer.alias("answerKey"),
        )

    def mmlu(self) -> DataFrame:
        """Four or eight choices with an integer answer, by subject."""
        key = F.col("p_partkey")
        subject = F.get(F.array(*map(F.lit, SUBJECTS)), draw("subj", "p_partkey", len(SUBJECTS)).cast("int"))
        answer = F.when(key % 100 == 3, F.lit(-1)).otherwise(draw("mmlu", "p_partkey", 4).cast("int"))
        choices = F.when(key % 100 == 5, self._brand(2, 8)).otherwise(self._brand(2, 4))
        return self.table("part").select(
            key.alias("example_id"),
            subject.alias("subject"),
            self._question().alias("question"),
            choices.alias("choices"),
            answer.alias("answer"),
        )

    # -- orders ------------------------------------------------------------

    def _gsm_rows(self) -> DataFrame:
        value = (F.col("o_custkey") * 1000 + F.col("o_orderkey")).cast("bigint")
        return self.table("orders").select(
            F.col("o_orderkey").alias("example_id"), "o_custkey", value.alias("value")
        )

    def gsm(self) -> DataFrame:
        question = F.concat(
            F.lit("Customer "),
            F.col("o_custkey").cast("string"),
            F.lit(" places order "),
            F.col("example_id").cast("string"),
            F.lit(". What is a thousand times the first number plus the second?"),
        )
        answer = F.concat(F.lit("We multiply, then we add.\n#### "), F.format_number("value", 0))
        return self._gsm_rows().select("example_id", question.alias("question"), answer.alias("answer"))

    def gsm_predictions(self) -> DataFrame:
        """Texts with a right or wrong number or none; a fifth of the items have no row."""
        kind = draw("gsm", "example_id", 5)
        value = F.col("value").cast("string")
        text = (
            F.when(kind == 0, F.concat(F.lit("1 step.\n#### "), F.format_number("value", 0)))
            .when(kind == 1, F.concat(F.lit("I get 12 first and then "), value, F.lit(" in all.")))
            .when(kind == 2, F.concat(F.lit("The answer is "), (F.col("value") + 1).cast("string"), F.lit(".")))
            .otherwise(F.lit("I cannot tell."))
        )
        return self._gsm_rows().where(kind < 4).select("example_id", text.alias("prediction"))

    # -- other tables ------------------------------------------------------

    def code(self) -> DataFrame:
        return self.table("pages").select(
            F.col("page_id").alias("id"),
            F.concat(F.lit("Write the page at "), "url").alias("instruction"),
            F.col("html").alias("output"),
        )

    def tokens(self) -> DataFrame:
        """Eight vectors as the logits of one candidate, four candidates per item."""
        sequence = F.expr("vec_id div 8")
        return self.table("embeddings").select(
            F.expr("vec_id div 32").alias("example_id"),
            F.expr("cast((vec_id div 8) % 4 as int)").alias("cand"),
            F.expr("cast(vec_id % 8 as int)").alias("pos"),
            (draw("ctx", sequence, 8) + 1).cast("int").alias("ctx_len"),
            "embedding",
            F.col("label").alias("target"),
        )

    def pairs_scored(self) -> DataFrame:
        return self.table("lineitem").select(
            "l_returnflag",
            "l_linestatus",
            (-F.col("l_quantity")).alias("policy_chosen"),
            (-F.col("l_quantity") - 20 * F.col("l_discount")).alias("reference_chosen"),
            (-F.col("l_quantity") * (1 + F.col("l_tax"))).alias("policy_rejected"),
            (-F.col("l_quantity") - 30 * F.col("l_tax")).alias("reference_rejected"),
        )

    def run_entries(self) -> DataFrame:
        """Entries of run directories: a final model or checkpoints, or neither."""
        entry = (
            F.when(F.col("event_id") % 11 == 0, F.lit("final_model"))
            .when(F.col("event_id") % 3 == 0, F.concat(F.lit("checkpoint-"), F.col("event_id").cast("string")))
            .otherwise(F.concat(F.lit("log-"), F.col("event_id").cast("string")))
        )
        return self.table("events").select(
            F.concat("event_type", F.lit("_u"), (F.col("user_id") % 10).cast("string")).alias("prefix"),
            F.concat(F.lit("run-"), F.expr("cast(event_id div 40 as string)")).alias("run_dir"),
            entry.alias("entry"),
            F.col("ts").alias("mtime"),
        )

    def turns_extra(self) -> DataFrame:
        """Conversations with tool runs, reasoning, later system turns and wrapped queries."""
        rows = self.table("conversations")
        conv, turn = F.col("conv_id"), F.col("turn")
        thinks = draw("think", conv * 1000 + turn, 3) == 0
        role = (
            F.when((conv % 5 == 1) & (turn % 4 > 1), F.lit("tool"))
            .when((conv % 7 == 2) & (turn == 2), F.lit("system"))
            .otherwise(F.col("role"))
        )
        text = (
            F.when(
                (F.col("role") == "assistant") & thinks,
                F.concat(F.lit("<think>\nstep "), turn.cast("string"), F.lit("\n</think>\n\n"), "text"),
            )
            .when(
                (F.col("role") == "user") & (conv % 6 == 0) & (turn > 1),
                F.concat(F.lit("<tool_response>"), "text", F.lit("</tool_response>")),
            )
            .otherwise(F.col("text"))
        )
        return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"))

    def results(self) -> DataFrame:
        """Right or wrong per model and item."""
        models = F.explode(F.array(*map(F.lit, MODELS)))
        subjects = self.mmlu().select(
            F.lit("MMLU").alias("dataset"), F.col("subject").alias("subset"), "example_id", F.col("answer").alias("label")
        )
        endings = self.hella().select(
            F.lit("HellaSwag").alias("dataset"), F.lit("").alias("subset"), "example_id", F.col("label").cast("int").alias("label")
        )
        rows = subjects.unionByName(endings).select("*", models.alias("model"))
        guess = F.expr(
            "cast(conv(substr(md5(concat(model, ':', dataset, ':', cast(example_id as string))), 1, 8), 16, 10) as bigint) % 4"
        )
        return rows.withColumn("prediction", guess.cast("int"))

    def tasks(self) -> dict[str, DataFrame]:
        return {
            "ARC": self.arc(),
            "PIQA": self.piqa(),
            "MMLU": self.mmlu(),
            "HellaSwag": self.hella(),
            "CommonsenseQA": self.csqa(),
            "Winogrande": self.wino(),
        }

    def mixture_inputs(self) -> dict[str, DataFrame]:
        named = {"commonsense": self.csqa(), "science": self.arc(), "math": self.gsm(), "subjects": self.mmlu()}
        return {name: df.withColumnRenamed("example_id", "id") for name, df in named.items()}
