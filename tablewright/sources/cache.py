"""Datasets in a folder per dataset and subset, as Arrow or parquet files.

Which files a dataset gives is decided over their names alone; they are then one
scan. Keys hold paths below the root, so seeded choices stay the same where the
folder is moved.
"""

from __future__ import annotations

import re
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators.mixing import TRAINING_SUBJECTS
from tablewright.sources import files, readers
from tablewright.sources.arrow_files import DAMAGE

# Folder of each evaluated task, and of the worked answers.
TASK_FOLDERS = {
    "ARC": "allenai___ai2_arc",
    "PIQA": "baber___piqa",
    "MMLU": "cais___mmlu",
    "HellaSwag": "Rowan___hellaswag",
    "CommonsenseQA": "tau___commonsense_qa",
    "Winogrande": "winogrande",
}
ANSWER_FOLDER = "gsm8k"

# Folder, subset and splits of each training source, first choice first.
TRAINING_SOURCES = {
    "commonsense": ("tau___commonsense_qa", ["default"], ["train"]),
    "science": ("allenai___ai2_arc", ["ARC-Challenge"], ["train"]),
    "math": (ANSWER_FOLDER, ["main"], ["train"]),
    "subjects": ("cais___mmlu", TRAINING_SUBJECTS, ["test", "dev"]),
}

EXTENSIONS = [".arrow", ".parquet"]
# What is raised for a dataset of which nothing can be read, or that is not there.
UNREADABLE = (PySparkException, Py4JJavaError, OSError, ValueError)
# Columns that a source may have itself; the key takes their place.
KEY, SOURCE_KEYS = "example_id", ["example_id", "id"]


def _read(
    spark: SparkSession, root: str, folder: str, paths: list[str], by_subset: bool, report: bool, index: str | None
) -> DataFrame:
    """The files as one table with a key: the path below ``root`` and the row's place in the file.

    Places are written with leading zeros, so the key's order is that of the rows. With ``by_subset`` the
    folder below the dataset's is the ``subject``; filters on it reach the list of Arrow files. With ``report``
    what cannot be read is a row with the reason in ``_damage``.
    """
    parts = []
    below_dataset = F.substring_index("_file", f"/{folder}/", -1)
    subject = F.when(below_dataset.contains("/"), F.substring_index(below_dataset, "/", 1)).otherwise(F.lit(""))
    if report and any(p.endswith(".parquet") for p in paths):
        # as many rows as damaged files
        damaged = readers.damaged_parquet(spark, [p for p in paths if p.endswith(".parquet")]).collect()
        paths = sorted(set(paths) - {r["path"] for r in damaged})
        if damaged:
            rows = spark.createDataFrame([tuple(r) for r in damaged], f"_file string, {DAMAGE} string")
            named = {KEY: F.substring_index("_file", "/", -1), **({"subject": subject} if by_subset else {})}
            parts.append(rows.withColumns(named).drop("_file"))
            if not paths:
                raise ValueError(f"{damaged[0]['path']}: {damaged[0]['reason']}")
    for extension in EXTENSIONS:
        chosen = [p for p in paths if p.endswith(extension)]
        if not chosen:
            continue
        if extension == ".parquet":
            table = spark.read.parquet(*chosen).select(
                "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")
            )
            file, places = F.col("_file"), [F.col("_row")]
            table = table.withColumn("subject", subject) if by_subset else table
            table = table.withColumn(DAMAGE, F.lit(None).cast("string")) if report else table
        else:
            table = readers.read_columnar(
                spark,
                *chosen,
                format="arrow_files",
                position=True,
                index=index,
                folder="subject" if by_subset else None,
                root=f"{root.rstrip('/')}/{folder}",
                damaged="report" if report else None,
            )
            file, places = F.col("_file"), [F.col("_batch"), F.col("_row")]
        # file systems spell the slashes after their scheme in several ways
        base = re.sub(r"^\w+:/*", "/", root.rstrip("/"))
        below = F.substring_index(file, f"{base}/", -1)
        key = F.concat_ws("#", below, *(F.lpad(p.cast("string"), 12, "0") for p in places))
        kept = [c for c in table.columns if c not in SOURCE_KEYS and c not in ("_file", "_batch", "_row")]
        parts.append(table.select(*kept, key.alias(KEY)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def load(
    spark: SparkSession,
    root: str,
    folder: str,
    subsets: list[str] | None = None,
    splits: list[str] = files.EVALUATION_SPLITS,
    match: str = "contains",
    otherwise: str = "any",
    by_subset: bool = False,
    report: bool = False,
    index: str | None = None,
) -> DataFrame | None:
    """All shards of the chosen split of a dataset, or None if there is none.

    A dataset gives one split of one subset, those of the smallest path among the
    best splits. With ``subsets`` or ``by_subset`` every subset gives a split of its
    own; ``by_subset`` also adds the subset as ``subject``. Only paths come to the
    driver, as many as the dataset has files. With ``report`` unreadable files and batches are
    rows with a reason in ``_damage``; ``index`` is the folder of an index of Arrow files.
    """
    listed = files.list_dataset(spark, root, folder, EXTENSIONS)
    if listed is None:
        return None
    if subsets is not None:
        listed = listed.where(F.col("subset").isin(subsets))
    group = F.col("subset") if by_subset or subsets else F.lit("")
    chosen = files.resolve_split(listed.withColumn("subset", group), splits, match, otherwise, EXTENSIONS)
    family = files.shard_family(F.col("path")).alias("family")
    shards = listed.withColumn("family", files.shard_family(F.col("path"))).join(
        chosen.where("path is not null").select(family), "family", "left_semi"
    )
    paths = sorted(r["path"] for r in shards.select("path").collect())
    if not paths:
        return None
    return _read(spark, root, folder, paths, by_subset, report, index)


def load_tasks(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Every evaluation task found below ``root``; other folders are ignored."""
    loaded = {
        task: load(spark, root, folder, by_subset=task == "MMLU") for task, folder in TASK_FOLDERS.items()
    }
    return {task: table for task, table in loaded.items() if table is not None}


def load_tasks_reporting(
    spark: SparkSession, root: str, index: str | None = None
) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """As :func:`load_tasks`, with rows for what cannot be read, and the reason for each task of which nothing can."""
    tables: dict[str, DataFrame] = {}
    failed: dict[str, str] = {}
    for task, folder in TASK_FOLDERS.items():
        try:
            table = load(spark, root, folder, by_subset=task == "MMLU", report=True, index=index)
        except UNREADABLE as error:
            failed[task] = first_line(error)
            continue
        if table is not None:
            tables[task] = table
    return tables, failed


def first_line(error: Exception) -> str:
    """A reason to show for an error; of one raised in the Arrow source the last line of its traceback."""
    lines = [line.strip() for line in str(error).splitlines() if line.strip()]
    own = [line for line in lines if re.match(r"[A-Za-z]+(Error|File): ", line)]
    return (own or lines or [type(error).__name__])[-1 if own else 0]


def load_training_sources(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Every training source found below ``root``, with an ``id``."""
    loaded = {
        name: load(spark, root, folder, subsets, splits, "suffix", "none", by_subset=name == "subjects")
        for name, (folder, subsets, splits) in TRAINING_SOURCES.items()
    }
    return {
        name: table.withColumnRenamed(KEY, "id")
        for name, table in loaded.items()
        if table is not None
    }


def load_pair_source(spark: SparkSession, root: str) -> DataFrame:
    """The training files of the continuation dataset, else all its files."""
    table = load(spark, root, TASK_FOLDERS["HellaSwag"], splits=["train"])
    if table is None:
        raise FileNotFoundError(f"no files for {TASK_FOLDERS['HellaSwag']} below {root}")
    return table


def load_answers(spark: SparkSession, root: str, report: bool = False) -> DataFrame:
    """The worked-answer dataset: all shards of its smallest path."""
    table = load(spark, root, ANSWER_FOLDER, splits=[], report=report)
    if table is None:
        raise FileNotFoundError(f"no files for {ANSWER_FOLDER} below {root}")
    return table
