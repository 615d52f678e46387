"""Which files of a dataset to read.

A files table has (dataset, subset, path); a dataset without files has one row
with a null path. Choices are running minima, so they hold for any number of
files, and ties go to the smallest path instead of the directory order.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Splits in the order an evaluation prefers them.
EVALUATION_SPLITS = ["validation", "test", "train"]

# End of a run directory's name.
RUN_TIME = r"_\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2}$"


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Files table of ``root``/dataset/subset/…; contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(root)
    )
    base = root.rstrip("/").removeprefix("file:")
    below = F.substring_index("path", f"{base}/", -1)
    folders = F.split(below, "/")
    return files.select(
        F.get(folders, 0).alias("dataset"),
        F.when(F.size(folders) > 2, F.get(folders, 1)).otherwise(F.lit("")).alias("subset"),
        "path",
        F.col("modificationTime").alias("mtime"),
    )


def list_dataset(spark: SparkSession, root: str, folder: str, extensions: list[str]) -> DataFrame | None:
    """Files table of the one dataset ``root``/``folder``, with each path below ``root``; None if it is not there."""
    base = f"{root.rstrip('/')}/{folder}"
    pattern = "*{" + ",".join(extensions) + "}"
    try:
        files = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", True)
            .option("pathGlobFilter", pattern)
            .load(base)
        )
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    below = F.substring_index("path", f"/{folder}/", -1)
    return files.select(
        F.lit(folder).alias("dataset"),
        F.when(below.contains("/"), F.substring_index(below, "/", 1)).otherwise(F.lit("")).alias("subset"),
        "path",
        F.concat(F.lit(f"{folder}/"), below).alias("relative"),
    )


def shard_family(path: Column) -> Column:
    """A path without its shard number and extension; the shards of a split have the same."""
    return F.regexp_replace(path, r"(-\d+-of-\d+)?\.[A-Za-z0-9]+$", "")


def list_runs(spark: SparkSession, root: str) -> DataFrame:
    """(prefix, run_dir, entry, mtime) of the files of ``root``/run/entry/….

    The prefix is the run's name without the time it was started.
    """
    files = list_files(spark, root)
    return files.select(
        F.regexp_replace("dataset", RUN_TIME, "").alias("prefix"),
        F.col("dataset").alias("run_dir"),
        F.col("subset").alias("entry"),
        "mtime",
    )


def split_rank(
    path: Column, splits: list[str], match: str = "contains", extension: str | list[str] = ".arrow"
) -> Column:
    """0-based rank of the first split a file name matches; null if none.

    ``contains`` looks anywhere in the file name, ``suffix`` right before the
    extension.
    """
    name = F.substring_index(path, "/", -1)
    ends = "|".join(map(re.escape, [extension] if isinstance(extension, str) else extension))
    rank = F.lit(None).cast("int")
    for i, split in reversed(list(enumerate(splits))):
        hit = name.contains(split) if match == "contains" else name.rlike(rf"{re.escape(split)}(?:{ends})$")
        rank = F.when(hit, F.lit(i)).otherwise(rank)
    return rank


def _ranked(
    files: DataFrame, splits: list[str], match: str, otherwise: str, extension: str
) -> DataFrame:
    rank = split_rank(F.col("path"), splits, match, extension)
    if otherwise == "any":
        rank = F.when(F.col("path").isNotNull(), F.coalesce(rank, F.lit(len(splits))))
    elif otherwise != "none":
        raise ValueError(f"otherwise must be any or none, not {otherwise}")
    return files.withColumn("rank", rank)


def resolve_split(
    files: DataFrame,
    splits: list[str] = EVALUATION_SPLITS,
    match: str = "contains",
    otherwise: str = "any",
    extension: str = ".arrow",
) -> DataFrame:
    """(dataset, subset, rank, path, n_files): the chosen split of each dataset.

    ``path`` is its first file and null where nothing matches. With
    ``otherwise="any"`` a dataset without a preferred split falls back to its
    other files.
    """
    ranked = _ranked(files, splits, match, otherwise, extension)
    by_rank = ranked.groupBy("dataset", "subset", "rank").agg(
        F.min(F.when(F.col("rank").isNotNull(), F.col("path"))).alias("path"),
        F.count_if(F.col("rank").isNotNull()).alias("n_files"),
    )
    order = F.coalesce("rank", F.lit(len(splits) + 1))
    best = F.min_by(F.struct("rank", "path", "n_files"), order).alias("best")
    return by_rank.groupBy("dataset", "subset").agg(best).select("dataset", "subset", "best.*")


def files_of_split(
    files: DataFrame,
    splits: list[str] = EVALUATION_SPLITS,
    match: str = "contains",
    otherwise: str = "any",
    extension: str = ".arrow",
    fall_back_to_all: bool = False,
) -> DataFrame:
    """Every file of each dataset's chosen split, so that sharded splits are read whole.

    With ``fall_back_to_all``, a dataset without a preferred split gives all its
    files, of whichever splits.
    """
    chosen = resolve_split(files, splits, match, otherwise, extension).select("dataset", "subset", "rank")
    ranked = _ranked(files, splits, match, otherwise, extension)
    kept = ranked.join(chosen, ["dataset", "subset", "rank"], "left_semi")
    if not fall_back_to_all:
        kept = kept.where(F.col("rank") < len(splits))
    return kept.select("dataset", "subset", "path")
