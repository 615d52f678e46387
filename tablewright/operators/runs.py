"""Choosing the newest training run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Entry names inside a run directory.
FINAL = "final_model"
CHECKPOINT = "checkpoint-"


def latest_run(entries: DataFrame, checkpoints: bool = True) -> DataFrame:
    """(prefix, run_dir, entry): what to evaluate for each run name.

    ``entries`` lists run directories: (prefix, run_dir, entry, mtime). The
    newest directory of a prefix is chosen first, then its final model or, with
    ``checkpoints``, its newest checkpoint. ``entry`` is null where the newest
    directory holds neither. Both steps are running maxima.
    """
    entry, mtime = F.col("entry"), F.col("mtime")
    checkpoint = F.when(entry.startswith(CHECKPOINT), F.struct(mtime, entry))
    runs = entries.groupBy("prefix", "run_dir").agg(
        F.max("mtime").alias("_mtime"),
        F.max(F.when(entry == FINAL, entry)).alias("_final"),
        F.max(checkpoint).alias("_checkpoint"),
    )
    chosen = F.col("_final")
    if checkpoints:
        chosen = F.coalesce(chosen, F.col("_checkpoint.entry"))
    newest = runs.select("prefix", F.struct("_mtime", "run_dir", chosen.alias("entry")).alias("_run"))
    return (
        newest.groupBy("prefix")
        .agg(F.max_by("_run", F.struct("_run._mtime", "_run.run_dir")).alias("_run"))
        .select("prefix", "_run.run_dir", "_run.entry")
    )
