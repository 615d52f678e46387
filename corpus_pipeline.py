"""From raw documents to encoded training texts, in stages that each use one operator.

Every stage takes (spark, docs, sf_dir). Its result is written to the shared folder
as Parquet and read again as the next stage's documents, so a lost executor costs
no earlier stage. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablewright.llm import decontamination, exact_index, pieces, quality_crf, simhash_links
from tablewright.llm.common import stored, table


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality field does not reject; it is trained on those of ``docs`` with labels."""
    field = quality_crf.fit(docs, table(spark, sf_dir, "labels"))
    return quality_crf.of_good_quality(docs, field)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest stays, then the one with the smallest doc_id."""
    return exact_index.without_repeats(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays."""
    return simhash_links.one_of_each_group(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands, whole or edited."""
    return decontamination.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_ids, decoded_sha256, round_trip) of every document left."""
    return pieces.piece_rows(docs)


STAGES = [
    ("quality classifier", keep_good_quality),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_passages),
    ("SentencePiece encoding", encode_pieces),
]

# The stages are trained, iterative or use hashes and models that SQL lacks.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
