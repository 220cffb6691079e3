"""A corpus pipeline: each stage takes documents and returns those it keeps, the last their pieces.

Every stage works on all rows its predecessor kept and reads whole texts. Columns beyond ``doc_id`` and ``text`` travel
through all stages but the last. Rows with a null id are never dropped as copies or leaks; a null text is an empty one. An
empty table gives an empty table of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiscore.llm import decontaminate, line_dedup, ngram_join, sentence_pieces, toxicity
from lexiscore.llm.queries import piece_model, table
from lexiscore.session import written


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs``, all columns, without the rows of these ids."""
    return docs.join(ids.select(F.col("doc_id").alias("_gone")).distinct(), F.col("doc_id") == F.col("_gone"), "left_anti")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. It learns from the labels outside the held-out third."""
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    net = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.keep_clean(docs, net)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that they share with others; a document may be left without text."""
    return line_dedup.drop_shared_lines(docs)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies: that of the smallest id. Texts without a word all stay."""
    joined = ngram_join.join(docs)
    return _without(docs, joined.where(F.col("doc_id") != F.col("class_id")))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return _without(docs, decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark")))


def sentence_pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_pieces, ids`` of every document."""
    encoded = sentence_pieces.encode(docs, piece_model())
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("sentence_pieces", sentence_pieces_stage),
]

# A trained classifier and a tokenizer are beyond SQL; tests compare each stage with a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
