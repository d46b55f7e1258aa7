"""The corpus pipeline: toxicity, near-dedup, PII, source mixing, SentencePiece.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but
the last return the columns of ``documents``.

Defined results: null and empty texts are neither toxic nor near copies of anything and go through; rows without doc_id are not
dropped as toxic, and near-dedup tells them apart by their texts; of repeated rows, and of a group of near copies, one row stays (the smallest doc_id, ties
to the smaller hash of the text); further columns, whatever their names, go through to the last stage; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import mixing, neardup, pieces, pii, toxicity
from lodestone.llm.common import join_small, materialise, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches 0.5 go; rows without doc_id cannot be scored apart and stay."""
    scored = toxicity.query(docs, table(spark, sf_dir, "labels"))
    gone = scored.where("predicted = 1 and doc_id is not null").select("doc_id").distinct()
    return join_small(docs, gone, "doc_id", "left_anti").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays (five-word shingles, similarity 0.8)."""
    return neardup.deduplicated(docs, words=5, percent=80)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it leave the texts; n_chars follows."""
    out = pii.sanitise(docs)
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(out.schema["n_chars"].dataType))) if "n_chars" in out.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of each document of the mix."""
    return pieces.encode(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("pii", sanitise), ("mixing", mix), ("sentencepiece", encode)]
ORACLE_SQL = None  # models and signatures: tests/llm hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
