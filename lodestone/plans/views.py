"""Views that the engine's queries run on, derived from the given tables, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The image table: all documents, with their vector where they have one, and metadata derived from their ids and labels."""
    d, e, l = (table(spark, sf_dir, t) for t in ("documents", "embeddings", "labels"))
    rows = d.join(e, d.doc_id == e.vec_id, "left").join(l.select("doc_id", "quality", "toxic"), "doc_id", "left")
    by = lambda n, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod("doc_id", F.lit(n)) + 1).cast("int"))
    one = by(6, "Glass", "stone", "brick", "reinforced_concrete", "steel", "timber")
    two = by(4, "glass", "Stone", "slate", None)
    return rows.select(
        F.col("doc_id").alias("image_id"), "text", "source", F.col("embedding").alias("vec"), F.col("label").alias("class_id"),
        F.substring("text", 1, 60).alias("name"), F.when(F.col("doc_id") % 10 != 0, (1800 + F.col("doc_id") % 225).cast("int")).alias("year_built"),
        F.col("lang").alias("location_country"), F.concat(F.lit("Style_"), F.col("label").cast("string")).alias("style_primary"),
        F.concat(F.lit("type_"), (F.col("doc_id") % 6).cast("string")).alias("building_type"), one.alias("material_1"), two.alias("material_2"),
        F.array(one, two).alias("materials"),
        F.when(F.col("toxic") == 1, "quarantined").when(F.col("quality") == 1, "verified").when(F.col("quality").isNotNull(), "provisional").alias("tag_status"),
        F.when(F.col("doc_id") % 20 == 0, "processing").otherwise("ready").alias("ingest_status"),
        F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("owner_"), (F.col("doc_id") % 3).cast("string"))).alias("owner"), F.sha2("text", 256).alias("sha256"),
    )


CORPUS = """corpus AS (SELECT d.doc_id AS image_id, d.text, d.source, e.embedding AS vec, e.label AS class_id, substring(d.text, 1, 60) AS name,
 CASE WHEN d.doc_id % 10 <> 0 THEN CAST(1800 + d.doc_id % 225 AS INTEGER) END AS year_built, d.lang AS location_country,
 'Style_' || e.label AS style_primary, 'type_' || (d.doc_id % 6) AS building_type,
 ['Glass','stone','brick','reinforced_concrete','steel','timber'][d.doc_id % 6 + 1] AS material_1, ['glass','Stone','slate',NULL][d.doc_id % 4 + 1] AS material_2,
 [['Glass','stone','brick','reinforced_concrete','steel','timber'][d.doc_id % 6 + 1], ['glass','Stone','slate',NULL][d.doc_id % 4 + 1]] AS materials,
 CASE WHEN l.toxic = 1 THEN 'quarantined' WHEN l.quality = 1 THEN 'verified' WHEN l.quality IS NOT NULL THEN 'provisional' END AS tag_status,
 CASE WHEN d.doc_id % 20 = 0 THEN 'processing' ELSE 'ready' END AS ingest_status, CASE WHEN d.doc_id % 3 <> 0 THEN 'owner_' || (d.doc_id % 3) END AS owner,
 sha256(d.text) AS sha256
 FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, phash (64 bits as hex): rows of a group of four differ by one to three bits."""
    last = F.element_at(F.array(*[F.lit(c) for c in "0137"]), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.substring(F.md5(F.expr("doc_id div 4").cast("string")), 1, 15), last).alias("phash"))


HASHES = "hashes AS (SELECT doc_id, substring(md5(CAST(doc_id // 4 AS VARCHAR)), 1, 15) || ['0','1','3','7'][doc_id % 4 + 1] AS phash FROM documents)"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, truth, l0, l1 (logits), pred, conf of each label row."""
    logit = (F.col("doc_id") % 17) / F.lit(17.0)
    rows = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("truth"), logit.alias("l1"), (1 - logit).alias("l0"))
    top = F.greatest("l0", "l1")
    conf = 1 / (F.exp(F.col("l0") - top) + F.exp(F.col("l1") - top))
    return rows.withColumn("pred", F.when(F.col("l1") > F.col("l0"), 1).otherwise(0)).withColumn("conf", conf)


PREDS = """preds AS (SELECT doc_id, quality AS truth, (doc_id % 17) / 17.0::DOUBLE AS l1, 1 - (doc_id % 17) / 17.0::DOUBLE AS l0,
 CASE WHEN (doc_id % 17) / 17.0::DOUBLE > 1 - (doc_id % 17) / 17.0::DOUBLE THEN 1 ELSE 0 END AS pred,
 1 / (exp((1 - (doc_id % 17) / 17.0::DOUBLE) - greatest((doc_id % 17) / 17.0::DOUBLE, 1 - (doc_id % 17) / 17.0::DOUBLE)) + exp((doc_id % 17) / 17.0::DOUBLE - greatest((doc_id % 17) / 17.0::DOUBLE, 1 - (doc_id % 17) / 17.0::DOUBLE))) AS conf
 FROM labels)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image, x1, y1, x2, y2, score, region: the lines of an order as scored boxes."""
    rows = table(spark, sf_dir, "lineitem")
    side = 10 + F.col("l_linenumber") * 5
    x1, y1 = (F.col("l_partkey") % 100).cast("double"), (F.col("l_suppkey") % 100).cast("double")
    return rows.select(F.col("l_orderkey").alias("image"), x1.alias("x1"), y1.alias("y1"), (x1 + side).alias("x2"), (y1 + side).alias("y2"), (F.col("l_extendedprice") / 110_000).alias("score"), F.col("l_linenumber").alias("region"))


BOXES = """boxes AS (SELECT l_orderkey AS image, CAST(l_partkey % 100 AS DOUBLE) AS x1, CAST(l_suppkey % 100 AS DOUBLE) AS y1, CAST(l_partkey % 100 + 10 + l_linenumber * 5 AS DOUBLE) AS x2,
 CAST(l_suppkey % 100 + 10 + l_linenumber * 5 AS DOUBLE) AS y2, l_extendedprice / 110000 AS score, l_linenumber AS region FROM lineitem)"""
