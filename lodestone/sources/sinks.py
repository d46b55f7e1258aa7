"""Sinks on Parquet folders: insert if absent, replace by key, versioned vectors, restore, cascade.

Appends add files only. ``replace_by_key`` stages all new rows before it overwrites any bucket, each writer in a
folder of its own; a job lost during the overwrite leaves buckets old and new, and running it again completes it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators.curation import first_of_each
from lodestone.sources.named_files import write_named
from lodestone.sources.shared import dealt


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def to_insert(rows: DataFrame, stored: DataFrame | None, key: str, *order: str) -> DataFrame:
    """Rows whose key is new, one a key."""
    first = first_of_each(rows, key, *order)
    return first if stored is None else first.join(stored.select(key).distinct(), key, "left_anti")


def insert_if_absent(rows: DataFrame, path: str, key: str, *order: str, error: Column | None = None) -> dict[str, int]:
    """Appends rows with new keys to ``path``; counts of inserted, skipped and error rows. Runs again without effect."""
    spark = rows.sparkSession
    bad = F.coalesce(error, F.lit(False)) if error is not None else F.lit(False)
    flagged = rows.withColumn("_bad", bad | F.col(key).isNull())
    good = flagged.where("not _bad").drop("_bad")
    stored = spark.read.parquet(path) if exists(spark, path) else None
    counts = flagged.agg(F.count("*").alias("n"), F.count_if("_bad").alias("bad")).first()
    written = Observation()
    to_insert(good, stored, key, *order).observe(written, F.count("*").alias("n")).write.mode("append").parquet(path)
    inserted = written.get["n"]
    return {"inserted": inserted, "skipped": counts["n"] - counts["bad"] - inserted, "errors": counts["bad"]}


def replace_by_key(rows: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """All rows of the given keys are replaced: their buckets are rewritten by dynamic partition overwrite."""
    spark = rows.sparkSession
    bucket = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")
    new = rows.withColumn("bucket", bucket)
    if exists(spark, path):
        staged = f"{path}.staged/{uuid.uuid4().hex}"
        new.write.parquet(f"{staged}-rows")
        new = spark.read.schema(new.schema).parquet(f"{staged}-rows")
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        old = spark.read.parquet(path).where(F.col("bucket").isin(touched))
        n = max(old.count(), new.count())
        kept = dealt(old, key, n).join(dealt(new.select(key), key, n).distinct(), key, "left_anti")
        new = new.unionByName(kept, allowMissingColumns=True)
        new = spark.createDataFrame([], new.schema) if not touched else new
        new.write.parquet(staged)  # what is read is not what is overwritten
        new = spark.read.schema(new.schema).parquet(staged)
        new = _by_bucket(new, key, new.count(), buckets)
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def _by_bucket(rows: DataFrame, key: str, n: int, buckets: int, most: int = 250_000) -> DataFrame:
    """``rows`` (n) dealt by bucket, and large buckets by key as well, so that no task sorts more for a longer table and a bucket has few files."""
    parts, split = -(-n // most), max(1, -(-n // (buckets * most)))
    return rows.repartition(max(1, min(buckets * split, 4 * parts)), "bucket", F.pmod(F.hash(key), F.lit(split)))


def chunk_counts(chunks: DataFrame, sources: DataFrame, key: str = "source_id") -> DataFrame:
    """Sources with chunk_count, page_count and status after their chunks were written."""
    n = chunks.groupBy(key).agg(F.count("*").alias("chunk_count"), F.countDistinct("page").alias("page_count"))
    out = sources.drop("chunk_count", "page_count", "index_status").join(n, key, "left").fillna(0, ["chunk_count", "page_count"])
    return out.withColumn("index_status", F.when(F.col("chunk_count") > 0, "ready").otherwise("failed"))


def delete_cascade(gone: DataFrame, key: str, *tables: DataFrame) -> list[DataFrame]:
    """Every table without the rows of the given keys."""
    return [t.join(gone.select(key).distinct(), key, "left_anti") for t in tables]


def json_sidecars(rows: DataFrame, key: str) -> DataFrame:
    """key, json: the sidecar of each record."""
    return rows.select(F.col(key), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def write_sidecars(rows: DataFrame, key: str, folder: str) -> None:
    """``folder/<key>.json`` for each record; a later record of the key replaces the file."""
    write_named(json_sidecars(rows, key), folder, F.concat(F.col(key).cast("string"), F.lit(".json")), F.col("json"))


def vector_version(vectors: DataFrame, version: str, dim: int) -> DataFrame:
    """version, id, vec with one row an id, the latest of (id, vec, added_at); a wrong length fails the job."""
    place = F.row_number().over(W.partitionBy("id").orderBy(F.desc("added_at")))
    right = F.when(F.size("vec") == dim, F.col("vec")).otherwise(F.raise_error(F.concat(F.lit("wrong length of vector "), F.col("id").cast("string"))).cast("array<float>"))
    return vectors.withColumn("_p", place).where("_p = 1").select(F.lit(version).alias("version"), "id", right.alias("vec"))


def rebuilt(images: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, vec) of all images that have a vector, and one row of indexed, failed, total."""
    both = images.select(F.col("image_id").alias("id")).join(vectors.select("id", "vec"), "id", "left")
    return both.where("vec is not null"), both.agg(F.count("vec").alias("indexed"), F.count_if(F.col("vec").isNull()).alias("failed"), F.count("*").alias("total"))


def restorable(sidecars: DataFrame, stored: DataFrame, files: DataFrame) -> DataFrame:
    """Sidecar rows (id, outcome, sha256, path, …) with an outcome: restored, or why not."""
    flag = lambda df, key, name: df.select(key).distinct().withColumn(name, F.lit(True))
    rows = sidecars.join(flag(stored, "id", "_id"), "id", "left").join(flag(files, "path", "_file"), "path", "left").join(flag(stored, "sha256", "_sha"), "sha256", "left")
    outcome = F.when(F.col("outcome") != "ok", F.col("outcome")).when(F.col("_id"), "present").when(F.col("_file").isNull(), "no file").when(F.col("_sha"), "duplicate").otherwise("restored")
    return rows.withColumn("outcome", outcome).drop("_id", "_file", "_sha")
