"""Facets, counts and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators.filters import normal
from lodestone.sources.shared import sent


def facet(rows: DataFrame, value: Column, n: int) -> DataFrame:
    """value, n: the most frequent values; null, empty and 'null' do not count; ties by value."""
    named = rows.select(value.alias("value")).where(F.col("value").isNotNull() & ~F.col("value").isin("", "null"))
    return named.groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(n)


def style_facet(images: DataFrame, n: int = 30) -> DataFrame:
    return facet(images.where("ingest_status = 'ready'"), normal("style_primary"), n)


def building_type_facet(images: DataFrame, n: int = 10) -> DataFrame:
    return facet(images.where("ingest_status = 'ready'"), normal("building_type"), n)


def material_facet(images: DataFrame, n: int = 30) -> DataFrame:
    return facet(images.where("ingest_status = 'ready'").select(F.explode("materials").alias("m")), F.lower("m"), n)


def contained_counts(rows: DataFrame, values: DataFrame, columns: list[Column]) -> DataFrame:
    """value, n: rows whose joined values contain each value of a short list; zeros stay.

    Rows are first counted by their joined text, so that the list meets distinct texts only.
    """
    texts = rows.select(F.lower(F.concat_ws(" ", *columns)).alias("joined")).groupBy("joined").agg(F.count("*").alias("n"))
    hit = F.contains(F.col("joined"), F.lower("value"))
    found = texts.join(sent(values, "values"), hit).groupBy("value").agg(F.sum("n").alias("n"))
    return values.join(found, "value", "left").select("value", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


STATUSES = ("verified", "provisional", "quarantined", "unvalidated")


def status_counts(images: DataFrame) -> DataFrame:
    """tag_status, n for four fixed states; null is 'unvalidated'."""
    found = images.groupBy(F.coalesce("tag_status", F.lit("unvalidated")).alias("tag_status")).agg(F.count("*").alias("n"))
    fixed = images.sparkSession.createDataFrame([(s,) for s in STATUSES], "tag_status string")
    return fixed.join(found, "tag_status", "left").select("tag_status", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def status_shares(images: DataFrame) -> DataFrame:
    counts = status_counts(images)
    return counts.withColumn("percent", F.round(100.0 * F.col("n") / F.greatest(F.sum("n").over(W.partitionBy()), F.lit(1)), 4))


def newest(rows: DataFrame, by: list[Column], n: int) -> DataFrame:
    return rows.orderBy(*by).limit(n)


def corpus_stats(rows: DataFrame, created: str, *vector_tables: tuple[str, DataFrame]) -> DataFrame:
    """One row: count, newest time, and the size of each vector table."""
    out = rows.agg(F.count("*").alias("n"), F.max(created).alias("newest"))
    for name, vectors in vector_tables:
        out = out.join(vectors.agg(F.count("*").alias(f"n_{name}")))  # one row each
    return out


def run_summary(outcomes: DataFrame, outcome: str, group: str | None = None) -> DataFrame:
    """Counts of ok, duplicate, failed and other outcomes, and an exit class: 0 fine, 1 some failed, 2 all failed."""
    count = lambda v: F.count_if(F.col(outcome) == v).alias(v)
    grouped = outcomes.groupBy(group) if group else outcomes.groupBy()
    out = grouped.agg(F.count("*").alias("total"), count("ok"), count("duplicate"), count("failed"))
    return out.withColumn("exit_class", F.when(F.col("failed") == 0, 0).when(F.col("failed") < F.col("total"), 1).otherwise(2))


def failed_records(outcomes: DataFrame, outcome: str, *columns: str) -> DataFrame:
    """The failed records of a run, as rows, in the order of the given columns."""
    return outcomes.where(F.col(outcome) == "failed").select(*columns).orderBy(*columns)


def cumulative_buckets(rows: DataFrame, value: Column, edges: list[float]) -> DataFrame:
    """le, n: rows with value <= le, for fixed edges and infinity (le null)."""
    counts = [F.count_if(value <= e).alias(f"b{i}") for i, e in enumerate(edges)] + [F.count(value).alias(f"b{len(edges)}")]
    pairs = [F.struct(F.lit(float(e)).alias("le"), F.col(f"b{i}").alias("n")) for i, e in enumerate(edges)]
    pairs.append(F.struct(F.lit(None).cast("double").alias("le"), F.col(f"b{len(edges)}").alias("n")))
    return rows.agg(*counts).select(F.inline(F.array(*pairs)))


def ratings(rows: DataFrame, item: str, up: Column, down: Column) -> DataFrame:
    """Up is 1, down is -1: sum, number and share of ups for each item."""
    value = F.when(up, 1).when(down, -1)
    rated = rows.withColumn("rating", value).where("rating is not null")
    return rated.groupBy(item).agg(F.sum("rating").cast("long").alias("rating"), F.count("*").alias("n"), F.round(F.avg((F.col("rating") == 1).cast("double")), 6).alias("up_share"))


def numbered_labels(regions: DataFrame, group: str, label: str, order: str) -> DataFrame:
    """Labels with the counter of their instance in the group: Wi1, Wi2."""
    place = F.row_number().over(W.partitionBy(group, label).orderBy(order))
    return regions.withColumn("instance", F.concat(F.substring(label, 1, 2), place.cast("string")))
