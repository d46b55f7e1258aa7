"""Samples and splits. Order within a class is that of md5(seed:id), so that every run and engine agrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.sources.shared import materialise, sent


def shuffled(seed: int, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def placed(rows: DataFrame, label: str | None, seed: int, key: str) -> DataFrame:
    """Adds ``place``, from 1 within the class (or over all rows), and ``size``, the number of rows of the class.

    A class is numbered in 4096 parts by the beginning of the shuffling digest, each on its own; the sizes of
    the parts before it, summed over counts alone, are added. No class stands in one task.
    """
    by = [label] if label else []
    parts = rows.withColumn("_part", F.substring(shuffled(seed, key), 1, 3))
    counts = parts.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select(*[F.col(c).alias("_label") for c in by], F.col("_part").alias("_of"), F.coalesce(before, F.lit(0).cast("long")).alias("_before"), F.sum("_n").over(W.partitionBy(*by)).alias("size"))
    on = parts["_part"] == counts["_of"]
    for c in by:
        on = on & parts[c].eqNullSafe(counts["_label"])
    place = F.row_number().over(W.partitionBy(*by, "_part").orderBy(shuffled(seed, key), key)) + F.col("_before")
    return parts.join(counts, on).withColumn("place", place.cast("int")).drop("_part", "_of", "_label", "_before")


def balanced(rows: DataFrame, label: str, key: str, n: int, seed: int = 0) -> DataFrame:
    first = rows.withColumn("place", F.row_number().over(W.partitionBy(label).orderBy(shuffled(seed, key), key)))  # a task keeps n rows of a class before the shuffle
    return first.where(F.col("place") <= n).drop("place")


def stratified_split(rows: DataFrame, label: str, key: str, seed: int = 0, most: int = 20) -> DataFrame:
    """Adds ``part``: val = min(most, max(1, n div 5)) rows of each class, the rest train; a class of one row is in both."""
    numbered = placed(rows, label, seed, key).withColumnRenamed("size", "n")
    val = F.least(F.lit(most), F.greatest(F.lit(1).cast("long"), F.floor(F.col("n") / 5)))
    parts = F.when((F.col("n") == 1), F.array(F.lit("train"), F.lit("val"))).when(F.col("place") <= val, F.array(F.lit("val"))).otherwise(F.array(F.lit("train")))
    return numbered.withColumn("part", F.explode(parts)).drop("place", "n")


def oversampled(rows: DataFrame, label: str, key: str, n: int = 280, seed: int = 0) -> DataFrame:
    """Each class to exactly n rows: all of its rows over and over in shuffled order (``slot`` from 1)."""
    numbered = placed(rows, label, seed, key)
    slots = F.sequence(F.col("place").cast("long"), F.lit(n).cast("long"), F.col("size"))
    return numbered.where(F.col("place") <= n).withColumn("slot", F.explode(slots)).drop("place", "size")


def guaranteed_split(rows: DataFrame, label: str, key: str, n_train: int, n_test: int, seed: int = 0) -> DataFrame:
    """Adds ``part``: one train and one test row of each class, then the shuffled rest fills both up."""
    numbered = placed(rows, label, seed, key).drop("size")
    first = numbered.where("place <= 2").withColumn("part", F.when(F.col("place") == 1, "train").otherwise("test")).drop("place")
    sizes = first.groupBy().agg(F.count_if(F.col("part") == "train").alias("a"), F.count_if(F.col("part") == "test").alias("b"))
    need_train, need_test = F.greatest(F.lit(n_train) - F.col("a"), F.lit(0)), F.greatest(F.lit(n_test) - F.col("b"), F.lit(0))
    rest = numbered.where("place > 2").drop("place")
    rest = rest.orderBy(shuffled(seed + 1, key), key).limit(n_train + n_test)  # more are never needed
    rest = placed(rest, None, seed + 1, key).drop("size").join(F.broadcast(sizes))  # one row of sizes
    rest = rest.where(F.col("place") <= need_train + need_test).withColumn("part", F.when(F.col("place") <= need_train, "train").otherwise("test"))
    return first.unionByName(rest.drop("place", "a", "b"))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds ``at``, from 0 in the group's order, and ``total``, the group's number of rows.

    All rows are sorted by group and order in range parts, so that a large group lies in many parts; the rows of a group in the parts
    before, summed over counts alone, are added to the place inside the part.
    """
    lined = materialise(rows.orderBy(group, *order).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    part = F.shiftrightunsigned("_row", 33)
    runs = lined.groupBy(F.col(group).alias("_group"), part.alias("_of")).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    own = W.partitionBy("_group")
    before = F.coalesce(F.sum("_n").over(own.orderBy("_of").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))  # a group's parts
    runs = runs.withColumn("_before", before).withColumn("total", F.sum("_n").over(own))
    both = lined.withColumn("_part", part).join(runs, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_of")))
    return both.withColumn("at", F.col("_row") - F.col("_first") + F.col("_before")).select(*rows.columns, "at", "total")


def evenly_spaced(rows: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """About n rows of each group: positions min(i * step, total - 1), step = max(1, total div n)."""
    step = F.greatest(F.lit(1).cast("long"), F.floor(F.col("total") / n))
    return numbered(rows, group, order).where((F.col("at") % step == 0) & (F.col("at") < step * n)).drop("total")


def every_nth(rows: DataFrame, group: str, order: list[str], step: int, n: int) -> DataFrame:
    return numbered(rows, group, order).where((F.col("at") % step == 0) & (F.col("at") < step * n)).drop("total")


def hard_negative_batches(rows: DataFrame, label: str, key: str, clusters: DataFrame, n_batches: int, size: int, seed: int = 0) -> DataFrame:
    """batch, slot, key, label: half of each batch from one confusion cluster, half from the shuffled pool.

    clusters is a short (cluster, label) table. Batch b takes cluster b mod n; slots walk on through cluster and pool.
    """
    half = size // 2
    names = clusters.select("cluster").distinct().withColumn("c", F.row_number().over(W.orderBy("cluster")) - 1)
    n_clusters = F.count("*").over(W.partitionBy())
    names = names.withColumn("n_clusters", n_clusters)
    names = materialise(names, "clusters")
    inside = placed(rows.join(sent(clusters, "labels of clusters"), label).join(sent(names, "clusters"), "cluster"), "cluster", seed, key).withColumnRenamed("size", "n_in")
    slots = rows.sparkSession.range(n_batches * half).select((F.col("id") / half).cast("long").alias("batch"), (F.col("id") % half).alias("slot"))
    own = slots.join(F.broadcast(names), F.col("batch") % F.col("n_clusters") == F.col("c"))
    own = own.withColumn("walk", F.floor(F.col("batch") / F.col("n_clusters")) * half + F.col("slot"))
    sizes = inside.groupBy("cluster").agg(F.max("n_in").alias("n_in"))
    own = own.join(F.broadcast(sizes), "cluster").withColumn("place", (F.col("walk") % F.col("n_in") + 1).cast("int"))
    hard = own.join(inside.select("cluster", "place", key, label), ["cluster", "place"]).select("batch", "slot", key, label)
    pool = placed(rows.orderBy(shuffled(seed + 1, key), key).limit(n_batches * half), None, seed + 1, key)
    pool = pool.withColumnRenamed("size", "n_pool")
    other = slots.withColumn("i", F.col("batch") * half + F.col("slot"))
    rest = other.join(pool.select("place", key, label, "n_pool"), F.col("i") + 1 == F.col("place")).select("batch", (F.col("slot") + half).alias("slot"), key, label)
    return hard.unionByName(rest)
