"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

Each source's documents, in hash order, form one stream of words that is cut into blocks of
equal length. Slots of the mix are the points frac(i * golden ratio) (in 32-bit fixed point);
a point's place among the cumulative slot weights names the source, the slot's rank within
its source names the block (ranks past the last block start over, at most three times).

Defined results: null text and texts without words have size 0 and take 0; a null source is a
source of its own, ordered last; repeated rows are separate documents of the stream; an empty
table gives an empty result; further columns are ignored by ``schedule``.

Bound: targets are worked out over one row for each source, in one task; sources are names of collections, some thousands, and not a key of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.common import fresh, join_small, materialise

WEIGHTS = (5, 2, 1)
GOLDEN_32 = 2654435769  # 2**32 / golden ratio, odd
WORDS = r"[^\x20\x09-\x0D]++"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """sk, source, source_size -> also weight and target: min(most * size, level * weight), summing to all sizes.

    The level is where sharing by weight stops: sources in the order of size / weight reach their cap first.
    One row per source throughout.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    pick = F.array(*[F.lit(float(w)) for w in weights])
    out = sizes.withColumn("weight", F.element_at(pick, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    every = W.partitionBy()
    cap = F.col("source_size") * most
    order = W.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    level = left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    out = out.withColumn("level", level).withColumn("place", F.when(F.col("level") * F.col("weight") <= cap, F.row_number().over(order)))
    out = out.withColumn("level", F.min_by("level", "place").over(every)).drop("place")
    return out.withColumn("target", F.least(cap.cast("double"), F.coalesce(F.col("level") * F.col("weight"), cap.cast("double")))).drop("level")


def schedule(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, most: int = 3, blocks: int = 1 << 18, least_blocks: int = 256) -> DataFrame:
    """doc_id, size, source_size, target, taken and h (the hash that orders the stream), a row per document row."""
    key = [F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("sk")]
    rows = docs.select("doc_id", "source", *key, size_of(F.col("text")).alias("size"), F.xxhash64(F.col("doc_id").cast("string"), "text").alias("h"))
    rows = materialise(rows, "mix-sizes")
    on = ["no_source", "sk"]
    sizes = rows.groupBy(*on).agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("n"))
    src = targets(sizes, weights, most)
    total = F.sum("source_size").over(W.partitionBy())
    length = F.greatest(F.lit(1), F.least(F.ceil(total / blocks), F.ceil(F.col("source_size") / least_blocks))).cast("long")
    src = src.withColumn("length", length).withColumn("n_blocks", F.ceil(F.col("source_size") / F.col("length")).cast("long"))
    src = src.withColumn("slots", F.when(F.col("source_size") > 0, F.col("target") * F.col("n_blocks") / F.col("source_size")).otherwise(0.0))
    upto = F.sum("slots").over(W.orderBy(F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0))
    src = src.withColumn("hi", upto).withColumn("lo", F.col("hi") - F.col("slots"))
    src = materialise(src.coalesce(1), "mix-sources")
    told = src.agg(F.sum("slots").alias("slots"), F.sum("n").alias("n"), F.count("*").alias("sources")).first()
    n_slots, n_rows = round(told["slots"] or 0), told["n"] or 0

    # Where each document's words lie in its source's stream: buckets of the hash order, their sums, and sums within a bucket.
    n_buckets = max(256, n_rows // 4096)
    placed = rows.where("size > 0").withColumn("bucket", F.floor((F.shiftrightunsigned("h", 1) / F.lit(2.0**63)) * n_buckets).cast("long"))
    sums = placed.groupBy(*on, "bucket").agg(F.sum("size").alias("bucket_size"))
    ahead = W.partitionBy(*on).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0).cast("long"))).drop("bucket_size")
    within = W.partitionBy(*on, "bucket").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("start", F.coalesce(F.sum("size").over(within), F.lit(0).cast("long")))
    placed = placed.join(sums, [*on, "bucket"]).withColumn("start", F.col("start") + F.col("base"))
    placed = placed.join(src.select(*on, "length"), on)
    last = F.floor((F.col("start") + F.col("size") - 1) / F.col("length"))
    cuts = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / F.col("length")), last)))
    inside = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("length")) - F.greatest("start", F.col("block") * F.col("length"))
    cuts = cuts.withColumn("inside", inside)

    takes = takes_by_block(docs.sparkSession, src, n_slots, told["sources"], on, most)
    taken = cuts.join(takes, [*on, "block"], "left").groupBy(*on, "start", "doc_id", "size", "h").agg(F.sum(F.col("inside") * F.coalesce("takes", F.lit(0))).cast("long").alias("taken"))
    none = rows.where("size = 0").select(*on, F.lit(0).cast("long").alias("start"), "doc_id", "size", "h", F.lit(0).cast("long").alias("taken"))
    out = taken.unionByName(none).join(src.select(*on, "source", "source_size", "target"), on)
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "h")


def takes_by_block(spark, src: DataFrame, n_slots: int, n_sources: int, on: list[str], most: int) -> DataFrame:
    """no_source, sk, block, takes: how many slots of the schedule draw each block."""
    cells = 1 << max(6, min(16, (16 * n_sources).bit_length()))
    scale = float(n_slots) / cells if n_slots else 1.0
    ranges = src.where("slots > 0").withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / scale), F.least(F.floor(F.col("hi") / scale), F.lit(cells - 1)))))
    ranges = ranges.select(*on, "lo", "hi", "n_blocks", "cell")
    slots = spark.range(0, n_slots).select("id", (F.pmod(F.col("id") * GOLDEN_32, F.lit(1 << 32)) / F.lit(float(1 << 32)) * n_slots).alias("at"))
    slots = slots.withColumn("cell", F.least(F.floor(F.col("at") / scale), F.lit(cells - 1)))
    drawn = slots.join(ranges, "cell").where("at >= lo and at < hi").withColumn("chunk", F.floor(F.col("id") / 4096))
    counts = drawn.groupBy(*on, "chunk").agg(F.count("*").alias("n"))
    ahead = W.partitionBy(*on).orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("base", F.coalesce(F.sum("n").over(ahead), F.lit(0).cast("long"))).drop("n")
    drawn = drawn.withColumn("rank", F.row_number().over(W.partitionBy(*on, "chunk").orderBy("id")) - 1).join(counts, [*on, "chunk"])
    drawn = drawn.withColumn("rank", F.col("rank") + F.col("base")).where(F.col("rank") < most * F.col("n_blocks"))
    return drawn.groupBy(*on, (F.col("rank") % F.col("n_blocks")).alias("block")).agg(F.count("*").alias("takes"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document repeated as often as its words are taken, rounded; those taken less than half a time go."""
    h, copies = fresh("mix_h", docs.columns), fresh("mix_copies", docs.columns)
    plan = schedule(docs, **options).where("size > 0")
    share = F.sum("taken") / F.sum("size")
    plan = plan.groupBy("h").agg(F.floor(share + 0.5).cast("int").alias(copies)).where(F.col(copies) > 0).withColumnRenamed("h", h)
    keyed = docs.withColumn(h, F.xxhash64(F.col("doc_id").cast("string"), "text"))
    out = join_small(keyed, plan, h, "inner")
    return out.withColumn(copies, F.explode(F.array_repeat(F.lit(1), F.col(copies)))).select(*docs.columns)
