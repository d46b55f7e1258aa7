"""Queries that run as streams over the given tables, each to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestone.plans.registry import query
from lodestone.plans.views import table
from lodestone.sources.shared import shared_dir
from lodestone.streaming import ingest


def workspace(spark) -> str:
    """A new folder in the shared place."""
    return f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"


def _arriving(spark, d, name: str):
    t = table(spark, d, name)
    return spark.readStream.schema(t.schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/{name}.parquet*")


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS sha, 'processing' AS ingest_status FROM documents GROUP BY sha256(text)")
def r01_ingest(spark, d):
    """Documents arrive, are deduplicated by digest and inserted."""
    home = workspace(spark)
    stream = _arriving(spark, d, "documents").select("doc_id", F.coalesce(F.sha2("text", 256), F.lit("none")).alias("sha"))
    ingest.ingest(stream, f"{home}/images", f"{home}/checkpoint", "sha", "doc_id").awaitTermination()
    return spark.read.parquet(f"{home}/images")


@query("SELECT CAST(count(DISTINCT sha256(text)) AS BIGINT) AS n FROM documents")
def r02_stateful_distinct(spark, d):
    home = workspace(spark)
    stream = ingest.distinct_records(_arriving(spark, d, "documents").select(F.sha2("text", 256).alias("sha")), "sha")
    stream.writeStream.option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).format("parquet").start(f"{home}/seen").awaitTermination()
    return spark.read.parquet(f"{home}/seen").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, l.n, 'ready' AS ingest_status FROM orders JOIN (SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1) l ON o_orderkey = l_orderkey")
def r03_r04_completion(spark, d):
    """Orders wait as processing; the counts of their lines arrive, complete them, and set off the follow-up that is read here."""
    home = workspace(spark)
    target = f"{home}/orders"
    bucket = F.pmod(F.xxhash64(F.col("o_orderkey").cast("string")), F.lit(64)).cast("int")
    table(spark, d, "orders").select("o_orderkey", F.lit(None).cast("long").alias("n"), F.lit("processing").alias("ingest_status"), bucket.alias("bucket")).write.partitionBy("bucket").parquet(target)
    table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n")).write.parquet(f"{home}/output")
    stream = ingest.records(spark, f"{home}/output", spark.read.parquet(f"{home}/output").schema)
    merge = lambda stored, output: stored.drop("n", "ingest_status").join(output, "o_orderkey")
    follow = lambda batch, number: batch.write.mode("overwrite").parquet(f"{home}/follow/batch={number}")
    ingest.complete(stream, target, f"{home}/checkpoint", "o_orderkey", merge, [follow]).awaitTermination()
    queued = spark.read.parquet(f"{home}/follow").select("o_orderkey")
    return spark.read.parquet(target).join(queued, "o_orderkey", "left_semi").select("o_orderkey", "n", "ingest_status")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1996-01-01'")
def r05_stuck(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderdate", F.when(F.col("o_orderstatus") == "P", "processing").otherwise("ready").alias("ingest_status"))
    return ingest.stuck(rows, "o_orderdate", F.lit("1996-01-01").cast("timestamp")).select("o_orderkey")


@query("""WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderdate AS q, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 37 END AS d, o_orderpriority AS p FROM orders), w AS (SELECT max(q + to_days(CAST(coalesce(d, 0) AS INTEGER))) AS w FROM o),
n AS (SELECT key, p, d, CAST(len(list_filter([1, 2, 3], lambda i: CASE WHEN d IS NOT NULL THEN 10 * i < d ELSE q + to_days(CAST(10 * i AS INTEGER)) <= w END)) AS INTEGER) AS tries, d IS NULL AND q + INTERVAL 40 DAY <= w AS failed FROM o, w)
SELECT key, CASE WHEN d IS NOT NULL THEN 'ready' WHEN failed THEN 'failed' WHEN tries > 0 THEN 'requeued' ELSE 'processing' END AS status, tries, CASE WHEN d IS NOT NULL THEN p END AS payload, CAST(1 + tries + CASE WHEN d IS NOT NULL OR failed THEN 1 ELSE 0 END AS BIGINT) AS changes FROM n""")
def r05_requeued(spark, d):
    """Orders are records, and for three of four an output comes after up to 36 days; a timer of ten days queues a record again, thrice at most."""
    home = workspace(spark)
    orders = _arriving(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderdate").alias("at"), F.col("o_orderpriority").alias("payload"))
    outputs = orders.where("o_orderkey % 4 <> 0").withColumn("at", F.timestamp_add("DAY", F.col("o_orderkey") % 37, F.col("at").cast("timestamp")))
    changes = ingest.tracked(orders, outputs, 10 * 86_400)
    changes.writeStream.option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).format("parquet").start(f"{home}/changes").awaitTermination()
    last = F.struct("at", "tries", F.col("status").isin("ready", "failed"))
    found = spark.read.parquet(f"{home}/changes").groupBy("key").agg(*[F.max_by(c, last).alias(c) for c in ("status", "tries", "payload")], F.count("*").alias("changes"))
    return found


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def r06_resumed_backfill(spark, d):
    """A backfill that is stopped and resumed: the second run has nothing left to do."""
    home = workspace(spark)

    def each(batch, number: int) -> None:
        batch.groupBy("event_type").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{home}/out/batch={number}")

    for _ in range(2):
        ingest.run(_arriving(spark, d, "events").select("event_type"), f"{home}/checkpoint", each).awaitTermination()
    return spark.read.parquet(f"{home}/out").groupBy("event_type").agg(F.sum("n").alias("n"))
