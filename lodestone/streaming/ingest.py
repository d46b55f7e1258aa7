"""The ingest stream: records arrive, are deduplicated and inserted, completed, and followed up."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.sources.shared import dealt
from lodestone.sources.sinks import exists, insert_if_absent, replace_by_key


def records(spark: SparkSession, folder: str, schema, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(folder)


def distinct_records(stream: DataFrame, digest: str, time: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """The first record of each digest; with a time column, the state is kept for ``delay`` only."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([digest]) if time else stream.dropDuplicates([digest])


def run(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Everything that is there now, in batches; a later call goes on after the last finished batch."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()


def ingest(stream: DataFrame, target: str, checkpoint: str, digest: str, *order: str, then: list[Callable[[DataFrame, int], None]] | None = None) -> StreamingQuery:
    """New digests are inserted with status ``processing``; follow-ups get the same batch. Idempotent by digest, so a repeated batch changes nothing."""

    def each(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("ingest_status", F.lit("processing"))
        insert_if_absent(rows, target, digest, *order)
        for step in then or []:
            step(rows, number)

    return run(stream, checkpoint, each)


def complete(stream: DataFrame, target: str, checkpoint: str, key: str, merge: Callable[[DataFrame, DataFrame], DataFrame], then: list[Callable[[DataFrame, int], None]] | None = None) -> StreamingQuery:
    """Model output joins its stored rows by ``merge(stored, output)``; the changed rows replace theirs with status ``ready``."""

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if not exists(spark, target):
            return
        n = max(spark.read.parquet(target).count(), batch.count())
        output = dealt(batch, key, n)
        changed = lambda: dealt(spark.read.parquet(target).drop("bucket"), key, n).join(output.select(key).distinct(), key, "left_semi")
        replace_by_key(merge(changed(), output).withColumn("ingest_status", F.lit("ready")), target, key)
        for step in then or []:
            step(changed(), number)  # read anew: the old files are gone

    return run(stream, checkpoint, each)


def tracked(records: DataFrame, outputs: DataFrame, patience: str | int, tries: int = 3, delay: str = "0 seconds", groups: int = 4096) -> DataFrame:
    """key, at, status, tries, payload: every change of a record's state, from (key, at) records and (key, at, payload) model outputs.

    A record that arrives is ``processing``. Its output completes it (``ready``, with the payload). A timer of ``patience`` seconds of
    event time that runs out queues it again (``requeued``, at the time the timer was set for) and starts anew, until after ``tries``
    requeues it is ``failed``; an output that comes later still completes it. Repeated records and outputs of a completed key
    change nothing; an output without a record waits for it, and completes it when it comes.

    State is a row for each of ``groups`` groups of keys, so that Python is called once a group and batch and not once a key; more
    groups keep each small. Timers run by the watermark, ``delay`` behind the latest event. A timer counts as run out when a later event
    of its key comes, or when the watermark passes it, so that the changes do not depend on how events fall into batches.
    """
    step = int(patience)
    none = F.lit(None).cast("string")
    when = F.col("at").cast("timestamp")
    told = lambda rows, payload, kind: rows.select("key", when.alias("at"), F.unix_millis(when).alias("ms"), payload.alias("payload"), F.lit(kind).alias("kind"))
    both = told(records, none, 0).unionByName(told(outputs, F.col("payload"), 1))
    names = ["key", "ms", "status", "tries", "payload"]

    def follow(group: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = {k: tuple(told) for k, *told in zip(*state.get, strict=True)} if state.exists else {}
        watermark, out = state.getCurrentWatermarkMs(), []

        def run_out(key: str, status: str, due: int, n: int, upto: int) -> tuple[str, int, int]:
            while status in ("processing", "requeued") and due <= upto:
                status = "failed" if n == tries else "requeued"
                n += status == "requeued"
                out.append((key, due, status, n, None))
                due += step * 1000
            return status, due, n

        events = [] if state.hasTimedOut else sorted((e for pdf in pdfs for e in zip(*(pdf[c].tolist() for c in ("key", "ms", "kind", "payload")), strict=True)), key=lambda e: (e[0] or "", e[1], e[2], e[3] or ""))
        for key, ms, kind, payload in events:
            status, due, n, waiting = kept.get(key, ("new", 0, 0, None))
            status, due, n = run_out(key, status, due, n, ms - 1)
            if kind == 0 and status == "new":
                status, due = "processing", ms + step * 1000
                out.append((key, ms, status, n, None))
                if waiting is not None:
                    status = "ready"
                    out.append((key, ms, status, n, waiting))
            elif kind == 1 and status == "new":
                waiting = waiting if waiting is not None else payload or ""
            elif kind == 1 and status != "ready":
                status = "ready"
                out.append((key, ms, status, n, payload))
            kept[key] = (status, due, n, waiting)
        if watermark > 0:
            for key, (status, due, n, waiting) in kept.items():
                if due <= watermark and status in ("processing", "requeued"):
                    kept[key] = (*run_out(key, status, due, n, watermark), waiting)
        state.update(tuple(map(list, zip(*((k, *v) for k, v in kept.items()), strict=True))))
        dues = [due for status, due, _, _ in kept.values() if status in ("processing", "requeued")]
        if dues:
            state.setTimeoutTimestamp(max(min(dues), watermark + 1))
        for at in range(0, len(out), 10_000):
            yield pd.DataFrame(out[at : at + 10_000], columns=names)

    stored = "keys array<string>, status array<string>, due array<long>, n array<int>, waiting array<string>"
    dealt = both.withWatermark("at", delay).withColumn("group", F.pmod(F.xxhash64("key"), F.lit(groups))).groupBy("group")
    changes = dealt.applyInPandasWithState(follow, "key string, ms long, status string, tries int, payload string", stored, "append", GroupStateTimeout.EventTimeTimeout)
    return changes.select("key", F.timestamp_millis("ms").alias("at"), "status", "tries", "payload")


def stuck(rows: DataFrame, time: str, before) -> DataFrame:
    """Rows still processing since before a time, to be queued again."""
    return rows.where((F.col("ingest_status") == "processing") & (F.col(time) < before))
