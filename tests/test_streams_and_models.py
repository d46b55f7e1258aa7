"""Timers of the ingest stream, caller-supplied models, named files, the second pass, bounded traversal."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import models
from lodestone.operators import curation, tags
from lodestone.sources import scans, sinks
from lodestone.sources.named_files import place_of, write_named
from lodestone.streaming import ingest

KINDS = "key string, at timestamp, payload string"


def changes(spark, home, records, outputs, **options):
    """All changes after the files of both folders were taken one a batch."""
    for name, parts in (("records", records), ("outputs", outputs)):
        for i, part in enumerate(parts):
            rows = [(k, f"2024-01-01 00:{m:02d}:00", p) for k, m, p in part]
            spark.createDataFrame(rows, "key string, t string, payload string").select("key", F.col("t").cast("timestamp").alias("at"), "payload").coalesce(1).write.parquet(f"{home}/{name}/{i}")
    read = lambda name: spark.readStream.schema(KINDS).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{home}/{name}")
    stream = ingest.tracked(read("records"), read("outputs"), 600, **options)
    stream.writeStream.option("checkpointLocation", f"{home}/c").trigger(availableNow=True).format("parquet").start(f"{home}/out").awaitTermination()
    found = {}
    for r in spark.read.parquet(f"{home}/out").orderBy("key", "at", "tries").collect():
        found.setdefault(r["key"], []).append((r["at"].minute, r["status"], r["tries"], r["payload"]))
    return found


@pytest.mark.parametrize("split", [False, True])
def test_timers_queue_again_and_outputs_complete(spark, tmp_path, split):
    records = [[("quick", 0, None), ("late", 1, None), ("never", 2, None), ("twice", 3, None)], [("twice", 4, None), ("early", 20, None), ("last", 58, None)]]
    outputs = [[("quick", 5, "a"), ("early", 10, "e")], [("quick", 30, "b"), ("late", 24, "c"), ("twice", 13, "d")]]
    if not split:
        records, outputs = [records[0] + records[1]], [outputs[0] + outputs[1]]
    got = changes(spark, str(tmp_path), records, outputs, tries=2, delay="1 hour" if split else "0 seconds")
    late = [(1, "processing", 0, None), (11, "requeued", 1, None), (21, "requeued", 2, None), (24, "ready", 2, "c")]
    assert got["quick"] == [(0, "processing", 0, None), (5, "ready", 0, "a")] and got["late"] == late
    assert got["twice"] == [(3, "processing", 0, None), (13, "ready", 0, "d")]  # done at the moment the timer was set for
    assert got["early"] == [(20, "processing", 0, None), (20, "ready", 0, "e")] and got["last"] == [(58, "processing", 0, None)]
    never = [(2, "processing", 0, None), (12, "requeued", 1, None), (22, "requeued", 2, None), (32, "failed", 2, None)]
    assert got["never"] == (never[:1] if split else never)  # with an hour's delay the watermark has not passed the timer


LOADS = []


def _load():
    LOADS.append(1)
    return lambda texts: [[float(len(t)), float(len(texts)), float(len(LOADS))] if t is not None else [] for t in texts]


def _pairs():
    return lambda queries, texts: [float(len(q) - len(t)) for q, t in zip(queries, texts, strict=True)]


def _short():
    return lambda texts: texts[:-1]


def test_models_are_loaded_once_and_see_batches(spark):
    rows = spark.range(100).select("id", F.when(F.col("id") != 7, F.repeat(F.lit("x"), F.col("id").cast("int"))).alias("text")).repartition(3)
    got = {r["id"]: r["v"] for r in rows.select("id", models.embedder(_load, 32)(F.col("text")).alias("v")).collect()}
    assert got[7] == [] and all(v[0] == i and v[1] <= 32 and v[2] == 1 for i, v in got.items() if i != 7)
    unit = {r["id"]: r["vec"] for r in models.embed_items(rows.withColumnRenamed("text", "item"), models.embedder(_load, 32)).collect()}
    assert unit[7] is None and np.linalg.norm(unit[9]) == pytest.approx(1.0)
    scored = rows.where("text is not null").select("id", models.scorer(_pairs)(F.lit("abc"), F.col("text")).alias("s")).collect()
    assert all(r["s"] == 3 - r["id"] for r in scored)
    with pytest.raises(Exception, match="answers"):
        rows.select(models.extractor(_short)(F.col("text"))).collect()


def test_bag_of_words_counts_in_one_pass(spark):
    import hashlib

    texts = ["a b\tB  a a", "", None, " \n ", "É é one"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    for r in models.embed_passages(df).collect():
        want = np.zeros(64)
        for w in (texts[r["id"]] or "").lower().split():
            want[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 64] += 1
        assert np.allclose(r["vec"], want / (np.linalg.norm(want) or 1.0))


def test_named_files(spark, tmp_path):
    rows = spark.createDataFrame([("a/x y.bin", bytearray(b"\x00\xff")), ("b.txt", bytearray(b"t")), ("empty.txt", None)], "n string, c binary")
    write_named(rows.repartition(2), str(tmp_path), F.col("n"), F.col("c"))
    write_named(rows.where("n = 'b.txt'"), f"file://{tmp_path}", F.col("n"), F.lit("new"))
    held = {str(p.relative_to(tmp_path)): p.read_bytes() for p in tmp_path.rglob("*") if p.is_file() and not p.name.endswith(".crc")}
    assert held == {"a/x y.bin": b"\x00\xff", "b.txt": b"new", "empty.txt": b""}
    for name in ("../x", "/x", "a//b", "", None, "a/./b"):
        with pytest.raises(ValueError, match="not a name"):
            place_of(str(tmp_path), name)
    sinks.write_sidecars(spark.createDataFrame([("k 1", None)], "id string, v int"), "id", f"{tmp_path}/side")
    told = scans.sidecars(spark, f"{tmp_path}/side", "id string, v int").collect()
    assert [(r["id"], r["outcome"]) for r in told] == [("k 1", "bad name")]


def test_second_pass_in_one_step(spark):
    empty = []
    first = spark.createDataFrame(
        [(1, "gothic", "villa", 0.9, "quarantined", ["style:gothic"]), (2, "gothic", "villa", 0.9, "quarantined", empty), (3, "gothic", "villa", 0.9, "provisional", ["style:gothic"]), (4, "gothic", "villa", 0.9, "quarantined", ["style:gothic"]), (5, "gothic", "villa", 0.9, "quarantined", ["style:gothic"]), (6, "gothic", "villa", 0.2, "quarantined", ["style:gothic"])],
        "id long, style_primary string, building_type string, confidence double, tag_status string, stripped array<string>",
    )
    second = spark.createDataFrame([(1, "baroque", True), (2, "baroque", True), (3, "baroque", True), (4, "baroque", False), (5, "modern", True), (6, "baroque", None)], "id long, style_primary string, ok boolean")
    keys = spark.createDataFrame([("style:baroque", [1.0, 0.0]), ("style:modern", [0.0, 1.0])], "key string, key_vec array<double>")
    v = spark.createDataFrame([(i, [1.0, 0.01 * i]) for i in range(1, 21)], "id long, vec array<double>")
    around = spark.createDataFrame([(i, "baroque", "villa") for i in range(1, 21)], "id long, style string, building_type string")
    out = {r["id"]: (r["style_primary"], r["tag_status"], r["final"], r["stripped"]) for r in tags.revalidated(first, second, keys, v, around, ["style_primary"], least_corpus=5).collect()}
    assert out == {
        1: ("baroque", "verified", True, []),
        2: ("gothic", "quarantined", False, []),
        3: ("gothic", "provisional", False, []),
        4: ("gothic", "quarantined", False, []),
        5: ("modern", "quarantined", True, ["style:modern"]),
        6: ("gothic", "quarantined", False, []),
    }


def test_traversal_of_cycles_and_a_hub(spark):
    edges = [(0, i) for i in range(1, 500)] + [(i, i % 7 + 1000) for i in range(1, 500)] + [(1000 + i, 0) for i in range(7)] + [(1003, 2000), (None, 1), (2, None)]
    df = spark.createDataFrame(edges, "src int, dst int")
    roots = spark.createDataFrame([(0,)], "node int")
    got = {r["node"]: r["depth"] for r in curation.reachable(df, roots, 9).collect()}
    assert got == {0: 0, **{i: 1 for i in range(1, 500)}, **{1000 + i: 2 for i in range(7)}, 2000: 3}
    few = {r["node"]: r["depth"] for r in curation.reachable(df, roots, 9, fan_out=3).collect()}
    assert few == {0: 0, 1: 1, 2: 1, 3: 1, 1001: 2, 1002: 2, 1003: 2, 2000: 3}
