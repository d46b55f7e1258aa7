"""Sources, sinks and streams on small files."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from lodestone.sources import scans, sinks
from lodestone.streaming import ingest

PNG = b"\x89PNG\r\n\x1a\n" + bytes(20)


def test_image_files_and_kinds(spark, tmp_path):
    for name, data in {"a/x.png": PNG, "a/y.JPG": b"\xff\xd8\xff" + bytes(20), "b/z.txt": b"text", "b/w.webp": b"RIFF1234WEBP", "b/t.png": b"tiny"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    files = scans.image_files(spark, str(tmp_path), labelled=True, content=True)
    assert [(r["label"], r["path"].rsplit("/", 1)[1]) for r in files.collect()] == [("a", "x.png"), ("a", "y.JPG"), ("b", "t.png"), ("b", "w.webp")]
    assert sorted(r["kind"] for r in scans.usable_images(files).collect()) == ["jpeg", "png", "webp"]
    listed = scans.listing(spark, str(tmp_path), most=3, largest=22).collect()
    assert len(listed) == 3 and [r["outcome"] for r in listed] == ["too large", "too large", "ok"]


def test_sidecars_and_golden(spark, tmp_path):
    good = str(uuid.uuid4())
    for name, body in {good: '{"title": "t"}', str(uuid.uuid4()): "{broken", "name": "{}"}.items():
        (tmp_path / f"{name}.json").write_text(body)
    rows = {r["outcome"]: r for r in scans.sidecars(spark, str(tmp_path), "title string").collect()}
    assert rows["ok"]["id"] == good and rows["ok"]["meta"]["title"] == "t" and set(rows) == {"ok", "bad json", "bad name"}
    lines = tmp_path / "golden.jsonl"
    lines.write_text('# comment\n\n{"query": "q", "relevant_image_ids": ["a"], "filters": {"style": "x", "period": [1900, "1950"], "none": null}}\n{"query": "r"}\n')
    got = scans.golden(spark, str(lines)).collect()
    assert [(r["query"], r["relevant"]) for r in got] == [("q", ["a"]), ("r", [])]
    assert got[0]["filters"] == {"style": ["x"], "period": ["1900", "1950"], "none": []} and got[1]["filters"] is None
    lines.write_text('{"notes": "no query"}\n')
    with pytest.raises(Exception, match="no query"):
        scans.golden(spark, str(lines)).collect()


def test_records_and_sitemap(spark, tmp_path):
    oai = tmp_path / "oai.xml"
    dc = "<metadata><oai_dc:dc><dc:title>T</dc:title><dc:creator>A</dc:creator><dc:creator>B</dc:creator><dc:subject>Thesis</dc:subject><dc:date>n.d.</dc:date><dc:date>1999-05</dc:date><dc:identifier>x/1</dc:identifier><dc:identifier>http://h/p.pdf</dc:identifier></oai_dc:dc></metadata>"
    oai.write_text(f'<r><record><header><identifier>1</identifier></header>{dc}</record><record><header status="deleted"><identifier>2</identifier></header></record></r>')
    rows = scans.oai_records(spark, str(oai)).collect()
    assert len(rows) == 1 and rows[0]["creators"] == ["A", "B"] and rows[0]["image_url"] == rows[0]["source_url"] == "http://h/p.pdf"
    thesis = scans.thesis_rows(scans.oai_records(spark, str(oai)), []).first()
    assert thesis["year"] == 1999 and thesis["url"] == "http://h/p.pdf"
    site = tmp_path / "sitemap.xml"
    site.write_text("<x><sitemap><loc> http://a/s.xml </loc></sitemap>" + "".join(f"<url><loc>http://a/{i}</loc></url>" for i in range(5)) + "</x>")
    got = scans.sitemap(spark, str(site), most=3).collect()
    assert [(r["kind"], r["loc"]) for r in got if r["kind"] == "sitemap"] == [("sitemap", "http://a/s.xml")] and len(got) == 4


def test_absolute_addresses(spark):
    base = "http://h/a/b.html?q=1/2#x"
    cases = {"http://o/x": "http://o/x", "//o/x": "http://o/x", "/x": "http://h/x", "x/y": "http://h/a/x/y"}
    df = spark.createDataFrame([(k,) for k in cases], "u string").select("u", scans.absolute(F.col("u"), F.lit(base)).alias("v"))
    assert {r["u"]: r["v"] for r in df.collect()} == cases
    assert spark.range(1).select(scans.absolute(F.lit("x"), F.lit("http://h")).alias("v")).first()["v"] == "http://h/x"


def test_insert_if_absent_twice(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "sha string, n int")
    assert sinks.insert_if_absent(rows, path, "sha", "n") == {"inserted": 2, "skipped": 1, "errors": 1}
    assert sinks.insert_if_absent(rows, path, "sha", "n") == {"inserted": 0, "skipped": 3, "errors": 1}
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("a", 1), ("b", 3)]


def test_replace_by_key(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = lambda rows: spark.createDataFrame(rows, "k int, v string")
    sinks.replace_by_key(frame([(i, "old") for i in range(50)] * 2), path, "k", buckets=8)
    sinks.replace_by_key(frame([(3, "new"), (99, "new")]), path, "k", buckets=8)
    rows = spark.read.parquet(path).select("k", "v").collect()
    assert len(rows) == 100 and [r["v"] for r in rows if r["k"] in (3, 99)] == ["new", "new"]


def test_vector_version_checks_length(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 1), (1, [3.0, 4.0], 2)], "id int, vec array<float>, added_at int")
    assert sinks.vector_version(df, "v1", 2).collect()[0]["vec"] == [3.0, 4.0]
    with pytest.raises(Exception, match="wrong length"):
        sinks.vector_version(df, "v1", 3).collect()


def test_json_sidecars(spark):
    row = sinks.json_sidecars(spark.createDataFrame([(1, None)], "id int, name string"), "id").first()
    assert json.loads(row["json"]) == {"id": 1, "name": None}


def test_ingest_and_completion_streams(spark, tmp_path):
    src, target = str(tmp_path / "in"), str(tmp_path / "images")
    schema = "sha string, n int"
    seen = []
    for part in ([("a", 1), ("a", 2)], [("a", 3), ("b", 4)]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(src)
        stream = ingest.records(spark, src, schema, files_per_batch=1)
        ingest.ingest(stream, target, str(tmp_path / "c1"), "sha", "n", then=[lambda batch, number: seen.append(number)]).awaitTermination()
    rows = spark.read.parquet(target).collect()
    assert {r["sha"] for r in rows} == {"a", "b"} and len(rows) == 2 and {r["ingest_status"] for r in rows} == {"processing"} and seen
    stored = str(tmp_path / "stored")
    sinks.replace_by_key(spark.read.parquet(target), stored, "sha")
    out = str(tmp_path / "out")
    spark.createDataFrame([("b", "described")], "sha string, caption string").write.parquet(out)
    stream = ingest.records(spark, out, "sha string, caption string")
    merge = lambda old, new: old.drop("caption").join(new, "sha")
    sinks.replace_by_key(spark.read.parquet(target).withColumn("caption", F.lit(None).cast("string")), stored, "sha")
    ingest.complete(stream, stored, str(tmp_path / "c2"), "sha", merge).awaitTermination()
    done = {r["sha"]: (r["ingest_status"], r["caption"]) for r in spark.read.option("mergeSchema", "true").parquet(stored).collect()}
    assert done == {"a": ("processing", None), "b": ("ready", "described")}


def test_distinct_stream_with_watermark(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.sql("select timestamp'2024-01-01 00:00:00' as ts, 'a' as sha union all select timestamp'2024-01-01 00:01:00', 'a' union all select timestamp'2024-01-01 00:02:00', 'b'").coalesce(1).write.parquet(src)
    stream = ingest.distinct_records(ingest.records(spark, src, "ts timestamp, sha string"), "sha", "ts")
    stream.writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).format("parquet").start(str(tmp_path / "o")).awaitTermination()
    assert sorted(r["sha"] for r in spark.read.parquet(str(tmp_path / "o")).collect()) == ["a", "b"]
