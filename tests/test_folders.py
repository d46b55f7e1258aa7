"""Folders listed and read by tasks give the rows of Spark's own readers, and leave the driver no file."""

import os
import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.sources import folders, scans


def written(folder, *names, data=b"{}"):
    for name in names:
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(data)


def own(df, folder) -> list[str]:
    """The files below the folder that the driver has in its plans."""
    return [f for f in df.inputFiles() if str(folder) in f]


def test_sidecars_leave_the_driver_no_file(spark, tmp_path):
    ids = [str(uuid.uuid4()) for _ in range(90)]
    written(tmp_path, *(f"{'a/b/' * (i % 3)}{x}.json" for i, x in enumerate(ids)), data=b'{"n": 7}')
    found = scans.sidecars(spark, str(tmp_path), "n int")
    assert not own(found, tmp_path) and found.rdd.getNumPartitions() == 1  # not a task for some 32 files
    assert sorted(tuple(r) for r in found.select("id", "outcome", "meta.n").collect()) == sorted((x, "ok", 7) for x in ids)


def test_sidecars_are_those_that_spark_reads(spark, tmp_path):
    names = ["x.json", "_x.json", "_k=v.json", ".x.json", ".json", "x.json._COPYING_", "_metadata.json", "+ %20é.json", "q?*.json", "x.JSON", "x.json.txt"]
    for d in ("", "a b/", "_hidden/", "_k=v/", ".hidden/", "_metadata/", "%41+/c/d/", "x._COPYING_/"):
        written(tmp_path, *(d + x for x in names), data=b'{"d": "%s"}' % d.encode())
        written(tmp_path, f"{d}empty.json", data=b"")
        written(tmp_path, f"{d}bad.json", data=b'{"d": "\xff"}')
    os.symlink(tmp_path / "a b", tmp_path / "link")
    os.symlink(tmp_path / "nowhere.json", tmp_path / "broken.json")
    read = spark.read.text(str(tmp_path), wholetext=True, pathGlobFilter="*.json", recursiveFileLookup=True).select(F.hex("value"), F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))))
    listed = folders.listed(spark, folders.mounted(spark, f"file://{tmp_path}/")).where("not folder and path like '%.json'").select("path")
    got = folders.contents(listed).select(F.hex("content"), "path")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, read.collect()))
    (tmp_path / "none").mkdir()
    assert scans.sidecars(spark, str(tmp_path / "none"), "n int").count() == 0


def test_entries_and_contents_go_in_small_batches(tmp_path, monkeypatch):
    written(tmp_path, *(f"{i}.json" for i in range(25)), data=b"12345678")
    monkeypatch.setattr(folders, "ROWS", 10)
    monkeypatch.setattr(folders, "BYTES", 30)
    listed = [*folders._entries(iter([pa.RecordBatch.from_pydict({"path": [f"file:{tmp_path}"]})]))]
    assert [b.num_rows for b in listed] == [10, 10, 5] and {x for b in listed for x in b.column("length").to_pylist()} == {8}
    read = [*folders._contents(iter(listed))]
    assert [b.num_rows for b in read] == [4, 4, 2, 4, 4, 2, 4, 1]
    assert sorted(x for b in read for x in b.column("path").to_pylist()) == sorted(f"file:{tmp_path}/{i}.json" for i in range(25))


def test_patterns_files_and_missing_folders_are_left_to_spark(spark, tmp_path):
    written(tmp_path, "a/x.json")
    assert [folders.mounted(spark, f"{tmp_path}/{x}") for x in ("a*", "a/x.json", "none")] == [None] * 3
    assert folders.mounted(spark, f"file://{tmp_path}/a/") == f"file:{tmp_path}/a"
    assert scans.sidecars(spark, f"{tmp_path}/a*", "n int").count() == scans.sidecars(spark, f"{tmp_path}/a/x.json", "n int").count() == 1


def test_image_files_leave_the_driver_no_file(spark, tmp_path):
    written(tmp_path, *(f"class_{i % 3}/{i}.{'PNG' if i % 2 else 'txt'}" for i in range(90)), data=b"12345678")
    for content in (False, True):
        files = scans.image_files(spark, str(tmp_path), labelled=True, content=content)
        assert not own(files, tmp_path)
        assert sorted((r["label"], r["path"], r["length"]) for r in files.collect()) == sorted((f"class_{i % 3}", f"file:{tmp_path}/class_{i % 3}/{i}.PNG", 8) for i in range(1, 90, 2))


def test_image_files_are_those_that_spark_reads(spark, tmp_path):
    names = ["x.png", "y.JPG", "_x.png", "_k=v.png", ".x.png", "x.png._COPYING_", "_metadata.png", "w 1+%2B#é.webp", "q?*.png", "x.txt"]
    for d in ("flat/", "", "a b/", "_hidden/", "_k=v/", ".hidden/", "_metadata/", "%41+/c/d/"):
        written(tmp_path, *(d + x for x in names), data=d.encode() + b"\x89PNG\xff")
        written(tmp_path, f"{d}empty.png", data=b"")
    os.symlink(tmp_path / "flat", tmp_path / "link")
    os.utime(tmp_path / "x.png", ns=(10**18 + 123_456_789,) * 2)
    kept = lambda df: df.where(F.lower("path").rlike(r"\.(png|jpg|webp)$")).orderBy("path")
    for folder, labelled in ((tmp_path, True), (tmp_path / "flat", True), (tmp_path / "flat", False)):
        read = kept(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(folder)))
        files = scans.image_files(spark, str(folder), labelled=labelled, content=True)
        assert files.drop("label").schema == read.schema and [tuple(r) for r in files.drop("label").collect()] == [tuple(r) for r in read.collect()]
        assert not own(files, folder)
        bare = scans.image_files(spark, str(folder), labelled=labelled).drop("label")
        assert [tuple(r) for r in bare.collect()] == [tuple(r) for r in read.drop("content").collect()]


def test_image_files_without_labels_keep_columns_of_partitions(spark, tmp_path):
    written(tmp_path, "k=1/x.png", "k=2/y.png")
    assert [(r["k"], r["path"][-5:]) for r in scans.image_files(spark, str(tmp_path)).collect()] == [(1, "x.png"), (2, "y.png")]
    written(tmp_path / "other", "z.png", "below/x.png")
    assert [r["path"][-5:] for r in scans.image_files(spark, str(tmp_path / "other")).collect()] == ["z.png"]
