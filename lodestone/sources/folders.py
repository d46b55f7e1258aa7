"""Folders listed, and their files read, by tasks: the driver holds nothing of a file, however many there are.

For folders of a file system that is mounted on the driver and all executors. Spark's own readers list on the driver,
which keeps an entry for each file and plans a task for some 32 small ones; they remain for other stores.
"""

from __future__ import annotations

import errno
import itertools
import os
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.shared import dealt, materialise

# Fixed values.
FOLDERS, FILES = 64, 10_000  # for a task
ROWS, BYTES = 10_000, 8 << 20  # of a batch

ENTRY = pa.schema([("path", pa.string()), ("length", pa.int64()), ("changed", pa.int64()), ("folder", pa.bool_())])


def mounted(spark: SparkSession, folder: str) -> str | None:
    """The address of a folder as Spark gives it (file:/…); None for patterns, single files, folders that are missing, and other stores."""
    if any(c in folder for c in "{}[]*?\\"):
        return None
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    full = system.makeQualified(path)
    return full.toString() if full.toUri().getScheme() == "file" and os.path.isdir(full.toUri().getPath()) else None


def passed_over(name: str, folder: bool, length: int) -> bool:
    """Whether Spark's readers leave out an entry: hidden names, names that are no UTF-8, empty files."""
    aside, kept = (name.startswith("_") and "=" not in name) or name.startswith("."), name.startswith(("_metadata", "_common_metadata"))
    return (aside and not (folder and kept)) or (name.endswith("._COPYING_") and not kept) or not (folder or length) or name != name.encode(errors="replace").decode()


def entries(place: str) -> Iterator[tuple[str, int, int, bool]]:
    """path, length, time of change in microseconds (of whole milliseconds, as Spark gives it) and kind of what lies in a folder, one after the other."""
    with os.scandir(place.removeprefix("file:")) as found:
        for e in found:
            try:
                s = e.stat()
            except OSError as x:
                if x.errno not in (errno.ENOENT, errno.ELOOP):  # gone meanwhile, or a link to nothing
                    raise
                continue
            if not passed_over(e.name, folder := stat.S_ISDIR(s.st_mode), s.st_size):
                yield f"{place.rstrip('/')}/{e.name}", s.st_size, s.st_mtime_ns // 1_000_000 * 1000, folder


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = (row for b in batches for place in b.column(0).to_pylist() for row in entries(place))
    while some := [*itertools.islice(rows, ROWS)]:
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*some, strict=True), ENTRY.types, strict=True)], schema=ENTRY)


def listed(spark: SparkSession, root: str, deep: bool = True) -> DataFrame:
    """path, modificationTime, length, folder of what lies in a mounted folder, or at any depth below it. Folders are listed by tasks, level by level; what was listed once stays as it is."""
    found, level, n = None, spark.range(1).select(F.lit(root).alias("path")), 1
    while n:
        part = materialise(dealt(level, "path", n, most=min(FOLDERS, n // 200 + 1)).mapInArrow(_entries, "path string, length long, changed long, folder boolean"), "listing")
        found = part if found is None else found.unionByName(part)
        level = part.where("folder").select("path")
        n = level.count() if deep else 0
    return found.select("path", F.timestamp_micros("changed").alias("modificationTime"), "length", "folder")


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, size, some = 0, 0, []
        for path in batch.column("path").to_pylist():
            with open(path.removeprefix("file:"), "rb") as f:
                some.append(f.read())
            size += len(some[-1])
            if size >= BYTES:
                yield batch.slice(at, len(some)).append_column("content", pa.array(some, pa.binary()))
                at, size, some = at + len(some), 0, []
        if some:
            yield batch.slice(at).append_column("content", pa.array(some, pa.binary()))


def contents(files: DataFrame) -> DataFrame:
    """``files`` (with ``path``) with their ``content``, read by a task for each ten thousand."""
    schema = ", ".join(f"`{c}` {kind}" for c, kind in files.dtypes)
    return dealt(files, "path", files.count(), most=FILES).mapInArrow(_contents, f"{schema}, content binary")
