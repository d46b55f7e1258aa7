"""Shared helpers of the training-data operators: shared storage, splits, hashes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_FALLBACK: dict[str, str] = {}
_LEFT: dict[str, dict] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``; on a local master (tests) a temporary one where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="spark-lodestone-")
    return _FALLBACK[app]


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, label: str, what: Column | None = None) -> tuple[DataFrame, int]:
    """``materialise``, and the number of rows (those where ``what`` holds), told by the writing job itself: a further job would leave its plan in the driver."""
    seen = Observation()
    told = F.count(F.lit(1)) if what is None else F.count(F.when(what, 1))
    out = materialise(df.observe(seen, told.alias("n")), label)
    return out, seen.get["n"]


def left_by(operator: str) -> dict:
    """What tasks of ``operator`` left in this Python worker for its next ones; what those of others left goes, as workers outlive a stage."""
    for other in [x for x in _LEFT if x != operator]:
        del _LEFT[other]
    return _LEFT.setdefault(operator, {})


def release_unused() -> None:
    """At the end of a task: what Arrow and the C library hold free goes back, as Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out of every fit."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5))


def fresh(name: str, taken: list[str]) -> str:
    """A column name that clashes with none of ``taken`` (case-insensitively)."""
    have = {x.lower() for x in taken}
    while name.lower() in have:
        name = "_" + name
    return name


MOST_ROWS = 1_000_000  # rows of a narrow table that are broadcast at most; larger ones go by a shuffle


def join_small(docs: DataFrame, small: DataFrame, on: str, how: str, most: int = MOST_ROWS) -> DataFrame:
    """Join wide ``docs`` with a narrow table: broadcast after counting it, else by a shuffle that adaptive execution can split."""
    small, n = counted(small, "narrow")
    return docs.join(F.broadcast(small) if n <= most else small, on, how)
