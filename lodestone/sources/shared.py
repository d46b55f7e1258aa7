"""The folder that driver and executors share, and tables written there to end a lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; on a local master (tests) a temporary folder where it is unset."""
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
    """``df`` written as Parquet in the shared folder and read back: what was numbered or sampled once stays as it is."""
    path = f"{shared_dir(df.sparkSession)}/lodestone/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, key: str, rows: int, most: int = 250_000) -> DataFrame:
    """``df`` dealt by key into parts of about ``most`` of ``rows``: streams have a fixed number of partitions, which would grow with the tables."""
    return df.repartition(max(1, -(-rows // most)), key)


def sent(df: DataFrame, what: str, most: int = 10_000) -> DataFrame:
    """``df`` to be broadcast, after a check that it has no more than ``most`` rows."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} {what}")
    return F.broadcast(df)
