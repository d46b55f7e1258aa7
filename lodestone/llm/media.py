"""Media columns: payloads stored as lossless WebP, read back as pixel arrays.

Each text's UTF-8 bytes, zero-filled to a positive multiple of 64, become the samples of images
16 pixels wide (four bytes a pixel: green, red, blue, alpha), 1 MiB of payload to an image at
most, as the format ends at 16,384 rows; a longer text's media column holds several WebP files, one
after another, and its media_bytes and media_sha256 are those of all of them.

Defined results: null text is empty and gives 64 zero bytes; repeated rows are stored each; an
empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import vp8l
from lodestone.llm.common import shared_dir

WIDTH, FILL = 16, 64
LARGEST = 4 * WIDTH * 16384


def to_media(payload: bytes) -> bytes:
    samples = np.frombuffer(payload, np.uint8)
    return b"".join(vp8l.riff(vp8l.encode_stream(samples[i : i + LARGEST], WIDTH)) for i in range(0, len(samples), LARGEST))


def to_pixels(media: bytes) -> list[np.ndarray]:
    """height x width x 4 arrays of alpha, red, green, blue."""
    return [vp8l.decode_stream(s) for s in vp8l.streams(media)]


def to_payload(images: list[np.ndarray]) -> bytes:
    return b"".join(np.ascontiguousarray(x[..., [2, 1, 3, 0]]).tobytes() for x in images)


def feature(images: list[np.ndarray]) -> str:
    """Rows, the mean of each channel, and the entropy of the samples in bits."""
    rows = sum(len(x) for x in images)
    mean = sum(x.sum((0, 1), dtype=np.int64) for x in images) / (rows * WIDTH)
    n = sum(np.bincount(x.ravel(), minlength=256) for x in images)
    share = n[n > 0] / n.sum()
    return f"rows={rows};argb={','.join(f'{v:.3f}' for v in mean)};bits={abs(float(-(share * np.log2(share)).sum())):.4f}"


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media for each document row, written to the shared folder and read again."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, media = [], []
            for text in batch.column(1):
                raw = (text.as_py() or "").encode()
                sizes.append(len(raw))
                media.append(to_media(raw + b"\0" * (max(FILL, -(-len(raw) // FILL) * FILL) - len(raw))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    import uuid

    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/lodestone/media-{uuid.uuid4().hex}"
    schema = "doc_id long, n_bytes long, media binary"
    docs.select("doc_id", "text").mapInArrow(encode, schema).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def read(media: DataFrame) -> DataFrame:
    """The contract's columns, from the pixels of the stored media."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for data in batch.column(2):
                raw = data.as_py()
                images = to_pixels(raw)
                payload = to_payload(images)
                row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-FILL:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(images))
                for col, x in zip(cols, row, strict=True):
                    col.append(x)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            arrays = [batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select(F.col("doc_id"), "n_bytes", "media").mapInArrow(decode, schema)
