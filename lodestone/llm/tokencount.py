"""Token counts by separator scan over flat, unindexed token files.

``write_flat`` tokenises whole texts into one token stream per input partition (a "file"):
documents one after another, each closed by the end-of-document id, cut into blocks of a fixed
number of tokens without regard to documents. ``scan`` finds the separators of every block with
one vectorised comparison; a prefix scan over the blocks of a file then gives the number of
documents and the open tokens before each block, so that documents across block ends are
counted whole. The order of documents in a file is kept apart and only gives counts their ids.

Defined results: null and empty texts have 0 tokens; repeated rows are counted each; a text that
holds the separator's name is ordinary text; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.common import materialise

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END = 50256
# Fixed value: the split pattern that belongs to this vocabulary.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACES = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")
_ENCODERS: dict[int, object] = {}


def _encoder(ranks: bytes):
    """The vocabulary's encoder, and one that takes its text as a single piece."""
    key = hash(ranks)
    if key not in _ENCODERS:
        import tiktoken

        pairs = (line.split() for line in ranks.splitlines() if line)
        known = {base64.b64decode(a): int(b) for a, b in pairs}
        _ENCODERS[key] = tuple(tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=known, special_tokens={}) for name, pattern in (("flat", SPLIT), ("piece", "(?s:.+)")))
    return _ENCODERS[key]


def tokens_of(encoders, text: str) -> list[int]:
    """The tokens of ``text``. The pattern takes a run of spaces as one piece, but for its last if text follows; its matcher
    cannot go through a million of them, so that every run of a thousand or more is cut out and encoded as that one piece."""
    encoder, piece = encoders
    ids, at = [], 0
    for run in SPACES.finditer(text):
        end = run.end() - (run.end() < len(text))
        ids += encoder.encode_ordinary(text[at : run.start()])
        ids += piece.encode_ordinary(text[run.start() : end])
        at = end
    return ids + encoder.encode_ordinary(text[at:])


_FLAT = pa.schema([("file", pa.int32()), ("seq", pa.int64()), ("doc_id", pa.int64()), ("tokens", pa.binary())])


def write_flat(docs: DataFrame, vocabulary: str = VOCABULARY, block: int = 1 << 16) -> DataFrame:
    """file, seq, doc_id, tokens: blocks have tokens (little-endian uint16), the order of documents has none."""
    with open(vocabulary, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, file = _encoder(ranks.value), TaskContext.get().partitionId()
        end, open_, held, n_blocks, n_docs = np.array([END], "<u2"), [], 0, 0, 0

        def out(seqs: list, ids: list, blocks: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([file] * len(seqs), pa.int32()), pa.array(seqs, pa.int64()), pa.array(ids, pa.int64()), pa.array(blocks, pa.binary())], schema=_FLAT)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for text in batch.column(1):
                tokens = np.array(tokens_of(encoder, text.as_py() or ""), "<u2")
                open_ += [tokens, end]
                held += len(tokens) + 1
                if held >= block:
                    stream = np.concatenate(open_)
                    full = held // block
                    yield out(list(range(n_blocks, n_blocks + full)), [None] * full, [stream[i * block : (i + 1) * block].tobytes() for i in range(full)])
                    open_, held, n_blocks = [stream[full * block :]], held - full * block, n_blocks + full
            yield out(list(range(n_docs, n_docs + len(ids))), ids, [None] * len(ids))
            n_docs += len(ids)
        if held:
            yield out([n_blocks], [None], [np.concatenate(open_).tobytes()])

    return docs.select("doc_id", "text").mapInArrow(flat, "file int, seq long, doc_id long, tokens binary")


def scan(blocks: DataFrame, end: int = END) -> DataFrame:
    """file, seq, tokens -> file, place, n_tokens: the length of each closed document, by its place in the file."""

    def separators(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, first, last, inner = [], [], [], []
            for data in batch.column(2):
                tokens = np.frombuffer(data.as_buffer(), "<u2")
                at = np.flatnonzero(tokens == end)
                size.append(len(tokens))
                first.append(int(at[0]) if len(at) else None)
                last.append(int(at[-1]) if len(at) else None)
                inner.append(np.diff(at) - 1)
            arrays = [batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(inner, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["file", "seq", "size", "first", "last", "inner"])

    found = blocks.select("file", "seq", "tokens").mapInArrow(separators, "file int, seq long, size long, first long, last long, inner array<long>")
    before = W.partitionBy("file").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    closed = F.when(F.col("first").isNull(), 0).otherwise(F.size("inner") + 1)
    found = found.withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0).cast("long"))).withColumn("place", F.coalesce(F.sum(closed).over(before), F.lit(0).cast("long")))
    ended = F.last(F.col("at") + F.col("last") + 1, ignorenulls=True).over(before)
    found = found.withColumn("open", F.col("at") - F.coalesce(ended, F.lit(0).cast("long"))).where(F.col("first").isNotNull())
    lengths = F.concat(F.array(F.col("open") + F.col("first")), F.col("inner"))
    return found.select("file", F.col("place").alias("from"), F.posexplode(lengths).alias("i", "n_tokens")).select("file", (F.col("from") + F.col("i")).alias("place"), "n_tokens")


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, block: int = 1 << 16) -> DataFrame:
    """doc_id, n_tokens: a row per document row."""
    flat = materialise(write_flat(docs, vocabulary, block), "token-files")
    lengths = scan(flat.where("tokens is not null"))
    order = flat.where("tokens is null").select("file", F.col("seq").alias("place"), "doc_id")
    return order.join(lengths, ["file", "place"]).select("doc_id", "n_tokens")
