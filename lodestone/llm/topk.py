"""Exact top-k search by block-at-a-time pruning.

Vectors become integers, floor(256 * x). Each task holds forward indexes of document-range blocks
with the largest and smallest value of every term (component) in a block. For a query the sum of
its terms' best products bounds a block's scores; blocks are scored through their forward index
in the order of their bounds, in waves of doubling length, until no bound reaches the query's
k-th score. Scores are whole numbers computed exactly.

Queries go to all tasks in batches of at most about ``batch`` vectors; with more queries there
are more batches, each of which reads the vectors again. Each task returns k rows a query, and a
window over query_id takes the best of them.

Defined results: vectors that are null or empty, or hold null or non-finite components, take no
part, nor do rows without vec_id; only vectors of a query's length are its candidates; rows
with the query's vec_id are its own; a query that recurs with the same vector counts once; ties
go to the smaller vec_id; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.common import materialise

BLOCK = 256
EXACT = 1 << 53


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """vec_id, v: array<long> of the rows that take part."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    # 256 * |x| above 2**62 has no place in a long; such components count as non-finite
    fits = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < 2.0**54))
    good = vectors.select("vec_id", x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & fits)
    return good.select("vec_id", F.transform("x", lambda v: F.floor(v * 256)).alias("v"))


class Best:
    """The k best (score, id) of each query so far: larger scores first, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.k, self.kth = k, np.full(n, np.iinfo(np.int64).min)
        self.query, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        query, score, ids = (np.concatenate(x) for x in ((self.query, query), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        first = np.flatnonzero(np.diff(query, prepend=-1))
        rank = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        keep = rank < self.k
        self.query, self.score, self.id = query[keep], score[keep], ids[keep]
        last = rank[keep] == self.k - 1
        self.kth[self.query[last]] = self.score[last]


def _search(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, best: Best) -> None:
    """Adds to ``best`` what one range of documents has for the queries."""
    order = np.argsort(ids, kind="stable")
    vectors, ids = vectors[order], ids[order]
    at = np.arange(0, len(ids), BLOCK)
    most = int(np.abs(queries).max(initial=0)) * int(np.abs(vectors).max(initial=0)) * queries.shape[1]
    kind = np.float64 if most < EXACT else np.int64 if most < 1 << 63 else object
    q, x = queries.astype(kind), vectors.astype(kind)
    top, low = np.maximum.reduceat(x, at), np.minimum.reduceat(x, at)
    bound = np.maximum(q, 0) @ top.T + np.minimum(q, 0) @ low.T
    turn = np.argsort(np.argsort(-bound.astype(np.float64), axis=1, kind="stable"), axis=1, kind="stable")
    lo, hi = 0, 1
    while lo < len(at):
        wave = (turn >= lo) & (turn < hi) & (bound >= best.kth[:, None])
        for b in np.flatnonzero(wave.any(0)):
            who = np.flatnonzero(wave[:, b])
            who = who[bound[who, b] >= best.kth[who]]
            span = slice(at[b], at[b] + BLOCK)
            score = (q[who] @ x[span].T).astype(np.int64)
            near = (score >= best.kth[who][:, None]) & (query_ids[who][:, None] != ids[span])
            i, j = np.nonzero(near)
            if len(i):
                best.add(who[i], score[i, j], ids[span][j])
        lo, hi = hi, 2 * hi + 1


def _matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of that length, and which they are."""
    lengths = np.diff(column.offsets.to_numpy())
    flat, at = column.flatten().to_numpy(), np.flatnonzero(lengths == size)
    if len(at) == len(lengths):
        return flat.reshape(-1, size), at
    first = np.cumsum(lengths) - lengths
    return flat[first[at][:, None] + np.arange(size)], at


def top_k(vectors: DataFrame, is_query, k: int = 5, batch: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of each query row."""
    spark = vectors.sparkSession
    rows = materialise(whole_numbers(vectors), "search-vectors")
    queries = rows.where(is_query).distinct()
    n = queries.count()
    n_batches = max(1, -(-n // batch))
    found = []
    for b in range(n_batches):
        chosen = queries.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_batches)) == b).collect()  # about ``batch`` rows
        by_size: dict[int, list] = {}
        for r in chosen:
            by_size.setdefault(len(r["v"]), []).append(r)
        told = spark.sparkContext.broadcast({s: (np.array([r["v"] for r in rs], np.int64), np.array([r["vec_id"] for r in rs], np.int64)) for s, rs in by_size.items()})

        def search(batches: Iterator[pa.RecordBatch], told=told) -> Iterator[pa.RecordBatch]:
            best = {s: Best(len(ids), k) for s, (_, ids) in told.value.items()}
            for part in batches:
                ids = part.column(0).to_numpy()
                for s, (q, q_ids) in told.value.items():
                    x, at = _matrix(part.column(1), s)
                    if len(at):
                        _search(q, q_ids, x, ids[at], best[s])
            for s, x in best.items():
                if len(x.query):
                    yield pa.RecordBatch.from_arrays([pa.array(told.value[s][1][x.query]), pa.array(x.query), pa.array(x.id), pa.array(x.score)], names=["query_id", "place", "vec_id", "score"])

        part = rows.select("vec_id", "v").mapInArrow(search, "query_id long, place long, vec_id long, score long").withColumn("batch", F.lit(b))
        found.append(materialise(part, "search-found") if n_batches > 1 else part)
    order = W.partitionBy("batch", "query_id", "place").orderBy(F.desc("score"), "vec_id")
    out = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
