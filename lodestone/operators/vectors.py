"""Exact vector search and vector arithmetic.

``knn`` sends up to a batch of queries to the tasks; every task multiplies its vectors with them block by
block, keeps the k best of each query over all of its blocks, and gives them when it ends. More queries meet
the vectors block against block: each side is dealt into blocks of bounded size, a task takes one pair of
blocks, and neither queries nor vectors pass the driver. A window over the query takes the best of what tasks give.

Queries may carry filters of their own (``filters.compiled``): each task turns its rows' predicate bits into one
bitmap for each different filter, and a query sees only the rows of its bitmap.

Labels are a matrix that every task holds: a row's scores against all labels, and what is made of them, stay in its batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.sources.shared import materialise

DIGITS = 6
MOST_LABELS = 10_000
BLOCK, ROWS = 512, 4096  # queries and vectors that are multiplied at once
CELLS = 4_000_000  # scores of a batch against all labels
SIDE = 1_000_000  # numbers of one side of a block pair


def _dense(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def knn(queries: DataFrame, vectors: DataFrame, k: int, batch: int = 8192, digits: int = DIGITS, filtered: bool = False, cells: int = SIDE) -> DataFrame:
    """qid, id, score, rank: for (qid, vec) queries the k vectors of (id, vec) with the largest inner product.

    Scores are rounded to ``digits``, ties go to the smaller id. All vectors have one length; null ones take no part.
    ``filtered``: queries have ``wanted`` and vectors ``bits`` beside, and a query's k best are those of its own rows.
    """
    asked = queries.where("vec is not null").select("qid", "vec", *["wanted"] * filtered)
    found = vectors.where("vec is not null").select("id", "vec", *["bits"] * filtered)
    kinds = f"qid {queries.schema['qid'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, score double"
    few = asked.limit(batch + 1).collect()
    if not few:
        return vectors.sparkSession.createDataFrame([], f"{kinds}, rank int")
    hits = _sent(few, found, k, digits, kinds) if len(few) <= batch else _met(asked, found, k, digits, max(1024, cells // max(len(few[0]["vec"]), 1)), kinds)
    return ranked(hits).where(F.col("rank") <= k)


def _sent(rows: list, found: DataFrame, k: int, digits: int, kinds: str) -> DataFrame:
    """The best of each task for a batch of queries that all tasks hold."""
    spark = found.sparkSession
    classes = [r["wanted"] for r in rows] if "bits" in found.columns else None
    told = spark.sparkContext.broadcast((np.array([r["vec"] for r in rows], np.float64), classes))
    qid, id_ = kinds.split(", ")[:2]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(told.value[0], k, digits, told.value[1])
        for batch in batches:
            best.add(*batch.columns)
        yield from best.rows()

    hits = found.mapInArrow(search, f"place int, {id_}, score double")
    names = spark.createDataFrame([(i, r["qid"]) for i, r in enumerate(rows)], f"place int, {qid}")
    return hits.join(F.broadcast(names), "place").select("qid", "id", "score")  # a batch of names at most


def _met(asked: DataFrame, found: DataFrame, k: int, digits: int, block: int, kinds: str) -> DataFrame:
    """The best of each pair of a block of queries and a block of vectors."""
    asked = asked.select(*[F.col(c).alias(c) for c in asked.columns])  # columns of its own, where queries come of the vectors
    asked, found = materialise(asked, "asked"), materialise(found, "found")  # counted and then dealt
    n_q, n_v = (max(1, -(-df.count() // block)) for df in (asked, found))
    dealt = lambda df, key, own, n, other, m: df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))).groupBy("_q", "_v")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        part = lambda t, c: t.column(c).combine_chunks()
        if not len(left) or not len(right):
            return pa.table({"qid": part(left, "qid").slice(0, 0), "id": part(right, "id").slice(0, 0), "score": pa.array([], pa.float64())})
        best = Best(_dense(part(left, "vec")), k, digits, part(left, "wanted").to_pylist() if "wanted" in left.column_names else None)
        some = [part(right, c) for c in ("id", "vec", "bits") if c in right.column_names]
        best.add(*some)
        out = pa.Table.from_batches(best.rows(), pa.schema([("place", pa.int32()), ("id", some[0].type), ("score", pa.float64())]))
        return pa.table({"qid": part(left, "qid").take(out.column("place").combine_chunks()), "id": out.column("id"), "score": out.column("score")})

    return dealt(asked, "qid", "_q", n_q, "_v", n_v).cogroup(dealt(found, "id", "_v", n_v, "_q", n_q)).applyInArrow(search, kinds)


class Best:
    """The k best (score, id) of each query among the vectors seen so far; ties go to the smaller id.

    With ``wanted``, a filter for each query (facets that all must hold, each a list of places of predicates of which one must),
    queries of one filter share a bitmap over the rows of a batch.
    """

    def __init__(self, queries: np.ndarray, k: int, digits: int, wanted: list | None = None):
        self.queries, self.k, self.digits = queries, k, digits
        self.filters: dict[tuple, int] = {}
        self.filter_of = None if wanted is None else np.array([self.filters.setdefault(tuple(map(tuple, w or ())), len(self.filters)) for w in wanted], np.int64)
        self.place, self.ids, self.score = np.zeros(0, np.int32), None, np.zeros(0)
        self.least, self.norms, self.step = np.full(len(queries), -np.inf), np.sqrt((queries * queries).sum(1)), 10.0**-digits

    def add(self, ids: pa.Array, vectors: pa.Array, bits: pa.Array | None = None) -> None:
        for at in range(0, len(ids), ROWS):
            self._add(*[c.slice(at, ROWS) for c in (ids, vectors, *[bits] * (bits is not None))])

    def _add(self, ids: pa.Array, vectors: pa.Array, bits: pa.Array | None = None) -> None:
        """Single precision and a bound of its error tell which pairs can matter; their scores are exact."""
        dense = _dense(vectors)
        with np.errstate(all="ignore"):
            far = np.sqrt((dense * dense).sum(1)).max() if dense.size else 0.0
            slack = self.norms * far * (dense.shape[1] + 2) * 2.0**-22
            rough = np.float32 if np.isfinite(slack).all() and self.norms.max(initial=0) < 1e18 and far < 1e18 else np.float64
            queries, columns = self.queries.astype(rough, copy=False), dense.astype(rough, copy=False).T
        seen = None if self.filter_of is None else self._bitmaps(bits)
        told = []
        for at in range(0, len(self.queries), BLOCK):
            score = queries[at : at + BLOCK] @ columns
            if seen is not None:
                score[~seen[self.filter_of[at : at + BLOCK]]] = -np.inf
            least, off = self.least[at : at + BLOCK], slack[at : at + BLOCK] if rough is np.float32 else 0.0
            if score.shape[1] > self.k and np.isneginf(least).any():
                least = np.maximum(least, np.partition(score, -self.k, axis=1)[:, -self.k] - off - self.step)
            bar = np.maximum(np.nextafter((least - off - self.step).astype(rough), rough(-np.inf)), np.finfo(rough).min)
            i, j = np.divmod(np.flatnonzero(score >= bar[:, None]), score.shape[1])  # ties with the k-th score go on to the cut
            for low in range(0, len(i), CELLS // 64):
                x, y = i[low : low + CELLS // 64] + at, j[low : low + CELLS // 64]
                exact = np.round(np.einsum("ij,ij->i", self.queries[x], dense[y]), self.digits) + 0.0
                some = exact >= self.least[x]
                told.append((x[some].astype(np.int32), y[some], exact[some]))
        if told:
            place, row, score = (np.concatenate(c) for c in zip(*told, strict=True))
            self._keep(place, ids.take(pa.array(row)), score)

    def _bitmaps(self, bits: pa.Array) -> np.ndarray:
        """filters x rows: which rows each filter lets pass."""
        held = bits.flatten().to_numpy(zero_copy_only=False).astype(bool).reshape(len(bits), -1)
        out = np.ones((len(self.filters), len(bits)), bool)
        for wanted, i in self.filters.items():
            for facet in wanted:
                out[i] &= held[:, np.array(facet, np.int64) - 1].any(1)
        return out

    def _keep(self, place: np.ndarray, ids: pa.Array, score: np.ndarray) -> None:
        place, score = np.append(self.place, place), np.append(self.score, score)
        ids = ids if self.ids is None else pa.concat_arrays([self.ids, ids])
        by_id = np.empty(len(ids), np.int64)
        by_id[pa.compute.array_sort_indices(ids).to_numpy()] = np.arange(len(ids))
        order = np.lexsort((by_id, -score, place))
        sorted_ = place[order]
        rank = np.arange(len(order)) - np.searchsorted(sorted_, sorted_)
        full = rank == self.k - 1
        self.least[sorted_[full]] = score[order][full]
        kept = order[rank < self.k]
        self.place, self.ids, self.score = place[kept], ids.take(pa.array(kept)), score[kept]

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.ids is not None:
            yield pa.RecordBatch.from_arrays([pa.array(self.place), self.ids, pa.array(self.score)], names=["place", "id", "score"])


def ranked(scored: DataFrame, *more: Column, query: str = "qid", item: str = "id") -> DataFrame:
    """Adds ``rank`` (from 1) by score, further columns, and the id."""
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(query).orderBy(F.desc("score"), *more, item)))


def dot(a: Column, b: Column) -> Column:
    """The inner product as an expression, summed in index order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row, however often it is used."""
    return F.element_at(F.transform(F.array(value), lambda x: use(x)), 1)


def l2_normalised(v: Column, epsilon: float = 0.0) -> Column:
    """Unit length; a zero vector stays as it is (or is divided by ``epsilon``)."""
    divided = lambda x, n: F.transform(x, lambda c: F.when(n == 0, c.cast("double")).otherwise(c.cast("double") / n))
    return bound(v, lambda x: bound(norm(x) + F.lit(epsilon), lambda n: divided(x, n)))


def similar(ids: DataFrame, vectors: DataFrame, k: int = 6, floor: float | None = 0.70) -> DataFrame:
    """Similar to stored vectors by id: k + 1 found, the own one dropped, floor, first k. Absent ids give nothing."""
    hits = knn(ids.join(vectors, ids.qid == vectors.id).select("qid", "vec"), vectors, k + 1).where("id <> qid")
    if floor is not None:
        hits = hits.where(F.col("score") >= floor)
    return ranked(hits.drop("rank")).where(F.col("rank") <= k)


class Vocabulary:
    """Names, by rising name, and vectors of a (label, vec) table of at most MOST_LABELS rows."""

    def __init__(self, labels: DataFrame):
        rows = sorted(labels.select("label", "vec").where("vec is not null").limit(MOST_LABELS + 1).collect(), key=lambda r: r["label"])
        if len(rows) > MOST_LABELS:
            raise ValueError(f"more than {MOST_LABELS} labels; search them by knn")
        self.type, self.names = labels.schema["label"].dataType.simpleString(), [r["label"] for r in rows]
        self.matrix = np.array([r["vec"] for r in rows], np.float64)

    def places(self, names: pa.Array) -> np.ndarray:
        """The place of each name, -1 for others."""
        at = {n: i for i, n in enumerate(self.names)}
        return np.array([at.get(n, -1) for n in names.to_pylist()], np.int64)

    def array(self) -> pa.Array:
        return pa.array(self.names, {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[self.type])


def by_labels(rows: DataFrame, labels: DataFrame | Vocabulary, tell: Callable[[Vocabulary, np.ndarray, list[pa.Array]], list[pa.Array]], schema: str, *keep: str) -> DataFrame:
    """What ``tell(vocabulary, scores, kept columns)`` makes of each batch of (id, vec, keep) rows; ``scores`` is rows x labels, rounded."""
    known = labels if isinstance(labels, Vocabulary) else Vocabulary(labels)
    told = rows.sparkSession.sparkContext.broadcast(known)
    names = [c.split()[0] for c in schema.split(", ")]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CELLS // max(len(told.value.names), 1))
        for batch in batches if told.value.names else ():
            for at in range(0, len(batch), step):
                some = batch.slice(at, step)
                scores = np.round(_dense(some.column(0)) @ told.value.matrix.T, DIGITS) + 0.0
                yield pa.RecordBatch.from_arrays(tell(told.value, scores, some.columns[1:]), names=names)

    return rows.where("vec is not null").select("vec", "id", *keep).mapInArrow(score, schema)


def _id(rows: DataFrame) -> str:
    return f"id {rows.schema['id'].dataType.simpleString()}"


def class_scores(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """id, label, cos: every row against the vocabulary."""

    def tell(known: Vocabulary, scores: np.ndarray, kept: list[pa.Array]) -> list[pa.Array]:
        n, m = scores.shape
        return [kept[0].take(pa.array(np.repeat(np.arange(n), m))), known.array().take(pa.array(np.tile(np.arange(m), n))), pa.array(scores.ravel())]

    known = Vocabulary(labels)
    return by_labels(rows, known, tell, f"{_id(rows)}, label {known.type}, cos double")


def softmax(scores: np.ndarray, scale: float) -> np.ndarray:
    p = np.exp(scale * (scores - scores.max(1, keepdims=True)))
    return p / p.sum(1, keepdims=True)


def zero_shot(rows: DataFrame, labels: DataFrame, least: float = 0.20, scale: float = 100.0, other: tuple[str, ...] = ()) -> DataFrame:
    """id, label, conf: softmax(scale * cos) and its largest label, ties to the smaller one; label null below ``least`` or when it is in ``other``."""

    def tell(known: Vocabulary, scores: np.ndarray, kept: list[pa.Array]) -> list[pa.Array]:
        best, conf = scores.argmax(1), softmax(scores, scale).max(1)
        drop = np.isin(best, [i for i, n in enumerate(known.names) if str(n) in other]) | (conf < least)
        return [kept[0], known.array().take(pa.array(best, mask=drop)), pa.array(conf)]

    known = Vocabulary(labels)
    return by_labels(rows, known, tell, f"{_id(rows)}, label {known.type}, conf double")


def own_label(rows: DataFrame, labels: DataFrame, own: str = "own", scale: float = 100.0) -> DataFrame:
    """id, rank, p: where the row's own label stands among all (by cosine, then label), and its softmax; null if there is no such label."""

    def tell(known: Vocabulary, scores: np.ndarray, kept: list[pa.Array]) -> list[pa.Array]:
        at = known.places(kept[1])
        mine = scores[np.arange(len(at)), np.maximum(at, 0)]
        before = (scores > mine[:, None]) | ((scores == mine[:, None]) & (np.arange(scores.shape[1]) < at[:, None]))
        return [kept[0], pa.array(before.sum(1).astype(np.int32) + 1, pa.int32(), mask=at < 0), pa.array(softmax(scores, scale)[np.arange(len(at)), np.maximum(at, 0)], mask=at < 0)]

    return by_labels(rows, labels, tell, f"{_id(rows)}, rank int, p double", own)


def hard_negative_margins(rows: DataFrame, labels: DataFrame, negatives: DataFrame, own: str = "own") -> DataFrame:
    """id, margin: own-label cosine less the best cosine of the own class's (own_class, negative) labels."""
    pairs = negatives.select("own_class", "negative").distinct().limit(100 * MOST_LABELS + 1).collect()
    if len(pairs) > 100 * MOST_LABELS:
        raise ValueError(f"more than {100 * MOST_LABELS} pairs of a class and a negative")
    against: dict = {}
    for a, b in pairs:
        against.setdefault(a, []).append(b)

    def tell(known: Vocabulary, scores: np.ndarray, kept: list[pa.Array]) -> list[pa.Array]:
        at, margin = known.places(kept[1]), np.full(len(scores), np.nan)
        for c in set(at[at >= 0].tolist()):
            far = [i for i, n in enumerate(known.names) if n in against.get(known.names[c], ())]
            if far:
                mine = np.flatnonzero(at == c)
                margin[mine] = np.round(scores[mine, c] - scores[mine][:, far].max(1), DIGITS) + 0.0
        return [kept[0], pa.array(margin, mask=np.isnan(margin))]

    return by_labels(rows, labels, tell, f"{_id(rows)}, margin double", own).where("margin is not null")


def label_consistency(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """id, mean, std, least, most of a row's similarities to all labels."""

    def tell(known: Vocabulary, scores: np.ndarray, kept: list[pa.Array]) -> list[pa.Array]:
        return [kept[0], *[pa.array(np.round(f(scores, axis=1), 8) + 0.0) for f in (np.mean, np.std, np.min, np.max)]]

    return by_labels(rows, labels, tell, f"{_id(rows)}, mean double, std double, least double, most double")


def similarity_stats(rows: DataFrame, labels: DataFrame, own: str = "own", ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    """mean, std, n of the whole matrix of rows and labels, and the share of rows whose own label is among the k best (recall_k)."""

    def tell(known: Vocabulary, scores: np.ndarray, kept: list[pa.Array]) -> list[pa.Array]:
        at = known.places(kept[1])
        mine = scores[np.arange(len(at)), np.maximum(at, 0)]
        before = ((scores > mine[:, None]) | ((scores == mine[:, None]) & (np.arange(scores.shape[1]) < at[:, None]))).sum(1)
        return [pa.array(scores.mean(1)), pa.array(scores.var(1)), pa.array(np.where(at < 0, len(known.names), before).astype(np.int32))]

    known = Vocabulary(labels)
    per_row = by_labels(rows, known, tell, "m double, v double, before int", own)
    n = F.count("*") * len(known.names)  # every row has as many scores: the whole variance is that inside rows and that of their means
    recalls = [F.round(F.avg((F.col("before") < k).cast("double")), DIGITS).alias(f"recall_{k}") for k in ks]
    return per_row.agg(F.round(F.avg("m"), DIGITS).alias("mean"), F.round(F.sqrt((F.avg("v") + F.var_pop("m")) * n / (n - 1)), DIGITS).alias("std"), n.alias("n"), *recalls)


def centroids(rows: DataFrame, label: str) -> DataFrame:
    """label, vec: the mean of each class's vectors, made unit length."""
    means = rows.select(label, F.posexplode("vec").alias("i", "x")).groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    vec = F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"])
    return means.groupBy(label).agg(vec.alias("vec")).select(F.col(label).alias("label"), l2_normalised(F.col("vec")).alias("vec"))


def top_styles(rows: DataFrame, labels: DataFrame, n: int = 3, least: float = 0.20) -> DataFrame:
    """id, styles, confidence: the labels of the n best cosines of at least ``least``, best first."""

    def tell(known: Vocabulary, scores: np.ndarray, kept: list[pa.Array]) -> list[pa.Array]:
        best = np.argsort(-scores, axis=1, kind="stable")[:, :n]
        value = np.take_along_axis(scores, best, 1)
        held = np.flatnonzero(value[:, 0] >= least)
        styles = [",".join(str(known.names[j]) for j, v in zip(best[i], value[i], strict=True) if v >= least) for i in held]
        return [kept[0].take(pa.array(held)), pa.array(styles, pa.string()), pa.array(value[held, 0])]

    return by_labels(rows, labels, tell, f"{_id(rows)}, styles string, confidence double")
