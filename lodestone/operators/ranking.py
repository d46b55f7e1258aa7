"""Fusion, penalties, diversity, reranking, component search and the retrieval pipelines, batched over queries."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators.filters import Facets, compiled, either_floor, passes, relative_floor
from lodestone.operators.vectors import DIGITS, knn, ranked


def reciprocal_rank_fusion(lists: list[DataFrame], k: int = 60, keep: tuple[str, ...] = ()) -> DataFrame:
    """qid, id, score, rank from (qid, id, score, rank) lists: sum of 1 / (k + rank), ties as first seen.

    A query with one non-empty list keeps that list's raw scores. ``keep`` names further columns for the lists'
    own scores, so that no list is needed a second time.
    """
    numbered = reduce(DataFrame.unionByName, [x.select("qid", "id", "score", "rank", F.lit(i).alias("list")) for i, x in enumerate(lists)])
    own = [F.max(F.when(F.col("list") == i, F.col("score"))).alias(name) for i, name in enumerate(keep)]
    fused = numbered.groupBy("qid", "id").agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("fused"), F.max("score").alias("raw"), F.min(F.struct("list", "rank")).alias("seen"), F.max("list").alias("last"), *own)
    w = W.partitionBy("qid")
    alone = F.min("seen.list").over(w) == F.max("last").over(w)
    scored = fused.select("qid", "id", F.round(F.when(alone, F.col("raw")).otherwise(F.col("fused")), 9).alias("score"), "seen", *keep)
    return ranked(scored, F.col("seen")).drop("seen")


def weighted_hybrid(image: DataFrame, meta: DataFrame, first: int = 10, k: int = 5, weights: tuple[float, float] = (0.6, 0.4)) -> DataFrame:
    """The ``first`` best of the (qid, id, score, rank) image hits, scored anew with (qid, id, meta_score)."""
    rows = image.where(F.col("rank") <= first).join(meta, ["qid", "id"], "left")
    score = F.round(weights[0] * F.col("score") + weights[1] * F.coalesce("meta_score", F.lit(0.0)), DIGITS)
    return ranked(rows.select("qid", "id", score.alias("score"))).where(F.col("rank") <= k)


def penalised(scored: DataFrame, status: str = "tag_status", penalty: float = 0.05) -> DataFrame:
    """Provisional rows lose ``penalty`` of their score; order by (score, rank before)."""
    new = F.when(F.col(status) == "provisional", F.col("score") * (1 - penalty)).otherwise(F.col("score"))
    out = scored.withColumn("score", F.round(new, 9)).withColumnRenamed("rank", "rank_before")
    return out.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "rank_before"))).drop("rank_before")


def best_per_parent(scored: DataFrame, parent: str) -> DataFrame:
    return scored.withColumn("place", F.row_number().over(W.partitionBy("qid", parent).orderBy(F.desc("score"), "id"))).where("place = 1").drop("place")


def mmr(candidates: DataFrame, k: int = 5, weight: float = 0.7) -> DataFrame:
    """qid, id, score, rank from (qid, id, score, vec): the most relevant first, then greedily
    weight * relevance - (1 - weight) * largest similarity to the chosen; the score stays the relevance.

    A query's candidates (a hundred or so) are one group; the choice is sequential.
    """

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True], ignore_index=True)
        vec = np.array(pdf["vec"].tolist(), np.float64)
        near, free, chosen = vec @ vec.T, np.ones(len(pdf), bool), []
        while len(chosen) < min(k, len(pdf)):
            value = pdf["score"].to_numpy(float) if not chosen else weight * pdf["score"].to_numpy(float) - (1 - weight) * near[:, chosen].max(1)
            i = int(np.argmax(np.where(free, np.round(value, 12), -np.inf)))
            free[i] = False
            chosen.append(i)
        return pdf.loc[chosen, ["qid", "id", "score"]].assign(rank=range(1, len(chosen) + 1))

    kinds = dict(candidates.dtypes)
    return candidates.select("qid", "id", "score", "vec").groupBy("qid").applyInPandas(choose, f"qid {kinds['qid']}, id {kinds['id']}, score double, rank int")


def overlap_score(query: Column, text: Column) -> Column:
    """The default scorer: the share of the query's distinct words that the text holds, as a logit in -4..4."""
    words = F.array_distinct(F.filter(F.split(F.lower(query), r"\s+"), lambda w: w != ""))
    hits = F.size(F.array_intersect(words, F.split(F.lower(text), r"\s+")))
    return 8.0 * hits / F.greatest(F.size(words), F.lit(1)) - 4.0


def reranked(candidates: DataFrame, scorer=overlap_score, query: str = "query", text: str = "text") -> DataFrame:
    """Candidates by sigmoid(scorer(query, text)); ``scorer`` makes a column, e.g. a caller's pandas UDF."""
    score = F.round(1.0 / (1.0 + F.exp(-scorer(F.col(query), F.col(text)))), DIGITS)
    return ranked(candidates.drop("rank").withColumn("score", score))


def component_search(queries: DataFrame, segments: DataFrame, images: DataFrame, k: int = 12, oversample: int = 8) -> DataFrame:
    """qid, image_id, score, tier, rank: the best segment of each other image (tier 0), filled up from whole images (tier 1).

    queries (qid, vec, own_image), segments (id, image_id, vec), images (id, vec).
    """
    own = queries.select("qid", "own_image")
    hits = knn(queries.select("qid", "vec"), segments.select("id", "vec"), k * oversample).drop("rank")
    hits = hits.join(segments.select("id", "image_id"), "id").join(own, "qid").where("image_id <> own_image or own_image is null")
    first = best_per_parent(hits, "image_id").withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    first = first.select("qid", "image_id", "score", F.lit(0).alias("tier"))
    whole = knn(queries.select("qid", "vec"), images, 4 * k).join(own, "qid").where("id <> own_image or own_image is null")
    fill = whole.select("qid", F.col("id").alias("image_id"), "score", F.lit(1).alias("tier")).join(first, ["qid", "image_id"], "left_anti")
    both = first.unionByName(fill)
    return both.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("tier", F.desc("score"), "image_id"))).where(F.col("rank") <= k)


def with_rows(hits: DataFrame, rows: DataFrame, key: str = "image_id") -> DataFrame:
    """Hits with their rows; ids without a row drop out after the cut, the rank stays."""
    return hits.join(rows.withColumnRenamed(key, "id"), "id")


def _kept(hits: DataFrame, rows: DataFrame, queries: DataFrame, condition: Column | None, facets: Facets | None) -> DataFrame:
    """Hits whose row meets the condition, and the query's own filters where ``facets`` are given; with the row's tag_status."""
    keep = rows if condition is None else rows.where(condition)
    keep = keep.withColumnRenamed("image_id", "id")
    if facets is None:
        return hits.join(keep.select("id", "tag_status"), "id")
    asked, told = compiled(queries, keep, facets)
    both = hits.join(told.select("id", "tag_status", "bits"), "id").join(asked.select("qid", "wanted"), "qid")
    return both.where(passes("wanted", "bits")).drop("wanted", "bits")


def text_search(queries: DataFrame, vectors: DataFrame, rows: DataFrame, condition: Column | None = None, *, facets: Facets | None = None, candidates: int = 100, threshold: float = 0.0, k: int = 20, filter_mode: str = "post") -> DataFrame:
    """The text-query pipeline: nearest, relative floor, filters, penalty, cut, rows.

    ``condition`` holds for all queries; with ``facets`` each query also has a map of ``filters`` of its own.
    ``filter_mode="post"`` filters the candidates, ``"pre"`` the searched vectors, so that every query finds its best among its own rows.
    """
    if filter_mode == "pre":
        hits, condition, facets = filtered_knn(queries, vectors, rows, candidates, condition, facets), None, None
    else:
        hits = knn(queries, vectors, candidates)
    hits = relative_floor(hits, threshold)
    return with_rows(penalised(_kept(hits, rows, queries, condition, facets)).where(F.col("rank") <= k).drop("tag_status"), rows)


def filtered_knn(queries: DataFrame, vectors: DataFrame, rows: DataFrame, k: int, condition: Column | None = None, facets: Facets | None = None) -> DataFrame:
    """``knn`` among the rows (image_id, …) that meet the condition and, with ``facets``, the query's own filters: one scan for all filters."""
    keep = rows if condition is None else rows.where(condition)
    if facets is None:
        return knn(queries, vectors.join(keep.select(F.col("image_id").alias("id")), "id", "left_semi"), k)
    asked, told = compiled(queries, keep, facets)
    return knn(asked, vectors.select("id", "vec").join(told.select(F.col("image_id").alias("id"), "bits"), "id"), k, filtered=True)


def collections(queries: DataFrame, vectors: DataFrame, rows: DataFrame, facets: Facets, k: int = 4) -> DataFrame:
    """qid, id, score, rank: the k best of each (qid, vec, filters) collection; collections without a row drop out."""
    return filtered_knn(queries, vectors, rows, k, facets=facets)


def image_search(queries: DataFrame, clip: DataFrame, text: DataFrame, rows: DataFrame, condition: Column | None = None, *, facets: Facets | None = None, candidates: int = 100, threshold: float = 0.0, k: int = 10, exclude_self: bool = False) -> DataFrame:
    """The image-query pipeline: both vector lists (the text list without the query itself), fusion, either floor, filters, penalty, cut, rows.

    ``condition`` holds for all queries; with ``facets`` each query also has a map of ``filters`` of its own.
    """
    a, b = knn(queries, clip, candidates), ranked(knn(queries, text, candidates).where("id <> qid").drop("rank"))
    if exclude_self:
        a = ranked(a.where("id <> qid").drop("rank"))
    hits = reciprocal_rank_fusion([a, b], keep=("clip", "text_"))
    hits = hits.where(either_floor(threshold, "clip", "text_")).select("qid", "id", "score", "rank")
    return with_rows(penalised(_kept(hits, rows, queries, condition, facets)).where(F.col("rank") <= k).drop("tag_status"), rows)


def chunk_search(queries: DataFrame, chunks: DataFrame, sources: DataFrame, condition: Column, k: int = 8) -> DataFrame:
    """Chunks of visible, ready sources by inner product; chunks (id, source_id, vec)."""
    seen = chunks.join(sources.where(condition).select("source_id"), "source_id", "left_semi")
    return knn(queries, seen.select("id", "vec"), k)


def _iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of boxes along the last axis (x1, y1, x2, y2); nan boxes overlap nothing."""
    size = lambda x: np.maximum(x[..., 2:] - x[..., :2], 0).prod(-1)
    both = np.maximum(np.minimum(a[..., 2:], b[..., 2:]) - np.maximum(a[..., :2], b[..., :2]), 0).prod(-1)
    return both / np.maximum(size(a) + size(b) - both, 1e-9)


class Suppression:
    """The greedy choice over many images at once, on boxes that come sorted by image and falling score.

    Of each image a window of boxes is settled at a time. A box is out once a chosen one overlaps it, and chosen once every
    better one that overlaps it is out; what is left is settled over and over until nothing is. Only the chosen boxes of the image
    that a batch ends in are held for the next batch.
    """

    WINDOW = 32

    def __init__(self, iou: float, most: int):
        self.iou, self.most = iou, most
        self.image, self.held = None, np.full((0, 4), np.nan)

    def add(self, images: pa.Array, box: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows that are chosen, their places from 1)."""
        code = images.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        start = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        size = np.diff(np.append(start, len(code)))
        chosen, count = np.full((len(start), self.most, 4), np.nan), np.zeros(len(start), np.int64)
        if self.image is not None and images[0].as_py() == self.image[0]:
            chosen[0, : len(self.held)], count[0] = self.held, len(self.held)
        rows, places = [], []
        for at in range(0, int(size.max()), self.WINDOW):
            live = np.flatnonzero((size > at) & (count < self.most))
            if not len(live):
                break
            offset = at + np.arange(min(self.WINDOW, int(size[live].max()) - at))
            here = offset[None, :] < size[live, None]
            row = np.where(here, start[live, None] + offset[None, :], 0)
            some = np.where(here[..., None], box[row], np.nan)
            left = here & ~(_iou(some[:, :, None], chosen[live][:, None]) >= self.iou).any(2)
            better = (_iou(some[:, :, None], some[:, None]) >= self.iou) & np.tri(len(offset), k=-1, dtype=bool)
            taken = np.zeros_like(left)
            while left.any():
                new = left & ~(better & left[:, None]).any(2)
                taken |= new
                left &= ~new & ~(better & new[:, None]).any(2)
            place = count[live, None] + np.cumsum(taken, 1)
            taken &= place <= self.most
            i, j = np.nonzero(taken)
            chosen[live[i], place[i, j] - 1] = some[i, j]
            count[live] += taken.sum(1)
            rows.append(row[i, j])
            places.append(place[i, j])
        self.image, self.held = (images[-1].as_py(),), chosen[-1, : count[-1]]
        return np.concatenate([*rows, np.zeros(0, np.int64)]), np.concatenate([*places, np.zeros(0, np.int64)])


def non_max_suppression(boxes: DataFrame, iou: float = 0.45, least: float = 0.20, most: int = 20) -> DataFrame:
    """image, region, score, place: per image greedily by score, without boxes that overlap a chosen one by ``iou`` or more.

    Boxes stream through tasks in the order of choice; a task holds a batch and the chosen boxes of one image, however many boxes an image has.
    """
    corners = ("x1", "y1", "x2", "y2")
    lined = boxes.where(F.col("score") >= least).select("image", "region", "score", *corners).repartition("image").sortWithinPartitions("image", F.desc("score"), "region", *corners)
    kinds = dict(boxes.dtypes)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Suppression(iou, most)
        for batch in batches:
            if len(batch):
                box = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in corners], 1)
                rows, places = state.add(batch.column("image"), box)
                yield pa.RecordBatch.from_arrays([*batch.select(["image", "region", "score"]).take(pa.array(rows)).columns, pa.array(places, pa.int32())], names=["image", "region", "score", "place"])

    return lined.mapInArrow(choose, f"image {kinds['image']}, region {kinds['region']}, score {kinds['score']}, place int")


def box_shape(x1: Column, y1: Column, x2: Column, y2: Column, width: float, height: float) -> list[Column]:
    """x, y, w, h as shares of the image, and the box's share of its area, rounded to four places."""
    w, h = x2 - x1, y2 - y1
    return [F.round(x1 / width, 4).alias("bbox_x"), F.round(y1 / height, 4).alias("bbox_y"), F.round(w / width, 4).alias("bbox_w"), F.round(h / height, 4).alias("bbox_h"), F.round(w * h / (width * height), 4).alias("area_ratio")]


