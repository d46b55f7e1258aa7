"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics of every whole text (lengths, character classes, repetition, line shapes) are
standardised by their means and deviations over all documents. Random Fourier features
``cos(Wx + b)`` of a fixed seed approximate a Gaussian kernel. The normal equations are summed
within partitions and then over them, and solved once; rows of fold 4 give the isotonic map from
ridge values to scores, folds 1 to 3 the fit, fold 0 stays out.

Bound: at most ``max_rows`` labelled rows, by hash order, take part in the fit.

Defined results: null text is empty, and empty texts have all statistics 0; a doc_id with several
labels counts once with the largest; repeated rows are scored each; without labels every score is
0.5; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.calibration import isotonic
from lodestone.llm.common import fold, materialise

_CLASSES = np.zeros((256, 12))  # byte -> upper, lower, digit, space, newline, other ASCII, not ASCII, and five marks
for _b in range(256):
    _c = chr(_b)
    _CLASSES[_b, 6 if _b > 127 else 0 if _c.isupper() else 1 if _c.islower() else 2 if _c.isdigit() else 4 if _c == "\n" else 3 if _c.isspace() else 5] = 1
    for _k, _marks in enumerate(("|", "!?", "*#$%&@~^", ".,;:", "<>{}[]()/\\=_")):
        _CLASSES[_b, 7 + _k] = _c in _marks
N_STATISTICS = 12 + 11
_RUN = re.compile(r"([!-/:-@\[-`{-~])\1+")  # a mark that repeats itself, whatever it is


def statistics(text: str) -> list[float]:
    raw = text.encode()
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    if not words:
        return [0.0] * N_STATISTICS
    shares = (np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASSES / len(raw)).tolist()
    n, kinds = len(words), set(words)
    sizes = np.fromiter(map(len, words), np.float64, n)
    lower = text.lower()
    return [
        *shares, np.log1p(len(text)), np.log1p(n), min(sizes.mean(), 40.0), min(sizes.std(), 40.0), len(kinds) / n ** 0.8, sum(map(eq, words, words[1:])) / n,
        1 - len(set(lines)) / len(lines), min(n / len(lines), 200.0) / 100, (sizes == 1).mean(), min(len(_RUN.findall(text)) / n, 2.0),
        float(lower != text) * (1 - sum(map(eq, lower, text)) / len(text) if len(lower) == len(text) else 0.0),
    ]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, x: the statistics of each document row's whole text."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(measure, "doc_id long, x array<double>")


class Fourier:
    """cos(Wx + b) of standardised statistics, with a last feature 1."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, n_features: int, width: float, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.w = rng.standard_normal((len(mean), n_features)) / width
        self.b = rng.uniform(0, 2 * np.pi, n_features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -8, 8)
        return np.hstack([np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))])


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, N_STATISTICS))


def ridge(train: DataFrame, features: Fourier, penalty: float, parts: int = 12) -> np.ndarray | None:
    """Weights from (x, y) rows: each of ``parts`` partitions sums its normal equations, the driver adds ``parts`` sums."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = v = None
        for batch in batches:
            f, y = features(_rows(batch.column(0))), batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
            if len(y):
                a, v = (f.T @ f, f.T @ y) if a is None else (a + f.T @ f, v + f.T @ y)
        if a is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.append(a[np.triu_indices(len(v))], v)], pa.list_(pa.float64()))], names=["s"])

    found = train.select("x", "y").repartition(parts).mapInArrow(sums, "s array<double>").collect()
    if not found:
        return None
    total = np.sum([np.array(r["s"]) for r in found], axis=0)
    n = len(features.b) + 1
    a = np.zeros((n, n))
    a[np.triu_indices(n)] = total[:-n]
    a = a + np.triu(a, 1).T
    return np.linalg.solve(a + penalty * np.eye(n), total[-n:])


def _applied(rows: DataFrame, features: Fourier, weights: np.ndarray, knots: tuple[np.ndarray, np.ndarray] | None, keep: str, schema: str) -> DataFrame:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = features(_rows(batch.column(1))) @ weights
            if knots:
                value = np.interp(value, *knots)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value, pa.float64())], names=[keep, "score"])

    return rows.select(keep, "x").mapInArrow(apply, schema)


def score(docs: DataFrame, labels: DataFrame, *, max_rows: int = 100_000, n_features: int = 256, width: float = 4.0, penalty: float = 1.0) -> DataFrame:
    """doc_id, score: a row per document row."""
    x = materialise(measured(docs), "quality-statistics")
    y = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    y = y.where(fold() != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    told = materialise(x.join(y, "doc_id").select("doc_id", "x", "y", fold().alias("fold")), "quality-train")
    moments = x.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("i").collect()
    const = x.select("doc_id", F.lit(0.5).alias("score"))
    if not moments:
        return const
    features = Fourier(np.array([r["m"] for r in moments]), np.array([r["s"] for r in moments]), n_features, width)
    weights = ridge(told.where("fold < 4"), features, penalty)
    if weights is None:
        return const
    value = _applied(told.where("fold = 4").withColumn("y", F.col("y").cast("long")), features, weights, None, "y", "y long, score double")
    bins = value.groupBy(F.round(F.least(F.greatest(F.col("score"), F.lit(-0.5)), F.lit(1.5)), 3).alias("b")).agg(F.count("*").cast("double").alias("w"), F.avg("y").alias("m")).collect()  # 2001 rows at most
    bins.sort(key=lambda r: r["b"])
    knots = isotonic(*(np.array([r[c] for r in bins], np.float64) for c in ("b", "w", "m")))
    return _applied(x, features, weights, knots, "doc_id", "doc_id long, score double")


def query(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    out = score(docs, labels, **options)
    return out.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
