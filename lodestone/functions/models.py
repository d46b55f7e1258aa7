"""Contracts of caller-supplied models, and plain defaults.

An embedder is a function Column -> Column of array<double>, a scorer is a function (query, text) -> Column of double, an
extractor a function Column -> Column of JSON text. ``embedder``, ``scorer`` and ``extractor`` make them of a
``load`` function that gives the model: a function of a list (for a scorer, of two) that answers with a list. A worker
loads a model once, however many tasks it runs, and the model sees batches of a fixed size.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.vectors import l2_normalised

BATCH = 32
_LOADED: dict[str, Callable] = {}
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "
Embedder = Callable[[Column], Column]


def loaded(load: Callable[[], Callable]) -> Callable:
    """The model of ``load``, from the worker's own memory where it has been loaded before."""
    name = f"{load.__module__}.{load.__qualname__}"
    if name not in _LOADED:
        _LOADED[name] = load()
    return _LOADED[name]


def _batched(load: Callable[[], Callable], batch: int) -> Callable[..., pd.Series]:
    def answers(*columns: pd.Series) -> pd.Series:
        model, out = loaded(load), []
        for at in range(0, len(columns[0]), batch):
            some = [c.iloc[at : at + batch].tolist() for c in columns]
            told = list(model(*some))
            if len(told) != len(some[0]):
                raise ValueError(f"the model gave {len(told)} answers to {len(some[0])} rows")
            out += told
        return pd.Series(out, index=columns[0].index, dtype=object)

    return answers


def _of_one(load: Callable[[], Callable], kind: str, batch: int) -> Callable[[Column], Column]:
    answers = _batched(load, batch)

    def model(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield answers(part)

    model.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(model, kind)


def embedder(load: Callable[[], Callable], batch: int = BATCH) -> Embedder:
    """Text (or bytes) -> vector; ``load`` gives a function of a list of rows."""
    return _of_one(load, "array<double>", batch)


def extractor(load: Callable[[], Callable], batch: int = BATCH) -> Callable[[Column], Column]:
    """Record -> the model's JSON text."""
    return _of_one(load, "string", batch)


def scorer(load: Callable[[], Callable], batch: int = BATCH) -> Callable[[Column, Column], Column]:
    """(query, text) -> score."""
    answers = _batched(load, batch)

    def model(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for queries, texts in parts:
            yield answers(queries, texts).astype(float)

    model.__annotations__ = {"parts": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(model, "double")


_SPACE = re.compile("[ \t\n\x0b\f\r]+")


def bag_model(dim: int = 64) -> Callable[[list], list]:
    """Counts of hashed words of lower-case texts, of unit length: word w counts in place md5(w) mod dim."""
    places: dict[str, int] = {}

    def embed(texts: list) -> list:
        if len(places) > 200_000:
            places.clear()
        out = []
        for text in texts:
            at = []
            for word in filter(None, _SPACE.split(text or "")):
                if word not in places:
                    places[word] = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dim
                at.append(places[word])
            counts = np.bincount(np.array(at, np.int64), minlength=dim).astype(float)
            out.append((counts / (np.sqrt(counts @ counts) or 1.0)).tolist())
        return out

    return embed


def bag_of_words(text: Column) -> Column:
    """The default embedder: one pass over the words of each text."""
    return embedder(bag_model, 1024)(F.lower(F.coalesce(text, F.lit(""))))


def embed_queries(queries: DataFrame, embed: Embedder = bag_of_words, prefix: str = "") -> DataFrame:
    """qid, vec of (qid, query) rows; retrieval models want QUERY_PREFIX."""
    return queries.select("qid", embed(F.concat(F.lit(prefix), F.col("query"))).alias("vec"))


def embed_passages(passages: DataFrame, embed: Embedder = bag_of_words) -> DataFrame:
    """id, vec of (id, text) rows; no prefix."""
    return passages.select("id", embed(F.col("text")).alias("vec"))


def embed_items(items: DataFrame, embed: Embedder) -> DataFrame:
    """id, vec of (id, item) rows, of unit length; an item is text or bytes, and one that the model cannot embed has a null vector."""
    return items.select("id", embed(F.col("item")).alias("raw")).select("id", F.when(F.size("raw") > 0, l2_normalised(F.col("raw"))).alias("vec"))


def extracted(rows: DataFrame, extract: Callable[[Column], Column], text: str = "text") -> DataFrame:
    """Adds ``raw``, the model's JSON text, from where functions.model_json goes on."""
    return rows.withColumn("raw", extract(F.col(text)))
