"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Every word of every example is a term. Its weight in a text is (1 + log tf) * idf * phi: idf comes from
document frequencies over all documents, phi is the correlation of the word with the label over the
examples (the square root of chi-squared over their number), so that words that tell nothing of
toxicity weigh little, without any being left out. The examples form an inverted index whose postings
are cut into blocks of examples that share their heaviest words, with the largest weight of each term
in each block. A document is scored against blocks in the order of their upper bounds, in waves of
doubling length, until no bound reaches its k-th best cosine. Its neighbours vote with their cosines as
weights; isotonic calibration on the examples (each voted on by the others) turns votes into scores.
Documents that share no word with an example have no neighbours and get the rate of such examples.

Bounds: at most ``max_examples`` labelled rows are examples, by hash order, and at most the first of
them whose distinct words add up to ``max_postings``. The index that tasks receive is bounded by them
(16 bytes a posting and 5 bytes a word and block).

Defined results: null and empty texts have no words; a doc_id with several labels counts once with
the largest, one with several texts is an example with the smallest of them; repeated rows are scored
each; without examples of both labels every score is 0.5; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.calibration import isotonic
from lodestone.llm.common import fold, left_by, materialise, release_unused

WORD = re.compile(r"[^\W\d_]+")
BLOCK = 512
FIRST = 4  # blocks of a document's first wave
_ENDS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))  # of the one-byte characters, letters alone stay


def words_of(text: str | None) -> list[str]:
    """``WORD.findall`` of the text in lower case; only words with other characters than ASCII's meet the pattern."""
    low = (text or "").lower()
    words = low.encode().translate(_ENDS).decode().split()
    return words if low.isascii() else [w for word in words for w in ((word,) if word.isalpha() else WORD.findall(word))]


def examples_of(labels: DataFrame, max_examples: int) -> DataFrame:
    """doc_id, y of the examples: folds 1 to 4, one row per doc_id, bounded by hash order."""
    y = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    return y.where(fold() != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)


def counted_examples(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """doc_id, y, place (hash order), words, tf, n of each example found in ``docs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, tf = [], []
            for text in batch.column(3):
                found = words_of(text.as_py())
                held = sorted(set(found))
                at = {w: i for i, w in enumerate(held)}
                words.append(held)
                tf.append(np.bincount([at[w] for w in found], minlength=len(held)))
            sizes = pa.array([len(w) for w in words], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(words, pa.list_(pa.string())), pa.array(tf, pa.list_(pa.int32())), sizes], names=["doc_id", "y", "place", "words", "tf", "n"])

    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    return texts.select("doc_id", "y", F.xxhash64("doc_id").alias("place"), "text").mapInArrow(count, "doc_id long, y int, place long, words array<string>, tf array<int>, n long")


def collected(examples: DataFrame, max_postings: int) -> pa.Table:
    """The examples, as many of them in hash order as hold ``max_postings`` distinct words at most, by doc_id."""
    sizes = examples.select("place", "doc_id", "n").toArrow().sort_by([("place", "ascending"), ("doc_id", "ascending")])  # max_examples rows of three numbers at most
    fit = int(np.searchsorted(np.cumsum(sizes.column("n").to_numpy()), max_postings, side="right"))
    if fit < len(sizes):
        last = sizes.slice(fit, 1).to_pylist()[0]
        examples = examples.where((F.col("place") < last["place"]) | ((F.col("place") == last["place"]) & (F.col("doc_id") < last["doc_id"])))
    return examples.select("doc_id", "y", "words", "tf").toArrow().sort_by("doc_id")


def document_frequencies(docs: DataFrame, known) -> tuple[int, np.ndarray]:
    """The number of document rows, and for each known word the number of rows that hold it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left_by("toxicity")
        ids = known.value
        total, seen, terms = 0, Counter(), ids.keys()
        for batch in batches:
            total += len(batch)
            for text in batch.column(0):
                seen.update(terms & set(words_of(text.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array([*map(ids.get, seen), -1], pa.int64()), pa.array([*seen.values(), total], pa.int64())], names=["term", "n"])
        release_unused()

    sums = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row per known word at most
    term, n = sums.column("term").to_numpy(), sums.column("n").to_numpy()
    df = np.zeros(len(known.value), np.int64)
    df[term[term >= 0]] = n[term >= 0]
    return int(n[term < 0].sum()), df


class Index:
    """An inverted index of examples, its postings in blocks of examples, with each term's largest weight in each block.

    Examples are given by rising id, each as (terms, tf); ``gain`` is the weight of each term.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, terms: np.ndarray, tf: np.ndarray, sizes: np.ndarray, gain: np.ndarray):
        n = len(ids)
        self.gain, self.n_terms, self.n_blocks = gain, len(gain), -(-n // BLOCK)
        row = np.repeat(np.arange(n), sizes)
        weight = (1 + np.log(tf)) * gain[terms]
        length = np.sqrt(np.bincount(row, weight * weight, n))
        weight = weight / np.where(length > 0, length, 1.0)[row]
        heavy = np.lexsort((terms, -weight, row))  # examples with the same heaviest words stand together
        first = np.cumsum(sizes) - sizes
        best = [np.where(sizes > i, terms[heavy][np.minimum(first + i, max(len(terms) - 1, 0))], -1) if len(terms) else np.full(n, -1) for i in (0, 1)]
        self.member = np.lexsort((np.arange(n), best[1], best[0]))  # example at each place
        place = np.empty(n, np.int64)
        place[self.member] = np.arange(n)
        self.ids, self.y = ids[self.member], labels[self.member].astype(np.float64)
        row = place[row]
        cell = terms * self.n_blocks + row // BLOCK
        order = np.lexsort((row, cell))
        self.row, self.weight, cell = row[order], weight[order], cell[order]
        self.first = np.searchsorted(cell, np.arange(self.n_terms * self.n_blocks + 1)).astype(np.int32)
        top = np.zeros(self.n_terms * self.n_blocks)
        held, at = np.unique(cell, return_index=True)
        if len(held):
            top[held] = np.maximum.reduceat(self.weight, at)
        top = top.reshape(self.n_terms, self.n_blocks)
        self.peak = top.max(1, initial=0.0) + 1e-12
        self.top = np.ceil(top / self.peak[:, None] * 255 - 1e-9).astype(np.uint8)  # in 255ths of the term's peak, rounded up

    def nearest(self, terms: np.ndarray, tf: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples, exact; ties to the smaller id. Only examples that share a term are near."""
        places, values, kth = np.zeros(0, np.int64), np.zeros(0), 0.0
        query = (1 + np.log(tf)) * self.gain[terms]
        query = query / (np.sqrt(query @ query) or 1.0)
        bound = (query * self.peak[terms] / 255).astype(np.float32) @ self.top[terms].astype(np.float32) + 1e-5
        order, at, step = np.argsort(-bound, kind="stable"), 0, FIRST
        while at < len(order) and bound[order[at]] >= kth:
            wave = order[at : at + step]
            wave = np.sort(wave[bound[wave] >= kth])
            cell = ((terms * self.n_blocks)[:, None] + wave).ravel()
            start = self.first.take(cell)
            size = self.first.take(cell + 1) - start
            full = np.flatnonzero(size)
            start, size = start.take(full), size.take(full)
            end = np.cumsum(size)
            posting = np.repeat(start - end + size, size)
            posting += np.arange(len(posting))
            value = self.weight.take(posting)
            value *= np.repeat(query.take(full // len(wave)), size)
            dots = np.bincount(self.row.take(posting), value, len(self.ids))
            least = max(kth, 1e-9, np.partition(dots, -k)[-k] if k < len(dots) else 0.0)  # others are not sorted
            found = np.flatnonzero(dots >= least - 2e-9)
            dot = np.round(dots[found], 9)
            near = dot >= max(kth, 1e-9)
            places, values = np.append(places, found[near]), np.append(values, dot[near])
            best = np.lexsort((self.ids[places], -values))[:k]
            places, values = places[best], values[best]
            kth = values[-1] if len(places) == k else 0.0
            at, step = at + step, step * 2
        return places, values


def index_of(docs: DataFrame, labels: DataFrame, max_examples: int, max_postings: int):
    """The broadcast dictionary of known words, the broadcast index, and the examples (doc_id, y); None without examples of both labels."""
    sc = docs.sparkSession.sparkContext
    chosen = materialise(examples_of(labels, max_examples), "toxic-chosen")
    told = collected(materialise(counted_examples(docs, chosen), "toxic-examples"), max_postings)
    y = told.column("y").to_numpy() > 0
    words = told.column("words").combine_chunks()
    if not y.any() or y.all() or not len(words.flatten()):
        return None
    coded = words.flatten().dictionary_encode()
    terms = coded.indices.to_numpy().astype(np.int64)
    sizes = np.diff(words.offsets.to_numpy())
    tf = told.column("tf").combine_chunks().flatten().to_numpy().astype(np.float64)
    known = sc.broadcast({w: i for i, w in enumerate(coded.dictionary.to_pylist())})
    n_docs, df = document_frequencies(docs, known)
    n1 = np.bincount(terms, np.repeat(y, sizes), len(df))
    n0, a1, a0 = np.bincount(terms, minlength=len(df)) - n1, float(y.sum()), float((~y).sum())
    n = n0 + n1
    phi = np.abs(n1 * (a0 - n0) - n0 * (a1 - n1)) / np.sqrt(n * np.maximum(a0 + a1 - n, 1) * a0 * a1)
    gain = np.log((1.0 + n_docs) / (1.0 + df)) * phi + 1e-9
    return known, sc.broadcast(Index(told.column("doc_id").to_numpy(), y, terms, tf, sizes, gain))


def votes(docs: DataFrame, known, index, k: int) -> DataFrame:
    """doc_id, vote (null without neighbours), near (the nearest examples' ids). An example does not vote on itself."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left_by("toxicity")
        ids, examples, seen = known.value, index.value, {}
        rate = float(examples.y.mean())
        for batch in batches:
            out, near = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = [i for i in map(ids.get, words_of(text.as_py())) if i is not None]
                if not found:
                    out.append(None), near.append([])
                    continue
                terms, tf = np.unique(np.array(found, np.int64), return_counts=True)
                key = hashlib.sha256(terms.tobytes() + tf.tobytes()).digest()  # copies are looked up once
                if key not in seen:
                    if len(seen) >= 5000:
                        seen.clear()
                    seen[key] = examples.nearest(terms, tf, k + 1)
                places, cosine = seen[key]
                own = examples.ids[places] != (-1 if doc is None else doc)
                places, cosine = places[own][:k], cosine[own][:k]
                out.append(float((cosine @ examples.y[places] + 0.5 * rate) / (cosine.sum() + 0.5)) if len(places) else None)
                near.append(examples.ids[places[:3]].tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64()), pa.array(near, pa.list_(pa.int64()))], names=["doc_id", "vote", "near"])
        release_unused()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(vote, "doc_id long, vote double, near array<long>")


def score(docs: DataFrame, labels: DataFrame, *, k: int = 15, max_examples: int = 4_000, max_postings: int = 4_000_000) -> DataFrame:
    """doc_id, score, near: a row per document row; ``near`` is the evidence, the ids of up to three nearest examples."""
    found = index_of(docs, labels, max_examples, max_postings)
    if found is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0.5).alias("score"), F.array().cast("array<bigint>").alias("near"))
    known, index = found
    voted = materialise(votes(docs, known, index, k), "toxic-votes")
    known.unpersist(), index.unpersist()  # the votes are written; executors need them no more
    release_unused()  # the driver's own part, as it lives on for later stages
    spark = docs.sparkSession
    marks = spark.createDataFrame(pa.table({"doc_id": index.value.ids, "y": index.value.y}))
    bins = voted.join(F.broadcast(marks), "doc_id").groupBy(F.round(F.col("vote"), 3).alias("x")).agg(F.count("*").cast("double").alias("w"), F.avg("y").alias("m")).collect()  # a row per thousandth of the vote at most
    held = sorted((b for b in bins if b["x"] is not None), key=lambda b: b["x"])
    x, y = isotonic(*(np.array([b[c] for b in held], np.float64) for c in ("x", "w", "m")))
    none = next((b for b in bins if b["x"] is None), None)
    alone = (none["w"] * none["m"] + 0.5) / (none["w"] + 1) if none else float(y[0])

    def calibrate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vote = batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
            value = np.where(np.isnan(vote), alone, np.interp(vote, x, y))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value, pa.float64()), batch.column(2)], names=["doc_id", "score", "near"])

    return voted.mapInArrow(calibrate, "doc_id long, score double, near array<long>")


def query(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    out = score(docs, labels, **options)
    return out.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "near")
