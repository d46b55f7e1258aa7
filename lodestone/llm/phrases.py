"""Phrase collocation mining: direct-address tiles of pairs, re-ranked level by level.

The words of a language that occur ``least`` times or more are ranked by frequency, and a text becomes a
sequence of ranks, with 0 for every other word and every end of a piece. Pairs of neighbours fall into tiles of
``TILE`` x ``TILE`` ranks. Tiles that a task finds well filled (those of the most frequent ranks) are counted in
dense arrays by ``bincount``; pairs of sparse tiles are sorted and summed as coordinates. Pairs that occur
``least`` times or more are ranked by frequency in turn and take the places of ranks: neighbours of that sequence are
phrases of three words that share two, and so on to ``longest`` words. A phrase that is frequent has only
frequent parts, so nothing is lost. A rank stands for one phrase of one language.

Every phrase carries the counts of all its beginnings and ends, taken from its two parts, so that each cut is
scored without another search. Scores are quotients of whole numbers (decimals of 38 digits).

The table of ranks is sent to all tasks while it has at most ``most_ranks`` rows; beyond that sequences are
ranked by a shuffle join of their different words (or pairs), which gives the same ranks.

Defined results: null text has no words; null lang is ``und``; repeated rows count each; ties in rank go to the phrase
in byte order; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.common import materialise, release_unused

TILE = 1024
DENSE = 16  # dense tiles a task keeps at once: 4 MB each
PIECE = 1 << 18  # ranks a task works on at once
FILLED = PIECE // 16  # pairs of a tile in one piece from which it is counted densely
HELD = 1 << 20  # coordinates a task sums up before it gives them on
WORDS = 300_000  # different words a task sums up before it gives them on
COUNTED = 1 << 31  # pairs after which a task gives its tiles on, as their cells are of 32 bits
_PLAIN = bytes.maketrans(bytes([*range(65, 91), *b".,;:!?\v\f\r\t"]), bytes([*range(97, 123), *b"\n" * 9, 32]))  # ends of pieces become line ends
_TOKEN = re.compile(rb"[^ \n]+|\n")


def tokens_of(text: str | None) -> list[bytes]:
    """Words in order, with b"\\n" at each end of a piece."""
    return _TOKEN.findall((text or "").encode("utf-8", "replace").translate(_PLAIN))


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, f of all words of (lang, text) rows; the row of word null has the language's number of words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            while found:
                lang, c = found.popitem()
                c.pop(b"\n", None)
                words, n = iter([*c, None]), iter([*c.values(), c.total()])
                c.clear()
                while some := list(islice(words, 50_000)):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.binary()).cast(pa.string()), pa.array(islice(n, 50_000), pa.int64())], names=["lang", "word", "f"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found.setdefault(lang, Counter()).update(tokens_of(text.as_py()))
                if sum(map(len, found.values())) > WORDS:
                    yield from rows()
        yield from rows()
        release_unused()

    return docs.mapInArrow(count, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def ranked(rows: DataFrame, *order) -> DataFrame:
    """``rows`` with ``id`` from 1 in the given order, counted in range parts."""
    placed = materialise(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "phrase-ranks")
    part = F.shiftrightunsigned("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # a row for each part of the sort
    return placed.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("id", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_at", "_part", "_n", "_before")


def _pieces(batch: pa.RecordBatch, most: int = PIECE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, flat ranks, sizes) of a batch of (row, seq), cut where ``most`` ranks are full."""
    ends = batch.column(1).offsets.to_numpy().astype(np.int64)
    at = 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
        lists = batch.column(1).slice(at, to - at)
        yield batch.slice(at, to - at), lists.flatten().to_numpy(), np.diff(ends[at : to + 1])
        at = to


def _sides(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each rank but the last: whether it and its neighbour in the same row are both frequent."""
    if len(flat) < 2:
        return np.zeros(0, bool)
    side = (flat[:-1] > 0) & (flat[1:] > 0)
    ends = np.cumsum(sizes)
    side[ends[(ends > 0) & (ends < len(flat))] - 1] = False
    return side


def _sequences(batch: pa.RecordBatch, flat: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    """Rows (row, seq), only those in which two ranks stand side by side."""
    ends, sides = np.cumsum(sizes), np.append(0, np.cumsum(_sides(flat, sizes)))
    if not len(flat):
        return pa.RecordBatch.from_arrays([batch.column(0).slice(0, 0), pa.array([], pa.list_(pa.int64()))], names=["row", "seq"])
    upto = lambda at: sides[np.minimum(np.maximum(at, 0), len(sides) - 1)]
    held = pa.array(upto(ends - 1) > upto(ends - sizes))
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(flat, pa.int64()))
    return pa.RecordBatch.from_arrays([batch.column(0), lists], names=["row", "seq"]).filter(held)


def first_sequences(docs: DataFrame, words: DataFrame, most_ranks: int) -> DataFrame:
    """row, seq: each text as ranks of its words; (row, lang, text) rows and (lang, word, id) ranks."""
    if words.limit(most_ranks + 1).count() <= most_ranks:
        table = words.select("lang", "word", "id").toArrow()  # most_ranks rows at most
        ids: dict[str, dict[bytes, int]] = {}
        for lang, word, i in zip(*(table.column(c).to_pylist() for c in ("lang", "word", "id")), strict=True):
            ids.setdefault(lang, {})[word.encode()] = i
        told = docs.sparkSession.sparkContext.broadcast(ids)

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                langs, texts, at = batch.column(1).to_pylist(), batch.column(2), 0
                while at < len(batch):
                    seqs, held, start = [], 0, at
                    while at < len(batch) and held < PIECE:
                        found = told.value.get(langs[at], {})
                        seqs.append(np.array([found.get(t, 0) for t in tokens_of(texts[at].as_py())], np.int64))
                        held += len(seqs[-1])
                        at += 1
                    yield _sequences(batch.slice(start, at - start), np.concatenate(seqs), np.array([len(s) for s in seqs]))
            release_unused()

        return docs.mapInArrow(encode, "row long, seq array<long>")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                found = [t.decode() for t in tokens_of(text.as_py())]
                for at in range(0, len(found), 100_000):
                    some = found[at : at + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array([row] * len(some), pa.int64()), pa.array([lang] * len(some), pa.string()), pa.array(range(at, at + len(some)), pa.int64()), pa.array(some, pa.string())], names=["row", "lang", "at", "word"])

    placed = docs.mapInArrow(split, "row long, lang string, at long, word string").join(words.select("lang", "word", "id"), ["lang", "word"], "left")
    return _gathered(placed.select("row", "at", F.coalesce("id", F.lit(0)).alias("id")))


def _gathered(placed: DataFrame) -> DataFrame:
    """row, seq of (row, at, id)."""
    return placed.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda x: x["id"]).alias("seq"))


def next_sequences(seqs: DataFrame, pairs: DataFrame, most_ranks: int) -> DataFrame:
    """row, seq: every rank and its neighbour replaced by the rank of the pair, 0 where the pair is not frequent; (a, b, id) pairs."""
    if pairs.limit(most_ranks + 1).count() <= most_ranks:
        table = pairs.select("a", "b", "id").toArrow()  # most_ranks rows at most
        a, b, ids = (table.column(c).to_numpy() for c in ("a", "b", "id"))
        span = int(b.max(initial=0)) + 1
        order = np.argsort(a * span + b)
        told = seqs.sparkSession.sparkContext.broadcast((span, (a * span + b)[order], ids[order]))

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            span, codes, ids = told.value
            for batch in batches:
                for piece, flat, sizes in _pieces(batch):
                    side = np.append(_sides(flat, sizes), False)
                    after = np.append(flat[1:], 0)
                    code = np.where(side & (after < span), flat * span + after, -1)
                    at = np.minimum(np.searchsorted(codes, code), max(len(codes) - 1, 0))
                    yield _sequences(piece, np.where(codes[at] == code, ids[at], 0) if len(codes) else np.zeros(len(flat), np.int64), sizes)
            release_unused()

        return seqs.mapInArrow(encode, "row long, seq array<long>")
    placed = seqs.select("row", F.posexplode("seq").alias("at", "a"), "seq").select("row", "at", "a", F.coalesce(F.try_element_at("seq", (F.col("at") + 2).cast("int")), F.lit(0)).alias("b"))
    return _gathered(placed.join(pairs.select("a", "b", "id"), ["a", "b"], "left").select("row", "at", F.coalesce("id", F.lit(0)).alias("id")))


class Tiles:
    """Counts of pairs of ranks: well filled tiles densely, all others as sorted coordinates."""

    def __init__(self):
        self.dense: dict[int, np.ndarray] = {}
        self.codes, self.counts, self.counted = np.zeros(0, np.int64), np.zeros(0, np.int64), 0  # a << 32 | b

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        tile = (a // TILE) << 32 | (b // TILE)
        held, which, sizes = np.unique(tile, return_inverse=True, return_counts=True)
        self.counted += len(a)
        sparse = np.ones(len(held), bool)
        for i in np.flatnonzero((sizes >= FILLED) | np.isin(held, list(self.dense))):
            if (t := int(held[i])) not in self.dense and len(self.dense) < DENSE:
                self.dense[t] = np.zeros(TILE * TILE, np.uint32)
            if t in self.dense:
                some = np.flatnonzero(which == i)
                cells = (a[some] % TILE) * TILE + b[some] % TILE
                if sizes[i] >= FILLED:
                    np.add(self.dense[t], np.bincount(cells, minlength=TILE * TILE), out=self.dense[t], casting="unsafe")
                else:
                    np.add.at(self.dense[t], cells, np.uint32(1))
                sparse[i] = False
        some = sparse[which]
        if some.any():
            self._merge(a[some] << 32 | b[some])

    def _merge(self, codes: np.ndarray) -> None:
        codes, counts = np.unique(codes, return_counts=True)
        codes, counts = np.append(self.codes, codes), np.append(self.counts, counts)
        order = np.argsort(codes, kind="stable")  # of two runs in order
        codes = codes[order]
        first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
        self.codes, self.counts = codes[first], np.add.reduceat(counts[order], first)

    def taken(self, all_: bool) -> Iterator[pa.RecordBatch]:
        """The coordinates, where there are many of them or ``all_`` are asked for, and then the dense tiles' cells too."""
        all_ = all_ or self.counted >= COUNTED
        if all_ or len(self.codes) > HELD:
            codes, counts, self.codes, self.counts = self.codes, self.counts, np.zeros(0, np.int64), np.zeros(0, np.int64)
            for at in range(0, len(codes), PIECE):
                some = slice(at, at + PIECE)
                yield self._rows(codes[some] >> 32, codes[some] & 0xFFFFFFFF, counts[some])
        if all_:
            self.counted = 0
            while self.dense:
                t, cells = self.dense.popitem()
                i, j, at = t >> 32, t & 0xFFFFFFFF, np.flatnonzero(cells)
                yield self._rows(i * TILE + at // TILE, j * TILE + at % TILE, cells[at])

    @staticmethod
    def _rows(a: np.ndarray, b: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(f, pa.int64())], names=["a", "b", "f"])


def pair_counts(seqs: DataFrame, least: int) -> DataFrame:
    """a, b, f of neighbouring ranks with f >= least."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = Tiles()
        for batch in batches:
            for _, flat, sizes in _pieces(batch):
                side = np.flatnonzero(_sides(flat, sizes))
                tiles.add(flat[side], flat[side + 1])
                yield from tiles.taken(False)
        yield from tiles.taken(True)
        release_unused()

    return seqs.mapInArrow(count, "a long, b long, f long").groupBy("a", "b").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def collocations(docs: DataFrame, *, least: int = 100, longest: int = 5, first: int = 2000, percent: int = 100, most_ranks: int = 1_000_000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``first`` phrases of 2 to ``longest`` words by their weakest cut."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    counts = materialise(word_counts(texts).where((F.col("f") >= least) | F.col("word").isNull()), "phrase-words")
    totals = counts.where("word is null").select("lang", F.col("f").alias("n"))  # a row a language
    words = materialise(ranked(counts.where("word is not null"), F.desc("f"), "lang", "word"), "phrase-level")
    seqs = materialise(first_sequences(texts.select(F.monotonically_increasing_id().alias("row"), "lang", "text"), words, most_ranks), "phrase-sequences")
    level = words.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), F.array("f").alias("begin"), F.array("f").alias("end"))
    found = []
    for size in range(2, longest + 1):
        pairs = pair_counts(seqs, least)
        pairs = materialise(ranked(pairs, F.desc("f"), "a", "b"), "phrase-level")
        one = level.select(F.col("id").alias("a"), "lang", "phrase", "begin")
        two = level.select(F.col("id").alias("b"), "last", "end")
        joined = pairs.join(one, "a").join(two, "b")
        # beginnings by rising length, ends likewise: begin[m] and end[m] count the first and the last m words
        level = joined.select("id", "a", "b", "f", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", F.concat("begin", F.array("f")).alias("begin"), F.concat("end", F.array("f")).alias("end"))
        level = materialise(level, "phrase-level")
        if found:  # a phrase goes where a longer one by one word is about as frequent; a longer one still has such a part
            holds = level.select(F.col("a").alias("id"), "f").unionByName(level.select(F.col("b").alias("id"), "f")).groupBy("id").agg(F.max("f").alias("longer"))
            found[-1] = found[-1].join(holds, "id", "left").where(F.coalesce(100 * F.col("longer") < percent * F.col("f"), F.lit(True))).drop("longer")
        found.append(level)
        if size < longest:
            seqs = materialise(next_sequences(seqs, pairs, most_ranks), "phrase-sequences")
    rows = found[0].select("lang", "phrase", "f", "begin", "end")
    for more in found[1:]:
        rows = rows.unionByName(more.select("lang", "phrase", "f", "begin", "end"))
    return best(rows.join(F.broadcast(totals), "lang"), first)


def best(rows: DataFrame, first: int) -> DataFrame:
    """The ``first`` of each language by the lowest score over all cuts."""
    whole = lambda x: x.cast("decimal(19,0)")

    def cut(k):
        left, right = F.element_at("begin", k), F.element_at("end", F.size("begin") - k)
        return F.struct(F.call_function("div", whole(1000 * F.col("f")) * whole(F.col("n")), whole(left) * whole(right)).alias("score"), k.alias("k"), left.alias("l"), right.alias("r"))

    cuts = F.array_min(F.transform(F.sequence(F.lit(1), F.size("begin") - 1), cut))
    scored = rows.withColumn("cut", cuts).select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score")
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return scored.withColumn("rank", place.cast("long")).where(F.col("rank") <= first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = """WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
 translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM docs),
words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
n AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM words GROUP BY lang),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS s FROM words),
grams AS (SELECT lang, w, s, unnest(range(1, least(5, len(w) - s + 1) + 1)) AS m FROM starts),
f AS (SELECT lang, m, w[s : s + m - 1] AS g, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
cuts AS (SELECT c.lang, c.g, c.m, c.f AS a, k.k, l.f AS l, r.f AS r, (1000 * CAST(c.f AS HUGEINT) * n.n) // (CAST(l.f AS HUGEINT) * r.f) AS score, n.n
 FROM f c JOIN (SELECT unnest(range(1, 5)) AS k) k ON k.k < c.m JOIN n USING (lang)
 JOIN f l ON l.lang = c.lang AND l.g = c.g[1 : k.k] JOIN f r ON r.lang = c.lang AND r.g = c.g[k.k + 1 : c.m]),
low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
gone AS (SELECT DISTINCT i.lang, i.g FROM f i JOIN (SELECT lang, f, m, g[1 : m - 1] AS part FROM f WHERE m > 2 UNION ALL SELECT lang, f, m, g[2 : m] FROM f WHERE m > 2) o ON o.lang = i.lang AND o.part = i.g AND 100 * o.f >= 100 * i.f)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
 FROM (SELECT *, array_to_string(g, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM low ANTI JOIN gone USING (lang, g)) WHERE rank <= 2000"""
