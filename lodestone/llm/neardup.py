"""Near-duplicate documents: b-bit MinHash signatures, multi-index Hamming join, exact confirmation.

A document's set is that of its distinct word shingles (64-bit hashes). Its signature has
``4 * chunks`` values of 16 bits. By the pigeonhole principle two signatures that differ in at
most ``2 * chunks - 1`` values agree in one chunk of four but for one value at most; all places of
that one error are enumerated, so that every chunk gives four keys of three values and all pairs
under the distance threshold share a key. (Sets of similarity 0.85 differ in more values, and
share no key besides, with a probability of 2e-7 at seven chunks.)

Equal sets are one class, whatever their rows' ids, and only classes are joined. In each group of a key, every class is
compared with the group's hub, the one with the most company, on full sets; the links give
components. What a hub cannot tell is then settled exactly: in groups whose other members are of
several components, members outside the largest component are compared with members of
other components, in blocks of bounded size. There a prefix filter picks whom to compare: with its shingles in the
order of rarity, two sets over the threshold share one among their first n - ceil(threshold * n) + 1, so that members that share a
frequent template only never meet. No group is expanded into pairs, and none is capped.

Defined results: null text and texts without words have an empty set and are linked with
nothing; shorter texts than a shingle are one shingle; rows with equal sets share a component
whatever their ids, and several texts under one doc_id each link by their own; a row without doc_id takes the component
of those it is linked with, and is kept if none of them has a doc_id; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.common import counted, fresh, left_by, materialise, release_unused

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_STEP, _A, _B = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
MOST_IDS = 1_000_000  # candidate ids up to this number are broadcast (16 MB); more go by a shuffle


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _A
    h = (h ^ (h >> np.uint64(27))) * _B
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw = [(t or "").encode() for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw])
    space = _SPACE[data]
    start = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    if not len(start):
        return [np.zeros(0, np.uint64) for _ in raw]
    stop = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
    size = stop - start
    inside = data[~space]
    place = np.arange(len(inside)) - np.repeat(np.cumsum(size) - size, size)
    powers = np.multiply.accumulate(np.full(int(size.max()), _STEP, np.uint64))
    h = _mixed(np.add.reduceat(_BYTE[_LOWER[inside]] * powers[place], np.cumsum(size) - size) + size.astype(np.uint64))
    first = np.searchsorted(start, np.concatenate([[0], ends[:-1]]))
    last = np.append(first[1:], len(start))
    full = np.zeros(len(h), np.uint64)
    n = len(h) - words + 1
    for k in range(words):
        if n > 0:
            full[:n] = _mixed(full[:n] + h[k : k + n] * np.uint64(2 * k + 1))
    out = []
    for a, b in zip(first, last, strict=True):
        if b - a >= words:
            out.append(np.unique(full[a : b - words + 1]))
        else:
            short = np.uint64(0)
            for k in range(a, b):
                short = _mixed(short + h[k : k + 1] * np.uint64(2 * (k - a) + 1) + np.uint64(b - a))[0]
            out.append(np.array([short] if b > a else [], np.uint64))
    return out


def _in_pieces(texts: pa.Array, most: int = 250_000) -> Iterator[list[str | None]]:
    """The texts of a batch in pieces of about ``most`` characters."""
    piece, held = [], 0
    for t in texts:
        piece.append(t.as_py())
        held += len(piece[-1] or "")
        if held >= most:
            yield piece
            piece, held = [], 0
    if piece:
        yield piece


def keys_of(sets: list[np.ndarray], chunks: int) -> np.ndarray:
    """len(sets) x 4 * chunks keys: chunk, place of the allowed error, and the chunk's three other values in one number."""
    rng = np.random.default_rng(7)
    xor, times = rng.integers(0, 1 << 63, 4 * chunks, dtype=np.uint64), rng.integers(0, 1 << 62, 4 * chunks, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    flat = np.concatenate(sets)
    at = np.cumsum([0] + [len(s) for s in sets[:-1]])
    values = np.stack([np.minimum.reduceat((flat ^ x) * a, at) for x, a in zip(xor, times, strict=True)], 1)
    values = ((values >> np.uint64(20)) & np.uint64(0xFFFF)).astype(np.int64)
    keys = []
    for c in range(chunks):
        for gone in range(4):
            rest = [values[:, 4 * c + k] for k in range(4) if k != gone]
            keys.append((((c * 4 + gone) << 48) | (rest[0] << 32) | (rest[1] << 16) | rest[2]))
    return np.stack(keys, 1)


def signed(docs: DataFrame, words: int, chunks: int) -> DataFrame:
    """doc_id, th (a hash of the text), n, s1, s2 (a digest of the set), keys of each document row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left_by("neardup")
        for batch in batches:
            at = 0
            for piece in _in_pieces(batch.column(2)):
                sets = shingle_sets(piece, words)
                some = [s for s in sets if len(s)]
                keys = iter(keys_of(some, chunks)) if some else iter(())
                s1, s2 = zip(*map(_digest, sets), strict=True)
                arrays = [*(batch.column(i).slice(at, len(piece)) for i in (0, 1)), pa.array([len(s) for s in sets], pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "th", "n", "s1", "s2", "keys"])
                at += len(piece)
        release_unused()

    return told(docs).mapInArrow(sign, "doc_id long, th long, n long, s1 long, s2 long, keys array<long>")


def _digest(values: np.ndarray) -> tuple[int, int]:
    if not len(values):
        return 0, 0
    return int(values.sum(dtype=np.uint64).view(np.int64)), int(_mixed(values ^ _STEP).sum(dtype=np.uint64).view(np.int64))


def told(docs: DataFrame) -> DataFrame:
    """doc_id, th, text: what tells a row apart from others, but for repeated rows."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")


def sets_for(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """cid, set (sorted 64-bit numbers as bytes) of the wanted (cid, rep, th, s1, s2) classes, each from a row that stands for it."""
    wanted, n = counted(wanted.select("cid", F.col("rep").alias("_rep"), F.col("th").alias("_th"), "s1", "s2"), "dup-wanted")
    if n <= MOST_IDS:
        wanted = F.broadcast(wanted)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left_by("neardup")
        for batch in batches:
            ids, s1, s2, at = *(batch.column(i).to_pylist() for i in (0, 2, 3)), 0
            for piece in _in_pieces(batch.column(1)):
                sets = shingle_sets(piece, words)
                right = [i for i, s in enumerate(sets) if len(s) and _digest(s) == (s1[at + i], s2[at + i])]
                yield pa.RecordBatch.from_arrays([pa.array([ids[at + i] for i in right], pa.int64()), pa.array([sets[i].tobytes() for i in right], pa.binary())], names=["cid", "set"])
                at += len(piece)
        release_unused()

    same = (F.col("th") == F.col("_th")) & F.col("doc_id").eqNullSafe(F.col("_rep"))
    return told(docs).join(wanted, same).select("cid", "text", "s1", "s2").mapInArrow(make, "cid long, set binary").dropDuplicates(["cid"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs with 100 * intersection >= percent * union, counted on full sets."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
        release_unused()

    one, two = (sets.select(F.col("cid").alias(c), F.col("set").alias(f"set_{c}")) for c in ("a", "b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "set_a", "set_b").mapInArrow(confirm, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, label (the smallest node reachable) of all nodes of the (a, b) links: smallest label of neighbours, then of labels."""
    both = materialise(links.select("a", "b").union(links.select("b", "a")).distinct(), "dup-links")
    label = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), "dup-labels")
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = label.join(near, "node").select("node", F.least("label", "near").alias("to"), F.col("label").alias("was"))
        jump = label.select(F.col("node").alias("to"), F.col("label").alias("next"))
        step, moved = counted(step.join(jump, "to").select("node", "was", F.least("to", "next").alias("label")), "dup-labels", F.col("label") != F.col("was"))
        if not moved:
            return step.select("node", "label")
        label = step.select("node", "label")


def block_links(cids: np.ndarray, is_x: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[list[tuple[int, int]], int]:
    """Links between members x and y of different components, one for each two components they join, and the number of pairs that were compared."""
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, value, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    end = np.cumsum(size)
    rare = np.lexsort((value, count[value], owner))  # each set's shingles, the rarest first
    place = np.arange(len(owner)) - np.repeat(end - size, size)
    prefix = place < (size - -(-percent * size // 100) + 1)[owner]
    word, of = value[rare][prefix], owner[prefix]
    to = np.flatnonzero(~is_x[of])
    to = to[np.argsort(word[to], kind="stable")]
    held = word[to]
    root, out, tried = labels.copy(), [], 0
    mark = np.zeros(len(count), bool)
    for x in np.flatnonzero(is_x):
        mine = word[of == x] if len(sets) < 64 else word[np.searchsorted(of, x) : np.searchsorted(of, x, side="right")]
        lo, hi = np.searchsorted(held, mine), np.searchsorted(held, mine, side="right")
        ys = np.unique(np.concatenate([of[to[a:b]] for a, b in zip(lo, hi, strict=True) if b > a] or [np.zeros(0, np.int64)]))
        ys = ys[(root[ys] != root[x]) & (100 * np.minimum(size[ys], size[x]) >= percent * np.maximum(size[ys], size[x]))]
        if not len(ys):
            continue
        own = value[end[x] - size[x] : end[x]]
        mark[own] = True
        for y in ys:
            if root[y] != root[x]:
                both = int(mark[value[end[y] - size[y] : end[y]]].sum())
                tried += 1
                if 100 * both >= percent * (size[x] + size[y] - both):
                    root[root == root[y]] = root[x]
                    out.append((int(cids[x]), int(cids[y])))
        mark[own] = False
    return out, tried


def _settle(percent: int):
    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        """One block of x against one of y."""
        pdf = pdf.sort_values(["role", "cid"])
        is_x = (pdf["role"] == "x").to_numpy()
        found = [] if is_x.all() or not is_x.any() else block_links(pdf["cid"].to_numpy(), is_x, pdf["label"].to_numpy(), [np.frombuffer(s, np.uint64) for s in pdf["set"]], percent)[0]
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return settle


def settled(members: DataFrame, label: DataFrame, sets: DataFrame, percent: int, block: int = 512) -> DataFrame:
    """Links that no hub told: members (key, cid) of groups with several components, blocks against blocks."""
    named = members.join(label.select(F.col("node").alias("cid"), "label"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    named = materialise(named, "dup-members")
    counts = named.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum(F.xxhash64("cid").cast("decimal(38,0)")).alias("h"))
    groups = counts.groupBy("key").agg(F.count("*").alias("labels"), F.sum("n").alias("size"), F.max("n").alias("most"), F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("h").alias("h"))
    groups = groups.where("labels > 1").groupBy("size", "h").agg(F.min_by("key", "key").alias("key"), F.min_by("main", "key").alias("main"), F.min_by("most", "key").alias("most"))  # groups of the same members count once
    n_x, n_y = F.ceil((F.col("size") - F.col("most")) / block), F.ceil(F.col("size") / (2 * block))
    left, n = counted(named.join(groups.select("key", "main", n_x.alias("n_x"), n_y.alias("n_y")), "key"), "dup-unsettled")
    if not n:
        return None
    some = lambda n: F.pmod(F.xxhash64("cid"), F.col(n))
    x = left.where("label <> main").select("key", "cid", "label", F.lit("x").alias("role"), some("n_x").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_y") - 1)).alias("j"))
    y = left.select("key", "cid", "label", F.lit("y").alias("role"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_x") - 1)).alias("i"), some("n_y").alias("j"))
    return x.unionByName(y).join(sets, "cid").groupBy("key", "i", "j").applyInPandas(_settle(percent), "a long, b long")


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80, chunks: int = 7) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, and th (a hash of the text), of each document row."""
    rows = materialise(signed(docs, words, chunks), "dup-signatures")
    named = grouped(docs, rows, words, percent)
    out = rows.select("doc_id", "th", "n", "s1", "s2").join(named.select("s1", "s2", "n", "component_id", F.lit(True).alias("_linked")), ["s1", "s2", "n"], "left")
    component = F.when(F.col("_linked"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"), "th")


def grouped(docs: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """s1, s2, n, label, component_id: every class of equal sets with the smallest class and the smallest doc_id of its component."""
    least = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("th"))
    classes = rows.where("n > 0").groupBy("s1", "s2", "n").agg(F.min(least).alias("row"), F.first("keys").alias("keys"))
    classes = materialise(classes.select(F.monotonically_increasing_id().alias("cid"), "s1", "s2", "n", F.col("row.doc_id").alias("rep"), F.col("row.th").alias("th"), "keys"), "dup-classes")
    keyed = classes.select("cid", "n", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = materialise(keyed.join(shared, "key"), "dup-members")
    company = members.groupBy("cid").agg(F.sum("size").alias("company"))
    hubs = members.join(company, "cid").groupBy("key").agg(F.max_by(F.struct("cid", "n"), F.struct("company", -F.col("cid"))).alias("hub"))
    with_hub = materialise(members.join(hubs, "key").select("key", "cid", "n", "size", F.col("hub.cid").alias("hub"), F.col("hub.n").alias("n_hub")), "dup-hubs")
    pairs = with_hub.where("cid <> hub").where(100 * F.least("n", "n_hub") >= percent * F.greatest("n", "n_hub"))
    pairs = pairs.select(F.least("cid", "hub").alias("a"), F.greatest("cid", "hub").alias("b")).distinct()
    sets = materialise(sets_for(docs, classes.join(members.select("cid").distinct(), "cid", "left_semi"), words), "dup-sets")
    links = materialise(confirmed(pairs, sets, percent), "dup-confirmed")
    label = components(links)
    more = settled(with_hub.where("size > 2 and cid <> hub").select("key", "cid"), label, sets, percent)
    if more is not None:
        more, n = counted(more, "dup-settled")
        if n:
            label = components(links.union(more))
    named = classes.join(label.withColumnRenamed("node", "cid"), "cid", "left").select("s1", "s2", "n", "rep", F.coalesce("label", "cid").alias("label"))
    smallest = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    return materialise(named.join(smallest, "label").select("s1", "s2", "n", "label", "component_id"), "dup-named")


def deduplicated(docs: DataFrame, *, words: int = 5, percent: int = 80, chunks: int = 7) -> DataFrame:
    """``docs`` with one row of each component, that with the smallest doc_id (rows without one last), and all rows without words.

    Rows are told apart by doc_id and text, so that several texts under one doc_id, and rows without one, go or stay each by itself; of repeated rows one stays.
    """
    rows = materialise(signed(docs, words, chunks), "dup-signatures")
    named = grouped(docs, rows, words, percent)
    least = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("th"))
    alike = rows.where("n > 0").groupBy("s1", "s2", "n", "doc_id", "th").agg(F.count("*").alias("times")).join(named.select("s1", "s2", "n", "label"), ["s1", "s2", "n"])
    first = alike.withColumn("me", least).groupBy("label").agg(F.min("me").alias("me"), F.min_by("times", "me").alias("times")).select(F.col("me.doc_id").alias("_doc"), F.col("me.th").alias("_th"), "times")
    first, more = counted(first, "dup-first", F.col("times") > 1)
    wordless = rows.where("n = 0").select(F.col("doc_id").alias("_doc"), F.col("th").alias("_th"), F.lit(1).cast("long").alias("times")).distinct()
    kept, n = counted(first.unionByName(wordless), "narrow")
    small = F.broadcast(kept) if n <= MOST_IDS else kept
    own, th, times = (fresh(c, docs.columns) for c in ("_own", "_hash", "_times"))
    told_ = docs.withColumn(own, F.col("doc_id").cast("long")).withColumn(th, F.xxhash64("text"))
    found = told_.join(small.withColumnRenamed("times", times), F.col(own).eqNullSafe(F.col("_doc")) & (F.col(th) == F.col("_th")))
    once = found.where(F.col(times) == 1).select(*docs.columns)
    repeated = found.where(F.col(times) > 1)
    if not more:
        return once
    place = fresh("_place", repeated.columns)
    one = repeated.withColumn(place, F.row_number().over(W.partitionBy(own, th).orderBy(F.to_json(F.struct(*docs.columns))))).where(F.col(place) == 1)
    return once.unionByName(one.select(*docs.columns))
