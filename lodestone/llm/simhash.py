"""Near-duplicates by SimHash: vantage-point trees over fingerprints, with exact pairs across overlapping shards.

A fingerprint's bit is 1 where more than half of the text's shingle hashes (XXH64, seed 42) have it.
Only distinct fingerprints meet. Two of them within ``radius`` bits differ by at most ``radius // 2``
bits in one half of their 64 bits, so there are two forests, one for each half, each searched with
that smaller radius. On every level of a tree a vantage point is compared with four bits of the half:
the Hamming distance to it, 0 to 4, is the branch. Distances on disjoint bits add up, and by the triangle
inequality a fingerprint at distance t from a vantage point has no partner at distance u where
|t - u| exceeds what is left of the radius; so a search goes down the branches within it and pays |t - u|
for each. The leaves are the shards. A fingerprint lives in one leaf a forest and asks the leaves that its
ball overlaps; of two leaves only that with the larger number asks, so that each pair of leaves meets once.
The number of levels grows with the number of fingerprints, so that leaves keep about ``leaf`` of them;
larger leaves (dense clusters) are cut into blocks, and blocks meet blocks. In a leaf whole blocks of
distances are computed at once, exactly, over all 64 bits; only links that join two of the block's components
are given, never all pairs of a cluster. The trees have at most eight levels (some 77,000 leaves in use): up to
about 10^9 different fingerprints the work is in proportion, beyond that leaves grow.

Defined results: null text, empty text and texts without words have fingerprint zero and are linked like any
other; shorter texts than a shingle are one shingle; repeated rows have a row each; a row without doc_id takes
the component of its copies, null if none has a doc_id; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import join_small, materialise
from lodestone.llm.neardup import components

SEED = 42
WIDTH, LEVELS = 4, 8  # bits that a vantage point sees, and levels of a forest: 4 * 8 = half of a fingerprint
USED = 4.1  # leaves in use grow by this factor a level, as distances of four bits are binomial
VANTAGE = (0x5, 0xC, 0x9, 0x3, 0xA, 0x6, 0xF, 0x1)  # a vantage point for each level


def fingerprint(text: str | None, words: int) -> int:
    """The 64-bit SimHash of one text, as a signed number."""
    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return 0
    n = max(1, len(found) - words + 1)
    votes = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # bounded pieces of a very long text
        few = found[at : min(at + (1 << 16), n) + words - 1]
        hashes = [xxhash.xxh64_intdigest(b" ".join(few[i : i + words]), SEED) for i in range(min(1 << 16, n - at))]
        votes += np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, fp of each document row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = pa.array([fingerprint(t.as_py(), words) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fp], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sign, "doc_id long, fp long")


def levels_for(n: int, leaf: int) -> int:
    """Levels of a tree over ``n`` fingerprints whose leaves hold about ``leaf`` of them."""
    return min(LEVELS, max(1, int(np.ceil(np.log(max(n, 1) / leaf) / np.log(USED)))) if n > leaf else 0)


def distances(fp: np.ndarray, half: int, levels: int) -> np.ndarray:
    """levels x len(fp): the distance to each level's vantage point on that level's four bits of the half."""
    shifts = [np.uint64(32 * half + WIDTH * level) for level in range(levels)]
    return np.array([np.bitwise_count(((fp >> s) & np.uint64(15)) ^ np.uint64(v)) for s, v in zip(shifts, VANTAGE, strict=False)], np.int64).reshape(levels, len(fp))


def visited(fp: np.ndarray, half: int, levels: int, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in fp, leaf, own) of every leaf that a fingerprint lives in or asks: all branches within the radius, level by level."""
    told = distances(fp, half, levels)
    place, leaf, home, left = np.arange(len(fp)), np.zeros(len(fp), np.int64), np.zeros(len(fp), np.int64), np.full(len(fp), radius)
    for level in range(levels):
        branch = np.arange(WIDTH + 1)
        cost = np.abs(branch[None, :] - told[level][place][:, None])
        i, u = np.nonzero(cost <= left[:, None])
        leaf, home = leaf[i] * (WIDTH + 1) + u, home[i] * (WIDTH + 1) + told[level][place[i]]
        place, left = place[i], left[i] - cost[i, u]
    asks = leaf <= home  # of two leaves the one with the larger number asks the other
    return place[asks], leaf[asks], (leaf == home)[asks]


def routed(classes: DataFrame, levels: int, radius: int) -> DataFrame:
    """half, leaf, fp, own: the fingerprints of each leaf, those that live there (own) and those that ask there."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(fp), 4096):
                for half in (0, 1):
                    some = fp[at : at + 4096]
                    place, leaf, own = visited(some, half, levels, radius // 2)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(leaf), half, np.int32)), pa.array(leaf), pa.array(some[place].view(np.int64)), pa.array(own)], names=["half", "leaf", "fp", "own"])

    return classes.select("fp").mapInArrow(route, "half int, leaf long, fp long, own boolean")


def forest_links(fp: np.ndarray, own: np.ndarray, first: bool, radius: int, step: int = 1024) -> list[tuple[int, int]]:
    """Links within ``radius`` between residents and askers (and among residents where ``first``), as many as join components."""
    home, guests = fp[own], fp[~own]
    others = np.concatenate([home, guests]) if first else guests
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while parent.get(v, v) != v:
            parent[v] = v = parent.get(parent[v], parent[v])
        return v

    out = []
    for at in range(0, len(home), step):
        near = np.bitwise_count(home[at : at + step, None] ^ others[None, :]) <= radius
        i, j = np.nonzero(near)
        for a, b in zip(home[at + i].view(np.int64).tolist(), others[j].view(np.int64).tolist(), strict=True):
            if a != b and (p := root(a)) != (q := root(b)):
                parent[max(p, q)] = min(p, q)
                out.append((a, b))
    return out


def leaf_links(rows: DataFrame, radius: int, block: int) -> DataFrame:
    """a, b: links found in the leaves; leaves of more than ``block`` rows are cut, and each block of residents meets each block of the rest."""
    sizes = rows.groupBy("half", "leaf").agg(F.count_if("own").alias("homes"), F.count_if(~F.col("own")).alias("guests")).where("homes > 0")
    part = lambda n: F.ceil(F.col(n) / block).cast("long")
    cut = join_small(rows, sizes.select("half", "leaf", part("homes").alias("n_i"), part("guests").alias("n_j")), ["half", "leaf"], "inner")
    some = lambda n: F.pmod(F.xxhash64("fp"), F.greatest(F.col(n), F.lit(1)))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    none = F.array().cast("array<bigint>")
    mine = cut.where("own").withColumn("i", some("n_i"))
    after = F.when(F.col("i") + 1 < F.col("n_i"), F.transform(F.sequence(F.col("i") + 1, F.col("n_i") - 1), lambda k: -2 - k)).otherwise(none)
    meets = F.concat(F.array(F.lit(-1).cast("long")), F.when(F.col("n_j") > 0, upto("n_j")).otherwise(none), after)  # itself, blocks of guests, later blocks of residents
    mine = mine.select("half", "leaf", "i", F.explode(meets).alias("j"), "fp", "own")
    guests = cut.where("not own").select("half", "leaf", F.explode(upto("n_i")).alias("i"), some("n_j").alias("j"), "fp", "own")
    later = cut.where("own and n_i > 1").withColumn("at", some("n_i")).where("at > 0").select("half", "leaf", F.explode(upto("at")).alias("i"), (-2 - F.col("at")).alias("j"), "fp", F.lit(False).alias("own"))

    def link(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("fp")
        found = forest_links(pdf["fp"].to_numpy(np.int64).view(np.uint64), pdf["own"].to_numpy(bool), key[3] == -1, radius)
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return mine.unionByName(guests).unionByName(later).groupBy("half", "leaf", "i", "j").applyInPandas(link, "a long, b long")


def near_duplicates(docs: DataFrame, *, words: int = 5, radius: int = 4, leaf: int = 4096, block: int = 16384) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id: a row per document row."""
    rows = materialise(fingerprints(docs, words), "simhash-rows")
    classes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-classes")
    shards = materialise(routed(classes, levels_for(classes.count(), leaf), radius), "simhash-shards")
    links = materialise(leaf_links(shards, radius, block).distinct(), "simhash-links")
    label = components(links)
    named = classes.join(label.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("label", "fp").alias("label"))
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "label").select("fp", "component_id")
    return join_small(rows, named, "fp", "left").select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
