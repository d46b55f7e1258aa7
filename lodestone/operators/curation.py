"""Curation: duplicates by digest, near-duplicates by perceptual hash, unions of crawl sources, toggles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.sources.shared import materialise

BITS = 64
GROUP = 1 << 17  # hashes of one band that meet in a task
CANDIDATES = 1 << 20  # pairs that are compared at once


def bands(n: int) -> list[tuple[int, int]]:
    """First bit and width of each of n bands of 64 bits."""
    edges = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def errors(below: int, n: int) -> int:
    """Of fewer than ``below`` differing bits, some one of n bands has this many at most."""
    return (below - 1) // n


def band_count(rows: int, below: int) -> int:
    """The number of bands with the least work for so many hashes: rows that are tried, and pairs that meet by chance."""

    def work(n: int) -> float:
        return sum(rows * tries * (1 + rows / 2**width) for _, width in bands(n) for tries in [len(flips(width, errors(below, n)))])

    return min(range(3, 6), key=work)


def flips(width: int, most: int) -> list[int]:
    """Every set of at most ``most`` bits of a band."""
    return [sum(1 << b for b in c) for e in range(most + 1) for c in combinations(range(width), e)]


def first_of_each(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key by ``order``."""
    return rows.withColumn("_place", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_place = 1").drop("_place")


def new_by_digest(rows: DataFrame, stored: DataFrame, digest: str, *order: str) -> DataFrame:
    """Exact duplicates go: within the run all but the first, and all that are stored already."""
    return first_of_each(rows, digest, *order).join(stored.select(digest).distinct(), digest, "left_anti")


def _number(phash: Column) -> Column:
    """64 bits of hex as a long, by halves."""
    half = lambda at: F.conv(F.substring(phash, at, 8), 16, 10).cast("long")
    high = half(1)
    high = F.when(high >= 1 << 31, high - (1 << 32)).otherwise(high)
    return high * F.lit(1 << 32) + half(9)


def _numbered(rows: DataFrame, key: str, phash: str) -> DataFrame:
    return rows.select(F.col(key).alias("k"), _number(F.col(phash)).alias("h")).where("h is not null")


def close_hashes(values: DataFrame, below: int) -> DataFrame:
    """x, y, distance: pairs x < y of different hashes (column h) with fewer than ``below`` differing bits.

    64 bits lie in bands, and some band of such a pair differs in few bits only. One side keeps its bands, the other tries
    each band and all of its errors. Hashes are dealt into groups by the first bits of a band; only errors in those bits are
    rows of a shuffle, those in the rest are tried inside the group, and the exact distance decides. The number of bands
    and of first bits follows from the number of hashes; a group that is too large is met in blocks, own against tried ones.
    """
    rows = values.count()
    n = band_count(rows, below)
    most, first = errors(below, n), min(12, (rows // GROUP).bit_length())
    start = F.array(*[F.struct(F.lit(i).alias("band"), F.shiftright("h", at + width - first).bitwiseAND((1 << first) - 1).cast("int").alias("bits")) for i, (at, width) in enumerate(bands(n))])
    own, turned = values.select("h", F.inline(start)), flips(first, most)
    sizes = {(r["band"], r["bits"]): r["n"] for r in own.groupBy("band", "bits").agg(F.count("*").alias("n")).collect()}  # n * 4096 at most
    blocks = [(band, bits, 1 + size // (2 * GROUP), 1 + sum(sizes.get((band, bits ^ t), 0) for t in turned) // (32 * GROUP)) for (band, bits), size in sizes.items()]
    if not blocks:
        return values.select(F.col("h").alias("x"), F.col("h").alias("y"), F.lit(0).alias("distance"))  # no hashes, no rows
    blocks = F.broadcast(values.sparkSession.createDataFrame(blocks, "band int, bits int, n_own int, n_tried int"))
    turns = F.array(*[F.struct(F.lit(t).alias("turn"), F.lit(most - t.bit_count()).alias("left")) for t in turned])
    tried = own.select("h", "band", "bits", F.inline(turns)).select("h", "left", "band", F.col("bits").bitwiseXOR(F.col("turn")).alias("bits"))
    part, each = lambda m: F.pmod(F.xxhash64("h"), F.col(m)).cast("int"), lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    own = own.join(blocks, ["band", "bits"]).withColumn("i", part("n_own")).select("h", "band", "bits", "i", each("n_tried").alias("j"))
    tried = tried.join(blocks, ["band", "bits"]).withColumn("j", part("n_tried")).select("h", "left", "band", "bits", each("n_own").alias("i"), "j")
    own, places = own.select(*[F.col(c).alias(c) for c in own.columns]), bands(n)  # columns of its own: both sides come of one table

    def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        at, width = places[key[0].as_py()]
        own, other, allowed = (t.column(c).to_numpy() for t, c in ((left, "h"), (right, "h"), (right, "left")))
        found = [np.zeros((3, 0), np.int64), *_meetings(own, other, allowed, at, width - first, below)]
        x, y, d = np.concatenate(found, axis=1)
        return pa.table({"x": x, "y": y, "distance": d.astype(np.int32)})

    keys = ["band", "bits", "i", "j"]
    return own.groupBy(*keys).cogroup(tried.groupBy(*keys)).applyInArrow(meet, "x long, y long, distance int").distinct()


def _meetings(own: np.ndarray, tried: np.ndarray, allowed: np.ndarray, at: int, width: int, below: int) -> Iterator[np.ndarray]:
    """(x, y, distance) of x in ``own`` and y in ``tried``, x < y, that differ in up to ``allowed`` (one for each y) of ``width`` bits from ``at`` on."""
    bits = lambda h: ((h.view(np.uint64) >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64)
    own = own[np.argsort(bits(own), kind="stable")]
    ends = np.append(0, np.cumsum(np.bincount(bits(own), minlength=1 << width)))
    for some in np.unique(allowed).tolist():
        asked = tried[allowed == some]
        asked = asked[np.argsort(bits(asked), kind="stable")]
        for low in range(0, len(asked), 1 << 16):
            y = asked[low : low + (1 << 16)]
            mine = bits(y)
            for flip in flips(width, some):
                place = mine ^ flip
                begin = ends[place]
                upto = np.cumsum(ends[place + 1] - begin)
                i = 0
                while i < len(y) and upto[-1] > (base := int(upto[i - 1]) if i else 0):
                    j = max(i + 1, int(np.searchsorted(upto, base + CANDIDATES, "right")))  # a bounded number of candidates at once
                    n = np.diff(upto[i:j], prepend=base)
                    x, z = own[np.repeat(begin[i:j] - (upto[i:j] - n - base), n) + np.arange(upto[j - 1] - base)], np.repeat(y[i:j], n)
                    distance = np.bitwise_count((x ^ z).view(np.uint64))
                    near = np.flatnonzero((distance < below) & (x < z))
                    if len(near):
                        yield np.stack([x[near], z[near], distance[near].astype(np.int64)])
                    i = j


def _both_ways(values: DataFrame, below: int) -> DataFrame:
    """x, y, distance of all ordered pairs of close hashes, each hash with itself among them."""
    one = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"), "distance")
    close = close_hashes(values, below).select(F.inline(F.array(one("x", "y"), one("y", "x"))))
    return close.unionByName(values.select(F.col("h").alias("x"), F.col("h").alias("y"), F.lit(0).alias("distance")))


def hamming_pairs(rows: DataFrame, key: str, phash: str, below: int = 10) -> DataFrame:
    """a, b, distance of all pairs a < b of rows with fewer than ``below`` bits between their hashes; many rows of one hash are many pairs."""
    numbered = _numbered(rows, key, phash)
    one, two = numbered.select(F.col("k").alias("a"), F.col("h").alias("x")), numbered.select(F.col("k").alias("b"), F.col("h").alias("y"))
    return _both_ways(materialise(numbered.select("h").distinct(), "hashes"), below).join(one, "x").join(two, "y").where("a < b").select("a", "b", "distance")


def near_duplicate_of(rows: DataFrame, key: str, phash: str, below: int = 10, mode: str = "first") -> DataFrame:
    """key, near_duplicate_of, distance: for each row the first earlier row within the distance, or the nearest.

    Of the rows of a hash only the first can be anyone's answer, so that each row meets the first rows of the
    hashes near its own, however many rows share one.
    """
    order = F.struct("a") if mode == "first" else F.struct("distance", "a")
    numbered = _numbered(rows, key, phash)
    firsts = materialise(numbered.groupBy("h").agg(F.min("k").alias("a")), "hashes")
    found = _both_ways(firsts.select("h"), below).join(firsts.withColumnRenamed("h", "x"), "x").select("y", "a", "distance")
    found = numbered.select(F.col("k").alias("b"), F.col("h").alias("y")).join(found, "y").where("a < b")
    return found.groupBy(F.col("b").alias(key)).agg(F.min_by("a", order).alias("near_duplicate_of"), F.min_by("distance", order).alias("distance"))


def union_sources(*sources: DataFrame) -> DataFrame:
    """One item schema out of several normalised sources; absent fields are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def distinct_prompts(bank: DataFrame, *columns: str) -> DataFrame:
    """Each prompt of a bank once."""
    return bank.select(*columns).dropDuplicates()


def batch_queue(rows: DataFrame, waiting: Column, created: str, key: str, n: int) -> DataFrame:
    """The next n waiting rows, the oldest first."""
    return rows.where(waiting).orderBy(created, key).limit(n)


def favourites(actions: DataFrame, item: str, order: list[str], payload: str) -> DataFrame:
    """Items toggled an odd number of times, with their latest payload."""
    told = actions.groupBy(item).agg(F.count("*").alias("n"), F.max_by(payload, F.struct(*order)).alias(payload))
    return told.where(F.col("n") % 2 == 1).drop("n")


def tiers(*tables: DataFrame) -> DataFrame:
    """Tables one after another, with ``tier`` as the first sort key."""
    return reduce(DataFrame.unionByName, [t.withColumn("tier", F.lit(i)) for i, t in enumerate(tables)])


def related_by_overlap(rows: DataFrame, key: str, arrays: list[str], n: int = 6) -> DataFrame:
    """key, related, place: up to n other items that share a value of any of the arrays, smallest keys first.

    For each value only its n + 1 smallest keys can be among anyone's n smallest, so a frequent value sends no more.
    """
    values = F.array_distinct(F.concat(*[F.transform(F.filter(a, lambda v: v.isNotNull()), lambda v, a=a: F.concat(F.lit(f"{a}:"), v)) for a in arrays]))
    flat = rows.select(F.col(key).alias("k"), F.explode(values).alias("v"))
    few = flat.withColumn("p", F.row_number().over(W.partitionBy("v").orderBy("k"))).where(F.col("p") <= n + 1).select("v", F.col("k").alias("related"))
    pairs = flat.join(few, "v").where("k <> related").select("k", "related").distinct()
    return pairs.withColumn("place", F.row_number().over(W.partitionBy("k").orderBy("related"))).where(F.col("place") <= n).withColumnRenamed("k", key)


def coalesce_update(target: DataFrame, source: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """Update-join: the target's value wins, the source (one row a key, checked) fills nulls."""
    n = F.count("*").over(W.partitionBy(*on))
    once = source.select(*on, *[F.col(c).alias(f"_{c}") for c in columns], F.when(n > 1, F.raise_error(F.lit("the source has a key twice"))).alias("_once"))
    out = target.join(once, on, "left").where(F.col("_once").isNull())
    return out.select(*[F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) if c in columns else F.col(c) for c in target.columns])


def reachable(edges: DataFrame, roots: DataFrame, depth: int = 2, fan_out: int | None = None) -> DataFrame:
    """node, depth: nodes within ``depth`` steps of the roots, each at its least depth.

    Every step is written before the next begins: nodes seen before are left out of the front, so that cycles end, and so
    does the search once a front is empty. ``fan_out`` bounds what a node leads to, in the order of the nodes it leads to (null: all).
    """
    steps = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    if fan_out is not None:
        steps = steps.withColumn("_n", F.row_number().over(W.partitionBy("src").orderBy("dst"))).where(F.col("_n") <= fan_out).drop("_n")
    seen = front = materialise(roots.select("node", F.lit(0).alias("depth")).distinct(), "front")
    for d in range(1, depth + 1):
        found = steps.join(front.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        front = materialise(found.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(d)), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def with_parents(hits: DataFrame, children: DataFrame, parents: DataFrame, key: str, parent: str) -> DataFrame:
    """Hits on children with their child row and its parent's row; the hits (key, …) go before both joins, hits without a parent drop out."""
    return hits.join(children, key).join(parents, parent)


def without_rows(rows: DataFrame, key: str, others: DataFrame, other_key: str) -> DataFrame:
    """Anti-join: rows whose key the other table lacks (backfills, work not yet done)."""
    return rows.join(others.select(F.col(other_key).alias("_key")), F.col(key) == F.col("_key"), "left_anti")


def ordered_lookup(requests: DataFrame, rows: DataFrame, ids: str, key: str, strict: bool = True) -> DataFrame:
    """Rows in the order of the requested ids, with ``label`` IMG-n; a missing id fails the job, or is dropped."""
    asked = requests.select(*[c for c in requests.columns if c != ids], F.posexplode(ids).alias("position", key))
    out = asked.join(rows.withColumn("_found", F.lit(True)), key, "left")
    out = out.where(F.coalesce("_found", F.raise_error(F.concat(F.lit("not found: "), F.col(key).cast("string"))).cast("boolean"))) if strict else out.where("_found")
    return out.drop("_found").withColumn("label", F.concat(F.lit("IMG-"), (F.col("position") + 1).cast("string")))
