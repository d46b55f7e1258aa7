import random

import numpy as np
import xxhash

from lodestone.llm import simhash
from tests.llm.helpers import ODD, docs, prose


def brute_fingerprint(text, words):
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    shingles = [b" ".join(found[i : i + words]) for i in range(len(found) - words + 1)] or [b" ".join(found)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def brute_components(prints, ids, radius=4):
    least = list(range(len(prints)))

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                least[root(i)] = root(j)
    found = {}
    for i, d in enumerate(ids):
        if d is not None:
            found[root(i)] = min(found.get(root(i), d), d)
    return [found.get(root(i)) for i in range(len(prints))]


def flipped(fp, n, rng):
    for bit in rng.sample(range(64), n):
        fp ^= 1 << bit
    return fp


def clustered(seed, n=120):
    """Chains and clouds of fingerprints at distances about the radius, single ones, and some that cross every half."""
    rng = random.Random(seed)
    out = [0, (1 << 64) - 1]
    for _ in range(n):
        at = rng.getrandbits(64)
        out.append(at)
        for _ in range(rng.choice([0, 1, 2, 6])):
            at = flipped(at, rng.choice([1, 2, 3, 4, 5, 6]), rng)
            out.append(at)
    cloud = rng.getrandbits(64)
    out += [flipped(cloud, rng.choice([1, 2, 3]), rng) for _ in range(150)]
    return list(dict.fromkeys(out))


def test_query_equals_brute_force(spark):
    texts = [*ODD[:4], *ODD[7:], "A b C d e", "a B c d E"] + [prose(i, 40) for i in range(60)] + [prose(i, 40) + " end" for i in range(30)] + [prose(7, 400)] * 3 + [prose(7, 400).replace("owls", "hens", 1)]
    ids = [(11 * i) % 1009 for i in range(len(texts))]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs(spark, texts, ids=ids), words=4).collect()}
    prints = [brute_fingerprint(t, 4) for t in texts]
    want = brute_components(prints, ids)
    assert got == {i: (f"{p:016x}", c) for i, p, c in zip(ids, prints, want, strict=True)}


def test_every_link_is_found_at_every_depth_and_block_size(spark):
    """Trees of no level to all levels, leaves cut into blocks of a few rows: components equal brute force on the fingerprints."""
    prints = clustered(5)
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    classes = spark.createDataFrame([(p, i) for i, p in enumerate(signed)], "fp long, rep long").repartition(3)
    want = brute_components(prints, signed)
    groups = {}
    for p, c in zip(signed, want, strict=True):
        groups.setdefault(c, set()).add(p)
    for levels, block in ((0, 40), (2, 7), (3, 100_000), (8, 100_000)):
        links = simhash.leaf_links(simhash.routed(classes, levels, 4), 4, block)
        label = {r["node"]: r["label"] for r in simhash.components(links).collect()}
        found = {}
        for p in signed:
            found.setdefault(label.get(p, p), set()).add(p)
        assert sorted(map(sorted, found.values())) == sorted(map(sorted, groups.values())), (levels, block)


def test_leaves_prune_and_lose_nothing():
    rng = np.random.default_rng(3)
    fp = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 20_000).astype(np.uint64)
    levels = simhash.levels_for(len(fp), 400)
    place, leaf, own = simhash.visited(fp, 0, levels, 2)
    homes, asked = np.unique(leaf[own], return_counts=True), np.bincount(place, minlength=len(fp))
    compared = sum(int(n) * int((leaf == at).sum()) for at, n in zip(*homes, strict=True))
    assert levels == 3 and own.sum() == len(fp) and compared < 0.3 * len(fp) ** 2 and asked.max() <= 25
    near = fp ^ (np.uint64(1) << rng.integers(0, 32, len(fp)).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 32, len(fp)).astype(np.uint64))
    both = np.concatenate([fp, near])
    place, leaf, own = simhash.visited(both, 0, levels, 2)
    seen = {(int(p), int(x)) for p, x in zip(place, leaf, strict=True)}
    home = {int(p): int(x) for p, x in zip(place[own], leaf[own], strict=True)}
    for i in range(0, len(fp), 97):
        a, b = home[i], home[i + len(fp)]
        assert (i, b) in seen if b <= a else (i + len(fp), a) in seen


def test_odd_rows(spark):
    assert simhash.near_duplicates(docs(spark, [])).collect() == []
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs(spark, [None, "", " \n", "x y", "X  y", "x y", "lone one"], ids=[7, 9, None, 5, 5, None, None])).collect()]
    word = f"{xxhash.xxh64_intdigest(b'x y', 42):016x}"
    assert sorted(got, key=str) == sorted([(7, "0" * 16, 7), (9, "0" * 16, 7), (None, "0" * 16, 7), (5, word, 5), (5, word, 5), (None, word, 5), (None, f"{xxhash.xxh64_intdigest(b'lone one', 42):016x}", None)], key=str)


def test_hash_is_sparks_own(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([("same text here",)], "t string").select(F.xxhash64("t")).first()[0]
    assert row == simhash.fingerprint("same text here", 4)
