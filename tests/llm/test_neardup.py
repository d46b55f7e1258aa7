import random

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import common, neardup, pieces
from lodestone.llm.common import counted
from tests.llm.helpers import ODD, docs, prose


def brute(texts, ids, words, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else []))
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and min(len(sets[i]), len(sets[j])) * 100 >= percent * max(len(sets[i]), len(sets[j])):
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    parent[root(i)] = root(j)
    least = {}
    for i in range(len(texts)):
        least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    return [(ids[i], len(sets[i]), least[root(i)], ids[i] == least[root(i)]) for i in range(len(texts))]


def edited(words, n, rng):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return words


def corpus(seed=3):
    """Exact copies, chains of edits, clusters around an original that is not the smallest id, and passages in common."""
    rng = random.Random(seed)
    texts = list(ODD) + [prose(i, rng.choice([2, 3, 40, 120])) for i in range(150)]
    for c in range(12):
        original = prose(1000 + c, rng.choice([30, 150, 300])).split()
        at = original
        for k in range(rng.choice([3, 10, 40])):
            texts.append(" ".join(edited(original, rng.randrange(1, 8), rng)))
            at = edited(at, 2, rng)
            texts.append(" ".join(at).upper() if k % 3 else " ".join(at))
        texts += [" ".join(original)] * 3
    passage = prose(5000, 60)
    texts += [f"{prose(6000 + i, 30)} {passage}" for i in range(60)]
    rng.shuffle(texts)
    return texts


def test_components_equal_brute_force(spark):
    texts = corpus()
    ids = [(7 * i) % 100_003 for i in range(len(texts))]
    for words, percent in ((3, 85), (5, 80)):
        got = neardup.near_duplicates(docs(spark, texts, ids=ids), words=words, percent=percent).collect()
        assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == sorted(brute(texts, ids, words, percent))


def test_what_hubs_miss_is_settled_in_small_blocks(spark, monkeypatch):
    """Without any hub link, all links come from the settling of blocks against blocks, and every one that members of a group have is found."""
    texts = corpus(9)
    ids = list(range(len(texts)))
    settled, groups = neardup.settled, []
    monkeypatch.setattr(neardup, "confirmed", lambda pairs, sets, percent: pairs.limit(0))

    def watched(members, label, sets, percent):
        groups.append((members.collect(), {r["cid"]: set(np.frombuffer(r["set"], np.uint64).tolist()) for r in sets.collect()}))
        more = settled(members, label, sets, percent, block=4)
        groups.append([] if more is None else more.collect())
        return more

    monkeypatch.setattr(neardup, "settled", watched)
    frame = docs(spark, texts, ids=ids)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(frame, words=3, percent=85).collect()}
    want = {i: c for i, _, c, _ in brute(texts, ids, 3, 85)}
    assert all(want[i] == want[c] for i, c in got.items())  # nothing linked that is not
    monkeypatch.undo()
    (members, sets), links = groups
    near = lambda a, b: 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    parent = {c: c for c in sets}

    def root(c):
        while parent[c] != c:
            c = parent[c]
        return c

    assert links and all(near(r["a"], r["b"]) for r in links)
    for r in links:
        parent[root(r["a"])] = root(r["b"])
    by = {}
    for r in members:
        by.setdefault(r["key"], []).append(r["cid"])
    assert all(root(a) == root(b) for of in by.values() for i, a in enumerate(of) for b in of[:i] if near(a, b))


def test_templates_are_not_compared_and_links_among_them_are_found():
    rng = np.random.default_rng(4)
    template = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate([template, rng.integers(0, 1 << 62, 100).astype(np.uint64)])) for _ in range(400)]
    for i in range(0, 60, 2):  # near copies of each other: 20 of 400 shingles apart
        sets[i + 1] = np.unique(np.concatenate([sets[i][20:], rng.integers(0, 1 << 62, 20).astype(np.uint64)]))
    cids, is_x = np.arange(400), np.arange(400) % 3 == 0
    links, tried = neardup.block_links(cids, is_x, cids.copy(), sets, 85)
    want = {(a, b) for a in range(400) for b in range(400) if is_x[a] and not is_x[b] and 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))}
    assert set(links) == want and want and tried < 200  # of some 35,000 pairs


def test_several_texts_under_one_id_keep_their_links(spark):
    one, two = prose(1, 60), prose(2, 60)
    rows = [(1, one), (1, two), (2, one.replace(one.split()[-1], "end")), (3, two.replace(two.split()[-1], "end")), (None, one), (None, "quite another text without an id"), (None, "quite another text without an id"), (4, "x y z")]
    frame = docs(spark, [t for _, t in rows], ids=[i for i, _ in rows])
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(frame, words=3, percent=80).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (None, 1, False), (None, None, True), (None, None, True), (4, 4, True)], key=str)
    kept = neardup.deduplicated(frame, words=3, percent=80).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted([(1, one), (1, two), (4, "x y z"), (None, "quite another text without an id")], key=str)


def test_repeated_rows_and_rows_without_words_in_the_deduplicated(spark):
    texts, ids = ["a b c d e f"] * 3 + [None, "", None, "other words in this one"], [5, 5, None, 7, 8, None, 9]
    out = neardup.deduplicated(docs(spark, texts, ids=ids))
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted([(5, "a b c d e f"), (7, None), (8, ""), (None, None), (9, "other words in this one")], key=str)


def test_odd_rows(spark):
    assert neardup.near_duplicates(docs(spark, [])).collect() == []
    got = neardup.near_duplicates(docs(spark, ["a b c d e f", "a b c d e f", None, "", "x y"], ids=[5, None, 7, 8, 9])).collect()
    rows = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got}
    assert rows[5] == (2, 5, True) and rows[None] == (2, 5, False) and rows[7] == (0, 7, True) and rows[8] == (0, 8, True) and rows[9] == (1, 9, True)


def test_deduplicated_keeps_one(spark):
    frame = docs(spark, ["a b c d e f"] * 4 + ["other words in this one"], ids=[4, 3, 2, 1, 0])
    out = neardup.deduplicated(frame)
    assert out.columns == frame.columns and sorted(r["doc_id"] for r in out.collect()) == [0, 1]


def test_tables_are_counted_while_they_are_written(spark, monkeypatch):
    """Each further job leaves a plan in the driver."""
    links = spark.createDataFrame([(i, i + 1) for i in range(9)], "a long, b long")
    frame = docs(spark, [prose(1), prose(1), prose(2), None, ""])

    def asked(self):
        raise AssertionError("a job of its own")

    for name in ("isEmpty", "count"):
        monkeypatch.setattr(type(links), name, asked)
    label, kept = neardup.components(links), neardup.deduplicated(frame)
    monkeypatch.undo()
    assert {(r["node"], r["label"]) for r in label.collect()} == {(i, 0) for i in range(10)}
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3, 4]


def test_counted(spark):
    for n in (0, 7):
        out, some = counted(spark.range(n), "test-counted", F.col("id") > 4)
        assert out.count() == n and some == max(n - 5, 0) and counted(out, "test-counted")[1] == n
        assert counted(out.join(spark.range(0), "id"), "test-counted")[1] == 0


def test_many_ids_go_by_a_shuffle(spark, monkeypatch):
    texts = [prose(i % 9) for i in range(40)] + [None, "", "one two"]
    few = sorted((r["doc_id"], r["text"] or "") for r in neardup.deduplicated(docs(spark, texts)).collect())
    monkeypatch.setattr(neardup, "MOST_IDS", 3)
    assert sorted((r["doc_id"], r["text"] or "") for r in neardup.deduplicated(docs(spark, texts)).collect()) == few


def test_tasks_drop_what_other_operators_left(monkeypatch):
    """A worker that had encoded pieces kept its codec through near-dedup."""
    with open(pieces.VOCABULARY, "rb") as f:
        model = f.read()
    monkeypatch.setattr(common, "_LEFT", {})
    one = pieces._codec(model)
    assert pieces._codec(model) is one
    assert common.left_by("neardup") == {} and list(common._LEFT) == ["neardup"]
    assert pieces._codec(model) is not one
