import re
from collections import defaultdict

from lodestone.llm import mixing
from tests.llm.helpers import ODD, docs, prose


def water_fill(sizes, weights=(5, 2, 1), most=3):
    """Targets by literal resharing."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return target | share
        target |= {s: float(most * sizes[s]) for s in over}
        left -= sum(most * sizes[s] for s in over)
        free -= over
    return target


def check(rows, texts, sources):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    totals = defaultdict(int)
    for n, s in zip(size, sources, strict=True):
        totals[s] += n
    target = water_fill(dict(totals))
    assert sorted(r["size"] for r in rows) == sorted(size)
    taken = defaultdict(int)
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert r["source_size"] == totals[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6 * max(1, target[r["source"]])
        taken[r["source"]] += r["taken"]
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(0.05 * t, 5), (s, taken[s], t)


def test_targets_and_schedule(spark):
    texts = [prose(i, 20 + i % 90) for i in range(300)] + ODD
    sources = [("a" if i % 3 else None if i % 7 == 0 else f"src{i % 11}") for i in range(len(texts))]
    frame = docs(spark, texts, sources=sources)
    rows = mixing.schedule(frame).collect()
    check(rows, texts, sources)
    key = lambda r: (r["doc_id"], r["taken"])
    assert sorted(map(key, rows)) == sorted(map(key, mixing.schedule(frame.repartition(5)).collect()))


def test_excess_is_reshared(spark):
    texts = [prose(i, 30) for i in range(90)]
    sources = ["a"] * 2 + ["b"] * 3 + ["c"] * 85
    check(mixing.schedule(docs(spark, texts, sources=sources)).collect(), texts, sources)


def test_odd_tables(spark):
    assert mixing.schedule(docs(spark, [])).collect() == [] and mixing.mix(docs(spark, [])).collect() == []
    assert [r["taken"] for r in mixing.schedule(docs(spark, [None, ""], sources=["a", None])).collect()] == [0, 0]
    one = mixing.schedule(docs(spark, ["only one"], sources=["a"])).collect()
    assert one[0]["taken"] == 2 and one[0]["target"] == 2.0
    same = mixing.schedule(docs(spark, ["a b c"] * 50, ids=[1] * 50, sources=["a"] * 50)).collect()
    assert len(same) == 50 and sum(r["taken"] for r in same) == 150


def test_mix_repeats_rows(spark):
    frame = docs(spark, [prose(i, 50) for i in range(200)], sources=["a"] * 20 + ["b"] * 180)
    out = mixing.mix(frame)
    assert out.columns == frame.columns
    n = out.groupBy("source").count().collect()
    n = {r["source"]: r["count"] for r in n}
    assert 55 <= n["a"] <= 60  # three times each of its 20
    assert out.groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 3
