"""Quality and toxicity: held-out accuracy, exact neighbours, calibration, odd tables."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from lodestone.llm import quality, toxicity
from lodestone.llm.calibration import isotonic
from tests.llm.helpers import ODD, docs, prose


def labelled(spark, texts, marks, column):
    other = "toxic" if column == "quality" else "quality"
    rows = [(i, m, None, "x") for i, m in enumerate(marks) if m is not None] + [(None, 1, 1, "x"), (10**9, 1, 0, "x")]
    return docs(spark, texts), spark.createDataFrame(rows, f"doc_id long, {column} int, {other} int, text string")


def check(rows, marks, threshold):
    held = [r for r in rows if r["held_out"] and r["doc_id"] is not None and marks[r["doc_id"]] is not None]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= threshold) for r in rows)
    return np.mean([r["predicted"] == marks[r["doc_id"]] for r in held])


def test_quality_on_held_out_rows(spark):
    rng = random.Random(1)
    texts, marks = list(ODD), [None] * len(ODD)
    for i in range(400):
        good = rng.random() < 0.7
        t = prose(i, 50)
        texts.append(t if good else rng.choice([t.upper().replace(" ", "!! "), " ".join(w + "*** " for w in t.split()), " | ".join(t.split()), "buy now " * 40]))
        marks.append(int(good))
    rows = quality.query(*labelled(spark, texts, marks, "quality"), n_features=64).collect()
    assert len(rows) == len(texts) and check(rows, marks, 0.3) > 0.97


def test_quality_equals_a_dense_twin(spark):
    """Statistics, Fourier features, one dense ridge and a pooled map, computed in one place and one by one."""
    rng = random.Random(7)
    texts = [*ODD[:4], *ODD[7:9]] + [prose(i, 30) if rng.random() < 0.6 else prose(i, 20).upper() + " !!! " * rng.randrange(3) for i in range(150)]
    marks = [None] * 6 + [int(not t.split()[0].isupper() or rng.random() < 0.1) for t in texts[6:]]
    got = {r["doc_id"]: r["score"] for r in quality.score(*labelled(spark, texts, marks, "quality"), n_features=20, width=3.0, penalty=0.5).collect()}
    x = np.array([quality.statistics(t or "") for t in texts])
    gen = np.random.default_rng(17)
    w, b = gen.standard_normal((x.shape[1], 20)) / 3.0, gen.uniform(0, 2 * np.pi, 20)
    z = np.clip((x - x.mean(0)) / np.where(x.std(0) > 1e-9, x.std(0), 1.0), -8, 8)
    f = np.array([[math.sqrt(2 / 20) * math.cos(sum(zi * wi for zi, wi in zip(row, w[:, j], strict=True)) + b[j]) for j in range(20)] + [1.0] for row in z])
    part = [zlib.crc32(str(i).encode()) % 5 for i in range(len(texts))]
    fit = [i for i, m in enumerate(marks) if m is not None and part[i] in (1, 2, 3)]
    own = [i for i, m in enumerate(marks) if m is not None and part[i] == 4]
    y = np.array([m or 0 for m in marks], float)
    weights = np.linalg.solve(f[fit].T @ f[fit] + 0.5 * np.eye(21), f[fit].T @ y[fit])
    value = f @ weights
    cells = {}
    for i in own:
        cells.setdefault(round(min(max(value[i], -0.5), 1.5), 3), []).append(y[i])
    pools = [[[v] * len(m), m] for v, m in sorted(cells.items())]
    while any(np.mean(a[1]) >= np.mean(c[1]) for a, c in zip(pools, pools[1:], strict=False)):  # pool what falls
        k = next(k for k in range(len(pools) - 1) if np.mean(pools[k][1]) >= np.mean(pools[k + 1][1]))
        pools[k : k + 2] = [[pools[k][0] + pools[k + 1][0], pools[k][1] + pools[k + 1][1]]]
    mean = np.mean([y[i] for i in own])
    knots = [np.mean(v) for v, _ in pools], np.maximum.accumulate([(sum(m) + mean) / (len(m) + 1) for _, m in pools])
    want = np.interp(value, *knots)
    assert len(pools) > 1 and all(abs(got[i] - want[i]) < 1e-6 for i in range(len(texts)))


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(2)
    texts, marks = list(ODD), [None] * len(ODD)
    for i in range(500):
        bad = rng.random() < 0.2
        words = prose(i, 60).split()
        for _ in range(4 * bad):
            words[rng.randrange(60)] = rng.choice(["grumblefoul", "snarlwort,", "blightpest" + rng.choice(["er", "ing", "ily"])])
        texts.append(" ".join(words))
        marks.append(int(bad))
    frame, labels = labelled(spark, texts, marks, "toxic")
    rows = toxicity.query(frame, labels).collect()
    assert len(rows) == len(texts) and check(rows, marks, 0.5) > 0.97
    assert any(r["near"] for r in rows if r["predicted"]) and not any(r["predicted"] for r in rows if r["doc_id"] < 3)


def plain_scores(texts, marks, k=15):
    """Brute force: every word of every example, every pair of document and example, by plain dictionaries."""
    words = [re.findall(r"[^\W\d_]+", (t or "").lower()) for t in texts]
    shown = [i for i, m in enumerate(marks) if m is not None and zlib.crc32(str(i).encode()) % 5]
    known = {w for i in shown for w in words[i]}
    df = Counter(w for ws in words for w in set(ws) if w in known)
    a1 = sum(marks[i] for i in shown)
    a0 = len(shown) - a1
    n1, n = Counter(w for i in shown if marks[i] for w in set(words[i])), Counter(w for i in shown for w in set(words[i]))
    phi = {w: abs(n1[w] * (a0 - n[w] + n1[w]) - (n[w] - n1[w]) * (a1 - n1[w])) / math.sqrt(n[w] * max(a0 + a1 - n[w], 1) * a0 * a1) for w in known}

    def vector(ws):
        v = {w: (1 + math.log(c)) * (math.log((1 + len(texts)) / (1 + df[w])) * phi[w] + 1e-9) for w, c in Counter(ws).items() if w in known}
        size = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {w: x / size for w, x in v.items()}

    vectors, rate, out = [vector(ws) for ws in words], a1 / len(shown), []
    for i, v in enumerate(vectors):
        cosine = sorted(((-round(sum(x * vectors[j].get(w, 0) for w, x in v.items()), 9), j) for j in shown if j != i))
        best = [(-c, j) for c, j in cosine if c < 0][:k]
        total = sum(c for c, _ in best)
        out.append(((sum(c * marks[j] for c, j in best) + 0.5 * rate) / (total + 0.5) if best else None, [j for _, j in best[:3]], best))
    return out


def test_votes_equal_brute_force(spark):
    rng = random.Random(5)
    texts, marks = [*ODD, "word", "word"], [None, 0, 1, 0, 1, None, None, 1, 0, 1, 0, None, 1, 0]
    for i in range(320):
        words = prose(i, rng.choice([3, 20, 90])).split() + rng.sample(["grumblefoul", "snarlwort", "grubwort"], rng.choice([0, 0, 0, 1, 2]))
        texts.append(" ".join(words))
        marks.append(int("wort" in texts[-1] or "foul" in texts[-1]) if rng.random() < 0.8 else None)
    frame, labels = labelled(spark, texts, marks, "toxic")
    known, index = toxicity.index_of(frame, labels, 5000, 4_000_000)
    got = {r["doc_id"]: r for r in toxicity.votes(frame, known, index, 15).collect()}
    shown = {i for i, m in enumerate(marks) if m is not None and zlib.crc32(str(i).encode()) % 5}
    assert set(index.value.ids.tolist()) == shown and len(known.value) == len({w for i in shown for w in toxicity.words_of(texts[i])})
    for i, (vote, _near, best) in enumerate(plain_scores(texts, marks)):
        assert (vote is None) == (got[i]["vote"] is None) and (vote is None or abs(vote - got[i]["vote"]) < 1e-6), i
        cosines = dict((j, c) for c, j in best)
        assert len(got[i]["near"]) == min(3, len(best)) and all(abs(cosines[j] - best[n][0]) < 1e-6 for n, j in enumerate(got[i]["near"])), i


def test_every_word_counts_and_bounds_are_on_rows(spark):
    texts = [f"only{i} zz{'abc'[i % 3]} filler" for i in range(300)]
    letters = {str(d): c for d, c in enumerate("klmnopqrst")}
    texts = ["".join(letters.get(c, c) for c in t) for t in texts]
    frame, labels = labelled(spark, texts, [i % 2 for i in range(300)], "toxic")
    known, index = toxicity.index_of(frame, labels, 5000, 4_000_000)
    assert len(index.value.ids) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(300)) and len(known.value) == len(index.value.ids) + 4
    assert len(toxicity.index_of(frame, labels, 40, 4_000_000)[1].value.ids) == 40
    assert len(toxicity.index_of(frame, labels, 5000, 100)[1].value.ids) == 33  # three words each


def index_over(vectors, labels=None, ids=None):
    n, gain = len(vectors), np.geomspace(0.05, 5, 40)
    terms, tf = (np.concatenate([np.array(v[i]) for v in vectors]) for i in (0, 1))
    return toxicity.Index(np.arange(n) if ids is None else ids, np.zeros(n) if labels is None else labels, terms, tf.astype(float), np.array([len(v[0]) for v in vectors]), gain)


def test_nearest_is_exact_and_skips_blocks():
    rng = np.random.default_rng(6)
    vectors = [(sorted(rng.choice(40, n, replace=False).tolist()), rng.integers(1, 4, n).tolist()) for n in rng.integers(1, 9, 6000)]
    index = index_over(vectors)

    def dense(v):
        out = np.zeros(40)
        out[v[0]] = (1 + np.log(v[1])) * index.gain[v[0]]
        return out / np.sqrt(out @ out)

    all_ = np.stack([dense(v) for v in vectors])
    for v in vectors[:60]:
        places, cosine = index.nearest(*map(np.array, v), 7)
        value = np.round(all_ @ dense(v), 9)
        want = [i for i in np.lexsort((np.arange(6000), -value)) if value[i] > 0][:7]
        assert index.ids[places].tolist() == want and np.allclose(cosine, value[want])
    asked = [index.weight.copy(), index.weight]
    index.weight = Counting(asked[0])
    index.nearest(np.array(vectors[0][0]), np.array(vectors[0][1]), 7)
    assert index.weight.read < sum((index.first[t * index.n_blocks + index.n_blocks] - index.first[t * index.n_blocks]) for t in vectors[0][0])  # some postings of its terms were never read


class Counting(np.ndarray):
    """An array that counts the elements read from it."""

    def __new__(cls, of):
        out = np.asarray(of).view(cls)
        out.read = 0
        return out

    def __getitem__(self, at):
        self.read += len(at)
        return np.asarray(self)[at]


def test_examples_do_not_vote_on_themselves(spark):
    sc = spark.sparkContext
    index = toxicity.Index(np.array([1, 2]), np.array([1, 0]), np.array([0, 0]), np.ones(2), np.ones(2, int), np.ones(1))
    frame = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.votes(frame, sc.broadcast({"a": 0}), sc.broadcast(index), 1).collect()}
    assert got[1]["near"] == [2] and got[2]["near"] == [1] and got[1]["vote"] < 0.5 < got[2]["vote"] and got[3]["vote"] is None


def test_isotonic():
    x, y = isotonic(np.array([1.0, 2, 3, 4]), np.ones(4), np.array([0.0, 1, 0, 1]), prior=1e-9)
    assert np.allclose(x, [1, 2.5, 4]) and np.allclose(y, [0, 0.5, 1], atol=1e-6)
    assert isotonic(*[np.zeros(0)] * 3)[1].tolist() == [0.5]


def test_odd_tables(spark):
    frame, labels = labelled(spark, [], [], "toxic")
    assert toxicity.query(frame, labels).collect() == [] and quality.query(*labelled(spark, [], [], "quality")).collect() == []
    some = docs(spark, ["a b c", None])
    none = labels.where("doc_id = -1")
    assert [r["score"] for r in toxicity.query(some, none).collect()] == [0.5, 0.5] and [r["score"] for r in quality.query(some, none).collect()] == [0.5, 0.5]
    twice = docs(spark, ["fine words here", "fine words here", None], ids=[3, 3, None])
    assert len(toxicity.query(twice, labels).collect()) == 3 and len(quality.query(twice, labels.withColumn("quality", labels.toxic)).collect()) == 3


def test_words_of_one_byte_characters_need_no_pattern(monkeypatch):
    """Splitting was half of an example's cost; the words are the pattern's."""
    rng = random.Random(9)
    chars = [chr(c) for c in range(128)] * 3 + list("äÖßçÉñİΣς²½٣四﹍ _\u0307\u2028\xa0—“’") + ["AbC"] * 40
    for text in [*ODD, *("".join(rng.choice(chars) for _ in range(60)) for _ in range(400))]:
        assert toxicity.words_of(text) == re.findall(r"[^\W\d_]+", (text or "").lower())
    monkeypatch.setattr(toxicity, "WORD", None)
    assert toxicity.words_of("It's 9_A-b\tc.") == ["it", "s", "a", "b", "c"] and toxicity.words_of("für É") == ["für", "é"]


def test_nearest_over_many_blocks(monkeypatch):
    """Blocks and waves of any size give the same neighbours."""
    rng, found = np.random.default_rng(4), []
    sets = [np.unique(rng.zipf(1.4, 20) % 90) for _ in range(150)]
    terms, sizes = np.concatenate(sets), np.array([len(s) for s in sets])
    tf, gain = rng.integers(1, 4, len(terms)).astype(float), rng.random(90)
    for block, first in ((512, 4), (7, 1), (7, 4), (40, 2)):
        monkeypatch.setattr(toxicity, "BLOCK", block), monkeypatch.setattr(toxicity, "FIRST", first)
        index = toxicity.Index(np.arange(150), rng.random(150) < 0.5, terms, tf, sizes, gain)
        near = [index.nearest(s, np.ones(len(s)), k) for s in sets[:40] for k in (1, 16, 150, 200)]
        found.append([(index.ids[p].tolist(), v.tolist()) for p, v in near])
    assert all(f == found[0] for f in found)
    weights = np.zeros((150, 90))
    weights[np.repeat(np.arange(150), sizes), terms] = (1 + np.log(tf)) * gain[terms]
    weights /= np.linalg.norm(weights, axis=1)[:, None]
    for i, s in enumerate(sets[:40]):
        query = np.zeros(90)
        query[s] = gain[s]
        cosine = np.round(weights @ query / np.linalg.norm(query), 9)
        assert found[0][4 * i + 1][0] == sorted(np.flatnonzero(cosine >= 1e-9), key=lambda j: (-cosine[j], j))[:16]
