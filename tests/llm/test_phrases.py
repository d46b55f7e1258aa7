import random
import re
from collections import Counter

import numpy as np

from lodestone.llm import phrases
from tests.compare import connect, differences
from tests.llm.helpers import DOCS, ODD


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, None, None, 0.5, "x", 1, 2, 3) for i, (lang, t) in enumerate(rows)], DOCS).repartition(3) if rows else spark.createDataFrame([], DOCS)


def brute(rows, least, longest=5, first=2000, percent=100):
    n, f = Counter(), Counter()
    for lang, text in rows:
        text = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(words)
            for i in range(len(words)):
                for m in range(1, longest + 1):
                    if i + m <= len(words):
                        f[lang or "und", tuple(words[i : i + m])] += 1
    kept = {k: c for k, c in f.items() if c >= least and len(k[1]) > 1}
    out = {}
    for (lang, p), a in kept.items():
        if any(m == lang and len(q) > len(p) and 100 * c >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (m, q), c in kept.items()):
            continue
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:first]))


def corpus(seed=4):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["é", "Zed", "the", "the", "OF", "a-b"]
    fixed = ["new york city hall opens", "the the the the the the", "out of the box", "Ångström unit cell"]
    rows = [("en", t) for t in ODD] + [(None, "out of the box. out\tof   the box"), ("und", "out of the box")]
    for lang in ("en", "de", None):
        for _ in range(80):
            parts = [rng.choice(fixed) if rng.random() < 0.25 else rng.choice(words) for _ in range(rng.randrange(60))]
            rows.append((lang, "".join(p + rng.choice([" ", " ", " ", ", ", "\n", "  ", ".", "\t"]) for p in parts)))
    return rows


def taken(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def test_equals_brute_force(spark):
    rows = corpus()
    for least, options in ((5, {}), (8, {"first": 3, "percent": 80}), (5, {"longest": 3, "most_ranks": 0})):
        assert taken(phrases.collocations(frame(spark, rows), least=least, **options)) == brute(rows, least, **{k: v for k, v in options.items() if k != "most_ranks"})


def test_dense_and_sparse_tiles_count_alike(monkeypatch):
    monkeypatch.setattr(phrases, "TILE", 8)
    monkeypatch.setattr(phrases, "FILLED", 40)
    monkeypatch.setattr(phrases, "DENSE", 3)
    monkeypatch.setattr(phrases, "HELD", 50)
    rng = np.random.default_rng(1)
    tiles, want, got = phrases.Tiles(), Counter(), Counter()
    for _ in range(6):
        a, b = (np.minimum(rng.geometric(0.08, 2000), 2**31).astype(np.int64) for _ in "ab")
        b[:5] = 2**31 + 7
        want.update(zip(a.tolist(), b.tolist(), strict=True))
        tiles.add(a, b)
        for batch in tiles.taken(False):
            for r in batch.to_pylist():
                got[r["a"], r["b"]] += r["f"]
    assert len(tiles.dense) == 3
    for batch in tiles.taken(True):
        for r in batch.to_pylist():
            got[r["a"], r["b"]] += r["f"]
    assert got == want


def test_ranks_follow_the_order_over_range_parts(spark):
    rows = spark.createDataFrame([(i * 7919 % 1000, f"w{i}") for i in range(1000)], "f long, word string").repartition(5)
    got = phrases.ranked(rows, "f", "word").collect()
    assert [r["id"] for r in sorted(got, key=lambda r: (r["f"], r["word"]))] == list(range(1, 1001))


def test_products_beyond_64_bits_are_exact(spark):
    a, left, n = 3 * 10**12 + 7, 4 * 10**12 + 9, 9 * 10**14 + 11
    got = phrases.best(spark.createDataFrame([("en", "x y", a, [left, a], [left + 2, a], n)], "lang string, phrase string, f long, begin array<long>, end array<long>, n long"), 10).collect()[0]
    assert (got["score"], got["l"], got["r"]) == (1000 * a * n // (left * (left + 2)), left, left + 2)


def test_odd_tables(spark):
    assert phrases.collocations(frame(spark, [])).collect() == []
    assert phrases.collocations(frame(spark, [(None, None), ("en", ""), ("en", "... ,,")]), least=1).collect() == []


def test_query_equals_its_sql(spark):
    from lodestone.llm.queries import ORACLES, op11_phrases

    sf = "/root/testdata/sf0.001"
    found = op11_phrases(spark, sf)
    assert differences(found, connect(sf), ORACLES["op11_phrases"]) is None


def test_a_task_holds_little_at_once(monkeypatch):
    """A batch of many ranks goes in pieces, cells have 32 bits, and a task that counted more than they hold gives them on."""
    assert phrases.PIECE <= 1 << 18
    monkeypatch.setattr(phrases, "TILE", 8), monkeypatch.setattr(phrases, "COUNTED", 500)
    rng = np.random.default_rng(3)
    tiles, want, got = phrases.Tiles(), Counter(), Counter()
    for filled in (40, 10**6, 40, 40):  # by bincount and one by one
        monkeypatch.setattr(phrases, "FILLED", filled)
        a, b = (np.minimum(rng.zipf(1.5, 200), 40) for _ in "ab")
        tiles.add(a, b)
        assert all(t.dtype == np.uint32 for t in tiles.dense.values())
        want.update(zip(a.tolist(), b.tolist(), strict=True))
        for batch in tiles.taken(False):
            for x, y, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                got[x, y] += n
    assert tiles.counted == 200 and sum(got.values()) == 600
    for batch in tiles.taken(True):
        for x, y, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            got[x, y] += n
    assert got == want and not tiles.dense
