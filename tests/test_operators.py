"""Hand-computed fixtures and brute-force twins of the library's operators."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.functions import licences, model_json, models, text
from lodestone.operators import curation, evaluation, filters, ranking, sampling, tags, vectors


def values(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def ranks(spark, *lists):
    return [spark.createDataFrame([(1, i, s, r + 1) for r, (i, s) in enumerate(x)], "qid int, id string, score double, rank int") for x in lists]


def test_rank_fusion(spark):
    both = ranking.reciprocal_rank_fusion(ranks(spark, [("a", 0.9), ("b", 0.8)], [("b", 0.7), ("c", 0.6)])).orderBy("rank")
    assert values(both, "id") == [("b",), ("a",), ("c",)]
    assert [round(s, 6) for (s,) in values(both, "score")] == [round(x, 6) for x in (1 / 62 + 1 / 61, 1 / 61, 1 / 62)]
    alone = ranking.reciprocal_rank_fusion(ranks(spark, [("a", 0.9), ("b", 0.8)], [])).orderBy("rank")
    assert values(alone, "id", "score") == [("a", 0.9), ("b", 0.8)]


def test_retrieval_metrics(spark):
    hits = spark.createDataFrame([(1, "x", 1), (1, "z", 2), (1, "y", 3)], "qid int, id string, rank int")
    relevant = spark.createDataFrame([(1, "x"), (1, "y"), (2, "q")], "qid int, id string")
    rows = {r["qid"]: r for r in evaluation.retrieval_metrics(hits, relevant, (3, 5)).collect()}
    assert rows[1]["ndcg_3"] == round((1 + 1 / 2) / (1 + 1 / math.log2(3)), 6) and rows[1]["p_5"] == round(2 / 3, 6) and rows[1]["mrr"] == 1.0
    assert rows[2]["mrr"] == 0.0 and rows[2]["p_3"] == 0.0 and rows[2]["hit_5"] == 0


@pytest.mark.parametrize(("n", "count"), [(375, 1), (376, 2), (712, 2), (713, 3), (1, 0), (0, 0)])
def test_chunk_boundaries(spark, n, count):
    page = spark.createDataFrame([(1, 1, " ".join(f"w{i}" for i in range(n)))], "d int, p int, t string")
    chunks = text.chunk_pages(page, "d", "p", "t").collect()
    assert len(chunks) == count and all(len(c["chunk"].split()) <= 375 for c in chunks)
    if n > 375:
        assert chunks[1]["chunk"].split()[0] == "w337"


def test_chunks_count_over_pages_and_skip_blank(spark):
    rows = spark.createDataFrame([(1, 2, "b" * 50), (1, 1, "a b " * 30), (1, 3, " \n "), (1, 4, None)], "d int, p int, t string")
    assert values(text.chunk_pages(rows, "d", "p", "t").orderBy("chunk_index"), "page", "chunk_index") == [(1, 0), (2, 1)]


def decide(spark, clip, votes, vlm=0.9, passes=None):
    s = tags.conflicting(F.lit("gothic"), F.lit("house"), F.lit(clip), F.lit(0.5), F.lit(votes).cast("int"), F.lit(votes).cast("int"))
    return one(spark, tags.decision(s, F.lit(vlm), F.lit(clip), F.lit(passes).cast("boolean")))


def test_tag_decision(spark):
    assert decide(spark, 0.10, 1) == "quarantined" and decide(spark, 0.10, None) == "provisional" and decide(spark, 0.10, 2) == "provisional"
    assert decide(spark, 0.25, None, 0.6) == "verified" and decide(spark, 0.24, None, 0.6) == "provisional" and decide(spark, 0.2, 6, 0.6, True) == "verified"


def test_licences(spark):
    cases = {"CC-BY-4.0": True, "CC BY-NC 2.0": False, "cc0": True, "http://creativecommons.org/licenses/by-nd/4.0/": False, "": False, None: False, "CC-BY-SA-3.0 DE": True, "CC-BY-4.0-NonCommercial": False, "foundation": False, "http://creativecommons.org/licenses/by/2.0/": True}
    df = spark.createDataFrame([(k,) for k in cases], "l string")
    assert dict(values(df.select("l", licences.allowed(F.col("l")).alias("ok")), "l", "ok")) == cases
    assert one(spark, licences.allowed(F.lit("CC-BY-4.0-NonCommercial"), strict=False)) is True
    nc = F.array(F.lit("http://creativecommons.org/licenses/by-nc/4.0/"))
    assert one(spark, licences.from_rights(nc)) == "Unknown" and one(spark, licences.from_rights(nc, strict=False)) == "CC-BY-4.0"
    assert one(spark, licences.rights_accepted(nc)) is False and one(spark, licences.rights_accepted(nc, strict=False)) is True


def test_wildcards_in_filters(spark):
    assert one(spark, filters.contains_any(F.lit("Mixed use"), ["mixed_use"])) is True
    assert one(spark, filters.contains_any(F.lit(None).cast("string"), ["x"])) is False


def test_relative_floor_and_penalty(spark):
    rows = spark.createDataFrame([(1, i, s, r + 1) for r, (i, s) in enumerate([("a", 0.9), ("b", 0.71), ("c", 0.69)])], "qid int, id string, score double, rank int")
    assert sorted(values(filters.relative_floor(rows, 0.1), "id")) == [("a",), ("b",)]
    two = spark.createDataFrame([(1, "p", 0.80, 1, "provisional"), (1, "v", 0.77, 2, "verified")], "qid int, id string, score double, rank int, tag_status string")
    assert values(ranking.penalised(two).orderBy("rank"), "id", "score") == [("v", 0.77), ("p", 0.76)]


def test_model_json(spark):
    schema = "a array<int>, b string"
    assert one(spark, model_json.lenient(F.lit('{"a": [1,],}'), schema))["a"] == [1]
    assert one(spark, model_json.lenient(F.lit('{"a": [1], "b": "x\ny\tz"}'), schema))["b"] == "x\ny\tz"
    for raw in ('{"b": "q"}', '```json\n{"b": "q"}\n```', '<think>{"b": 1}</think>{"b": "q"}', 'so {"b": "q"} it is'):
        assert one(spark, model_json.parsed(F.lit(raw), schema))["b"] == "q"
    for raw in ("nothing", "{broken", "", None):
        assert one(spark, model_json.parse_error(F.lit(raw).cast("string"), schema)) is True
    assert one(spark, model_json.no_sections(model_json.sections(F.lit("{}")))) is True


def test_texts(spark):
    assert one(spark, text.latin1(F.lit("a—b…“c” ☃ é"))) == 'a--b..."c" ? é'
    assert one(spark, text.style_from_file_name(F.lit("Persian-IranianArchitecture_640x480-ezgif.com"))) == "persian architecture"
    assert one(spark, text.rerooted(F.lit("/x/images/a/images/b.jpg"))) == "/data/images/a/images/b.jpg"
    assert one(spark, text.storage_path(F.lit(""), F.lit("abcd"))) == "unknown/ab/abcd.jpg"
    assert one(spark, text.flattened(F.try_parse_json(F.lit('{"a": ["x"], "b": ["y", "z"]}')))) == ["x", "y", "z"]
    assert one(spark, text.context_block(text.line("Name", F.lit("")))) == "No artifact data available."


def test_knn_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.integers(-3, 4, (300, 5)).astype(float)  # many ties
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(999, None)], "id int, vec array<float>").repartition(5)
    asked = df.where("id < 20").select(F.col("id").alias("qid"), "vec")
    want = {(q, r + 1): (i, float(v[q] @ v[i])) for q in range(20) for r, i in enumerate(np.lexsort((np.arange(300), -(v @ v[q])))[:7])}
    for batch in (8192, 6):
        got = vectors.knn(asked, df, 7, batch=batch).collect()
        assert {(r["qid"], r["rank"]): (r["id"], r["score"]) for r in got} == want
    assert vectors.knn(asked, df.limit(3), 7).where("rank > 3").count() == 0 and vectors.knn(asked.limit(0), df, 3).count() == 0


def test_mmr_equals_a_plain_loop(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((25, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rel = np.round(v @ v[0], 6)
    chosen = [int(np.argmax(rel))]
    while len(chosen) < 6:
        best = max((i for i in range(25) if i not in chosen), key=lambda i: (round(0.7 * rel[i] - 0.3 * max(v[i] @ v[j] for j in chosen), 12), rel[i], -i))
        chosen.append(best)
    df = spark.createDataFrame([(1, i, float(rel[i]), v[i].tolist()) for i in range(25)], "qid int, id int, score double, vec array<double>")
    assert [i for (i,) in values(ranking.mmr(df, 6).orderBy("rank"), "id")] == chosen


def test_non_max_suppression(spark):
    rows = [(1, 0, 0, 10, 10, 0.9, 1), (1, 1, 1, 11, 11, 0.8, 2), (1, 50, 50, 60, 60, 0.7, 3), (1, 0, 0, 10, 10, 0.1, 4), (2, 0, 0, 0, 0, 0.5, 1)]
    df = spark.createDataFrame([(i, *map(float, b), s, r) for i, *b, s, r in rows], "image int, x1 double, y1 double, x2 double, y2 double, score double, region int")
    assert sorted(values(ranking.non_max_suppression(df), "image", "region")) == [(1, 1), (1, 3), (2, 1)]


def test_hamming_bands_equal_the_full_join(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    hashes = [(i, base[rng.randrange(40)] ^ sum(1 << b for b in rng.sample(range(64), rng.choice([0, 1, 5, 9, 10, 11])))) for i in range(300)]
    df = spark.createDataFrame([(i, f"{h:016x}") for i, h in hashes], "k int, h string")
    want = {(a, b, (x ^ y).bit_count()) for a, x in hashes for b, y in hashes if a < b and (x ^ y).bit_count() < 10}
    assert {tuple(r) for r in curation.hamming_pairs(df, "k", "h").collect()} == want
    first = {r["k"]: r["near_duplicate_of"] for r in curation.near_duplicate_of(df, "k", "h").collect()}
    assert first == {b: min(a for a, c, _ in want if c == b) for _, b, _ in want}
    near = {r["k"]: r["distance"] for r in curation.near_duplicate_of(df, "k", "h", mode="nearest").collect()}
    assert near == {b: min(d for _, c, d in want if c == b) for _, b, _ in want}


def test_calibration_error_by_loop(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(2), 1, rng.random()) for _ in range(500)] + [(1, 1, 1.0), (0, 1, 1 / 15)]
    want = 0.0
    for k in range(15):
        cell = [(t == p, c) for t, p, c in rows if math.ceil(c * 15) == k + 1]
        if cell:
            want += len(cell) / len(rows) * abs(sum(x for x, _ in cell) / len(cell) - sum(c for _, c in cell) / len(cell))
    df = spark.createDataFrame(rows, "truth int, pred int, conf double")
    assert evaluation.expected_calibration_error(df).first()["ece"] == pytest.approx(want, abs=1e-6)
    assert sum(r["n"] for r in evaluation.reliability(df).collect()) == len(rows) - 1  # confidence 1 falls out


def test_temperature(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(4000):
        x = rng.gauss(0, 2)
        rows.append((int(rng.random() < 1 / (1 + math.exp(-x))), 0.0, 3 * x))  # logits three times too large
    t = evaluation.fit_temperature(spark.createDataFrame(rows, "truth int, l0 double, l1 double")).first()["temperature"]
    assert 2.6 < t < 3.4


def test_samples(spark):
    df = spark.createDataFrame([(i, i % 7 if i < 700 else 99) for i in range(701)], "id int, label int")
    split = sampling.stratified_split(df, "label", "id")
    n = {(r["label"], r["part"]): r["count"] for r in split.groupBy("label", "part").count().collect()}
    assert n[(0, "val")] == 20 and n[(0, "train")] == 80 and n[(99, "val")] == n[(99, "train")] == 1
    over = sampling.oversampled(df, "label", "id", 30)
    assert {r["count"] for r in over.groupBy("label").count().collect()} == {30}
    both = sampling.guaranteed_split(df, "label", "id", 50, 20)
    assert both.select("id").distinct().count() == both.count() == 70 and {r["part"]: r["count"] for r in both.groupBy("part").count().collect()} == {"train": 50, "test": 20}
    clusters = spark.createDataFrame([("a", 0), ("a", 1), ("b", 2), ("b", 3)], "cluster string, label int")
    batches = sampling.hard_negative_batches(df, "label", "id", clusters, 10, 8).collect()
    assert len(batches) == 80 and all(len({r["slot"] for r in batches if r["batch"] == b}) == 8 for b in range(10))
    for b in range(10):
        hard = {r["label"] for r in batches if r["batch"] == b and r["slot"] < 4}
        assert hard <= {0, 1} or hard <= {2, 3}


def test_lookups_and_updates(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    asked = spark.createDataFrame([(7, [2, 1, 2])], "q int, ids array<int>")
    got = curation.ordered_lookup(asked, rows, "ids", "id").orderBy("position")
    assert values(got, "name", "label") == [("b", "IMG-1"), ("a", "IMG-2"), ("b", "IMG-3")]
    missing = spark.createDataFrame([(7, [2, 5])], "q int, ids array<int>")
    with pytest.raises(Exception, match="not found: 5"):
        curation.ordered_lookup(missing, rows, "ids", "id").collect()
    assert curation.ordered_lookup(missing, rows, "ids", "id", strict=False).count() == 1
    with pytest.raises(Exception, match="twice"):
        curation.coalesce_update(rows, rows.union(rows), ["id"], ["name"]).collect()
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src int, dst int")
    assert sorted(values(curation.reachable(edges, spark.createDataFrame([(1,)], "node int"), 2), "node", "depth")) == [(1, 0), (2, 1), (3, 2)]


def test_default_embedder_is_of_unit_length(spark):
    v = one(spark, models.bag_of_words(F.lit("a b b c")))
    assert sum(x * x for x in v) == pytest.approx(1.0) and sum(models_ for models_ in one(spark, models.bag_of_words(F.lit("")))) == 0.0


def test_knn_keeps_k_rows_of_a_query_in_a_task():
    rng = np.random.default_rng(3)
    vec, asked = np.round(rng.normal(size=(5000, 8)), 1), np.round(rng.normal(size=(700, 8)), 1)  # rounded: many ties
    best = vectors.Best(asked, 7, 6)
    for at in range(0, 5000, 300):
        best.add(pa.array(range(at, min(at + 300, 5000))[::-1]), pa.array(vec[at : at + 300][::-1].tolist()))
    batch = next(best.rows())
    assert len(batch) == 7 * 700
    score = np.round(asked @ vec.T, 6) + 0.0
    want = {(i, j) for i in range(700) for j in np.lexsort((np.arange(5000), -score[i]))[:7].tolist()}
    assert set(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)) == want


def test_near_duplicates_of_one_popular_hash_and_any_number_of_bands(spark, monkeypatch):
    rng = random.Random(4)
    hashes = [rng.getrandbits(64) for _ in range(120)]
    hashes += [h ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 12))) for h in hashes[:100]]
    rows = list(enumerate([*hashes[:50], *[hashes[0]] * 3000, *hashes[50:]]))
    rng.shuffle(rows)
    df = spark.createDataFrame([(k, f"{h:016x}") for k, h in rows], "id long, phash string")
    for mode in ("first", "nearest"):
        want, seen = {}, {}
        for k, h in sorted(rows):
            near = [((a,) if mode == "first" else ((h ^ x).bit_count(), a), a, (h ^ x).bit_count()) for x, a in seen.items() if (h ^ x).bit_count() < 10]
            if near:
                want[k] = min(near)[1:]
            seen.setdefault(h, k)
        for n in (3, 4, 5):
            monkeypatch.setattr(curation, "band_count", lambda rows, below, n=n: n)
            assert {r["id"]: (r["near_duplicate_of"], r["distance"]) for r in curation.near_duplicate_of(df, "id", "phash", mode=mode).collect()} == want
    monkeypatch.undo()
    assert curation.band_count(10_000, 10) == 5 and curation.band_count(10**8, 10) == 3


def test_places_of_a_class_in_parts_are_those_of_a_whole_class(spark):
    df = spark.range(9000).selectExpr("id", "if(id % 3 = 0, null, if(id < 6000, 'hot', 'cold')) AS label")
    got = sampling.placed(df, "label", 5, "id").collect()
    by = {}
    for r in df.collect():
        by.setdefault(r["label"], []).append((hashlib.md5(f"5:{r['id']}".encode()).hexdigest(), r["id"]))
    want = {i: (n, len(rows)) for rows in by.values() for n, (_, i) in enumerate(sorted(rows), 1)}
    assert {r["id"]: (r["place"], r["size"]) for r in got} == want


def test_second_pass_is_judged_anew(spark):
    first = spark.createDataFrame([(i, "Baroque", "villa", 0.7, "quarantined") for i in range(1, 6)], "id long, style_primary string, building_type string, confidence double, tag_status string")
    second = spark.createDataFrame([(1, "Gothic"), (2, "Gothic"), (3, "Gothic"), (4, None)], "id long, style_primary string")
    merged = tags.second_pass(first, second, "id", ["style_primary"])
    clip = spark.createDataFrame([(1, {"style:Gothic": 0.3}), (2, {"style:Gothic": 0.05}), (4, {"style:Baroque": 0.2}), (5, {"style:Baroque": 0.9})], "id long, clip map<string,double>")
    votes = spark.createDataFrame([(1, 0, 5, False), (2, 1, 5, False), (3, 7, 5, True), (5, 9, 9, True)], "id long, style_votes long, building_type_votes long, style_pass boolean")
    out = {r["id"]: (r["style_primary"], r["final"], r["tag_status"], r["stripped"]) for r in tags.rejudged(merged, clip, votes).collect()}
    assert out == {
        1: ("Gothic", True, "verified", []),
        2: ("Gothic", True, "quarantined", ["style:Gothic"]),
        3: ("Gothic", True, "verified", []),
        4: ("Baroque", True, "provisional", []),
        5: ("Baroque", False, "quarantined", []),
    }
