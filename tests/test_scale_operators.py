"""Operators that cut hot groups and large sides into parts, against plain loops."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.operators import evaluation, filters, ranking, sampling, vectors


def test_blocks_against_blocks_equal_brute_force_with_filters(spark):
    rng = np.random.default_rng(5)
    v = rng.integers(-3, 4, (260, 4)).astype(float)  # many ties
    rows = [(i, x.tolist(), 1900 + i % 50, ["Glass", "steel", "mixed use"][i % 3], ["fr", "EN", None][i % 7 % 3]) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "image_id long, vec array<float>, year int, kind string, land string").repartition(4)
    known = filters.facets(year="year", types=(F.col("kind"),), typologies=F.array(F.col("kind")), country_="land")
    maps = [None, {}, {"period": ["1910", "1930"]}, {"typology": ["mixed_use", "GLASS"], "country": ["en"]}, {"country": ["xx"]}, {"period": ["1910"], "unknown": ["a"], "country": []}, {"typology": ["steel", None]}]

    def passes(i, m):
        _, _, year, kind, land = rows[i]
        ok = "period" not in (m or {}) or len(m["period"]) != 2 or 1910 <= year <= 1930
        kinds = [t for t in (m or {}).get("typology", []) if t]
        ok = ok and (not kinds or any(t.lower().replace("_", " ") in kind.lower() for t in kinds))
        return ok and (not (m or {}).get("country") or (land or "").lower() == m["country"][0])

    queries = spark.createDataFrame([(q, v[q].tolist(), maps[q % len(maps)]) for q in range(70)], "qid long, vec array<float>, filters map<string,array<string>>").repartition(3)
    want = {}
    for q in range(70):
        mine = [i for i in range(260) if passes(i, maps[q % len(maps)])]
        for r, i in enumerate(sorted(mine, key=lambda i: (-float(v[q] @ v[i]), i))[:6]):
            want[q, r + 1] = (i, float(v[q] @ v[i]))
    asked, told = filters.compiled(queries, df, known)
    told = told.select(F.col("image_id").alias("id"), "vec", "bits")
    for options in ({}, {"batch": 5}):
        got = vectors.knn(asked, told, 6, filtered=True, cells=40, **options)
        assert {(r["qid"], r["rank"]): (r["id"], r["score"]) for r in got.collect()} == want
    none = vectors.knn(asked, told.limit(0), 6, filtered=True, batch=5)
    assert none.count() == 0
    with pytest.raises(ValueError, match="predicates"):
        filters.compiled(spark.range(5000).select(F.create_map(F.lit("country"), F.array(F.col("id").cast("string"))).alias("filters")), df, known)


def test_collections_drop_empty_ones(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0], "a" if i % 2 else "b") for i in range(9)], "image_id long, vec array<double>, land string")
    asked = spark.createDataFrame([("x", [1.0, 0.0], {"country": ["a"]}), ("y", [-1.0, 0.0], {"country": ["B"]}), ("z", [1.0, 0.0], {"country": ["c"]})], "qid string, vec array<double>, filters map<string,array<string>>")
    got = ranking.collections(asked, rows.withColumnRenamed("image_id", "id"), rows, filters.facets(country_="land"), 2)
    assert sorted((r["qid"], r["rank"], r["id"]) for r in got.collect()) == [("x", 1, 7), ("x", 2, 5), ("y", 1, 0), ("y", 2, 2)]


def test_block_join_reads_each_side_in_blocks_and_never_collects(spark):
    v = spark.range(400).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("vec"))
    plan = vectors.knn(v.withColumnRenamed("id", "qid"), v, 2, batch=10)._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_quantiles_equal_numpy_through_narrow_ranges(spark):
    rng = np.random.default_rng(6)
    groups = {"a": rng.exponential(1, 3000), "b": np.round(rng.normal(size=500), 1), "c": np.array([4.0]), "d": np.full(2000, 7.5), None: np.append(rng.normal(size=900) * 1e-9, 1e6)}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("a", None), ("b", float("nan")), ("e", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    for share in (0.0, 0.1, 0.5, 0.95, 1.0):
        got = {r["g"]: r["quantile"] for r in evaluation.quantiles(df, "x", share, "g", bins=16, most=20).collect()}
        assert set(got) == set(groups) and all(got[g] == pytest.approx(np.quantile(xs, share), rel=1e-12) for g, xs in groups.items())
    whole = evaluation.quantiles(df, "x", 0.3, bins=4, most=1).collect()
    assert [r["quantile"] for r in whole] == [pytest.approx(np.quantile(np.concatenate(list(groups.values())), 0.3), rel=1e-12)]
    assert evaluation.quantiles(df.limit(0), "x", 0.5).count() == 0


def test_numbers_of_a_hot_group_come_from_range_parts(spark):
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.8 else rng.choice(["a", "b", None]), rng.randrange(500), i) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, t int, id int").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small tables in many parts
    try:
        got = {r["id"]: (r["at"], r["total"]) for r in sampling.numbered(df, "g", ["t", "id"]).collect()}
        tasks = df.orderBy("g", "t", "id").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    by = {}
    for g, t, i in rows:
        by.setdefault(g, []).append((t, i))
    want = {i: (n, len(xs)) for xs in by.values() for n, (_, i) in enumerate(sorted(xs))}
    assert got == want
    assert len(tasks) > 1 and max(r["count"] for r in tasks) < 0.5 * len(rows)  # no task holds the hot group


def plain_choice(boxes, iou, least, most):
    """Places by a plain loop over one image's (score, region, box)."""
    def over(a, b):
        both = max(min(a[2], b[2]) - max(a[0], b[0]), 0) * max(min(a[3], b[3]) - max(a[1], b[1]), 0)
        size = lambda x: max(x[2] - x[0], 0) * max(x[3] - x[1], 0)
        return both / max(size(a) + size(b) - both, 1e-9)

    kept = []
    for score, region, box in sorted(boxes, key=lambda x: (-x[0], x[1], x[2])):
        if score >= least and len(kept) < most and all(over(box, b) < iou for _, b in kept):
            kept.append((region, box))
    return [region for region, _ in kept]


def test_suppression_equals_a_plain_loop(spark):
    rng = random.Random(8)
    rows = []
    for image in [None, *range(60)]:
        for region in range(rng.choice([1, 3, 40, 150])):
            x, y = rng.randrange(60), rng.randrange(60)
            w, h = rng.choice([0, 8, 10, 12, 30]), rng.choice([8, 10, 12])
            rows.append((image, float(x), float(y), float(x + w), float(y + h), rng.choice([0.1, 0.3, 0.3, 0.5, 0.9, rng.random()]), region))
    df = spark.createDataFrame(rows, "image int, x1 double, y1 double, x2 double, y2 double, score double, region int").repartition(6)
    for iou, most in ((0.45, 20), (0.2, 4)):
        got = {}
        for r in sorted(ranking.non_max_suppression(df, iou, 0.2, most).collect(), key=lambda r: r["place"]):
            got.setdefault(r["image"], []).append(r["region"])
        want = {i: plain_choice([(s, g, (a, b, c, d)) for j, a, b, c, d, s, g in rows if j == i], iou, 0.2, most) for i in {r[0] for r in rows}}
        assert got == {i: w for i, w in want.items() if w}


def test_suppression_goes_on_over_batches():
    rng = np.random.default_rng(9)
    start = rng.integers(0, 80, (3000, 2)).astype(float)
    box = np.hstack([start, start + rng.integers(5, 20, (3000, 2))])
    images = pa.array(np.repeat([1, 2, 3], [50, 2900, 50]))
    state, got = ranking.Suppression(0.3, 400), []
    for at in range(0, 3000, 333):
        rows, places = state.add(images[at : at + 333], box[at : at + 333])
        got += [(images[int(r) + at].as_py(), int(r) + at, int(p)) for r, p in zip(rows, places, strict=True)]
    for image, lo, hi in ((1, 0, 50), (2, 50, 2950), (3, 2950, 3000)):
        want = plain_choice([(1.0, i, tuple(box[i])) for i in range(lo, hi)], 0.3, 0, 400)
        assert [r for i, r, _ in got if i == image] == want and [p for i, _, p in got if i == image] == list(range(1, len(want) + 1))


def test_label_scores_stay_in_the_batch(spark):
    rng = np.random.default_rng(10)
    v, m = rng.integers(-2, 3, (90, 3)).astype(float), rng.integers(-2, 3, (7, 3)).astype(float)
    names = [f"l{i}" for i in range(7)]
    rows = spark.createDataFrame([(i, x.tolist(), names[i % 7] if i % 10 else "none") for i, x in enumerate(v)] + [(999, None, "l1")], "id int, vec array<double>, own string").repartition(4)
    labels = spark.createDataFrame([(n, x.tolist()) for n, x in zip(names, m, strict=True)][::-1], "label string, vec array<double>")
    s = v @ m.T
    p = np.exp(s - s.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    assert {(r["id"], r["label"]): r["cos"] for r in vectors.class_scores(rows, labels).collect()} == {(i, names[j]): s[i, j] for i in range(90) for j in range(7)}
    got = {r["id"]: (r["label"], r["conf"]) for r in vectors.zero_shot(rows, labels, 0.3, 1.0, ("l2",)).collect()}
    assert got == {i: (None if p[i].max() < 0.3 or s[i].argmax() == 2 else names[s[i].argmax()], pytest.approx(p[i].max())) for i in range(90)}
    order = [sorted(range(7), key=lambda j: (-s[i, j], j)) for i in range(90)]
    assert {r["id"]: (r["styles"], r["confidence"]) for r in vectors.top_styles(rows, labels, 3, 1.0).collect()} == {i: (",".join(names[j] for j in o[:3] if s[i, j] >= 1), s[i, o[0]]) for i, o in enumerate(order) if s[i, o[0]] >= 1}
    got = {r["id"]: (r["rank"], r["p"]) for r in vectors.own_label(rows, labels, scale=1.0).collect()}
    assert got == {i: (order[i].index(i % 7) + 1, pytest.approx(p[i, i % 7])) if i % 10 else (None, None) for i in range(90)}
    far = spark.createDataFrame([("l0", "l1"), ("l0", "l2"), ("l3", "zz"), ("l4", "l0")], "own_class string, negative string")
    got = {r["id"]: r["margin"] for r in vectors.hard_negative_margins(rows, labels, far).collect()}
    assert got == {i: s[i, 0] - max(s[i, 1], s[i, 2]) if i % 7 == 0 else s[i, 4] - s[i, 0] for i in range(90) if i % 10 and i % 7 in (0, 4)}
    plan = vectors.zero_shot(rows, labels)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Window" not in plan
    assert vectors.zero_shot(rows, labels.limit(0)).count() == 0
