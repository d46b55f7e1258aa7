import math
import random

from pyspark.sql import functions as F

from lodestone.llm import topk


def brute(rows, k=5):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {(i, tuple(v)) for i, v in good if i % 50 == 0}:
        near = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q and len(w) == len(v))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(near)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, score int, v int").repartition(3)


def run(spark, rows, **options):
    found = topk.top_k(frame(spark, rows), F.col("vec_id") % 50 == 0, **options).collect()
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found)


def test_equals_brute_force_with_ties_and_odd_vectors(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-1.0, -0.25, 0.0, 0.5, 1.0]) for _ in range(6)]) for i in range(900)]
    rows += [(1000, None), (1001, []), (1002, [None] * 6), (1050, [float("nan")] * 6), (1051, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (1100, [1.0, 2.0]), (1101, [3.0, 4.0]), (50, rows[50][1])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, batch=4) == brute(rows)  # several batches of queries


def test_few_candidates_and_empty_table(spark):
    assert run(spark, [(0, [1.0, 0.0]), (3, [0.5, 0.5])]) == [(0, 1, 3, 256 * 128)]
    assert run(spark, [(0, [1.0])]) == [] and run(spark, []) == []


def test_large_components_stay_exact(spark):
    rows = [(0, [2.0**20, -(2.0**20)]), (1, [2.0**20, 1.0]), (2, [-(2.0**20), 2.0**20]), (3, [2.0**20, 0.0])]
    assert run(spark, rows) == brute(rows)
