"""Steps whose memory or time must not grow faster than their input, held at small sizes with small bounds."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.llm import common
from lodestone.operators import curation, rag, vectors
from lodestone.sources import named_files, shared, sinks
from tests.test_streams_and_models import changes


def test_close_hashes_try_errors_inside_groups(spark, monkeypatch):
    rng = random.Random(6)
    base = [rng.getrandbits(44) << 20 for _ in range(30)]  # the same bits in the last band: one group holds all
    hashes = sorted({b ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(12))) for b in base for _ in range(12)})
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    want = {(x, y, ((x ^ y) & (1 << 64) - 1).bit_count()) for a in hashes for b in hashes for x, y in [(signed(a), signed(b))] if x < y and (a ^ b).bit_count() < 10}
    df = spark.createDataFrame([(signed(h),) for h in hashes], "h long")
    for group, n in ((1 << 17, 3), (16, 4), (1, 5)):
        monkeypatch.setattr(curation, "GROUP", group)
        monkeypatch.setattr(curation, "CANDIDATES", 50)
        monkeypatch.setattr(curation, "band_count", lambda rows, below, n=n: n)
        found = curation.close_hashes(df, 10)
        assert len(found._jdf.queryExecution().toString()) < 200_000  # no plan of thousands of errors, nor a row for each
        assert {tuple(r) for r in found.collect()} == want
    assert curation.close_hashes(df.limit(0), 10).count() == 0


def test_queries_joined_from_the_vectors_meet_them_in_blocks(spark):
    v = spark.range(60).select("id", F.array((F.col("id") % 7).cast("double"), (F.col("id") % 5).cast("double")).alias("vec"))
    ids = spark.range(0, 60, 3).withColumnRenamed("id", "qid")
    asked = ids.join(v, ids.qid == v.id).select("qid", "vec")
    rows = lambda df: {tuple(r) for r in df.select("qid", "id", "score", "rank").collect()}
    assert rows(vectors.knn(asked, v, 4, batch=5)) == rows(vectors.knn(asked, v, 4))


def test_rough_scores_lose_nothing(monkeypatch):
    rng = np.random.default_rng(8)
    for name, scale in (("BLOCK", 16), ("ROWS", 64), ("CELLS", 640)):
        monkeypatch.setattr(vectors, name, scale)
    for vec, asked in ((1 + rng.normal(size=(500, 8)) * 1e-6, 1 + rng.normal(size=(40, 8)) * 1e-6), (np.zeros((500, 8)), rng.normal(size=(40, 8))), (rng.normal(size=(500, 8)) * 1e30, rng.normal(size=(40, 8)) * 1e30)):
        best = vectors.Best(asked, 7, 6)
        for at in range(0, 500, 150):
            best.add(pa.array(range(at, min(at + 150, 500))[::-1]), pa.array(vec[at : at + 150][::-1].tolist()))
        score = np.round(np.einsum("qd,vd->qv", asked, vec), 6) + 0.0
        want = {(i, j) for i in range(40) for j in np.lexsort((np.arange(500), -score[i]))[:7].tolist()}
        got = next(best.rows())
        assert set(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True)) == want


def test_records_are_followed_in_groups_of_keys(spark, tmp_path):
    keys = [f"k{i}" for i in range(40)]
    records, outputs = [[(k, i % 5, None) for i, k in enumerate(keys)]], [[(k, 20, "a") for k in keys[::2]] + [("later", 59, None)]]
    got = changes(spark, str(tmp_path), records, outputs, tries=1, groups=3)
    assert spark.read.format("statestore").load(f"{tmp_path}/c").count() <= 3  # not a row, and a call of Python, for each key
    for i, k in enumerate(keys):
        told = [(i % 5, "processing", 0, None), (i % 5 + 10, "requeued", 1, None)]
        assert got[k] == told + ([(20, "ready", 1, "a")] if i % 2 == 0 and i % 5 else [(i % 5 + 20, "ready", 1, "a")] if i % 2 == 0 else [(i % 5 + 20, "failed", 1, None)])


def test_citations_sort_snippets_only(spark):
    hits = spark.range(20).select((F.col("id") % 4).alias("qid"), F.col("id").alias("rank"), F.lit("T").alias("title"), F.col("id").alias("page"), F.repeat(F.lit("x"), 300).alias("text"))
    found = rag.citations(hits, hits.select("qid", F.lit("no").alias("answer")).distinct())
    plan = found._jdf.queryExecution().analyzed().toString()
    assert plan.rindex("substring(") > plan.rindex("Window ")  # made below every window
    assert {len(r["snippet"]) for r in found.collect()} == {241}


def test_replaced_rows_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    rows = []
    monkeypatch.setattr(sinks, "dealt", lambda df, key, n: rows.append(n) or shared.dealt(df, key, n, most=10))
    for what, n in (("old", 50), ("new", 30)):
        sinks.replace_by_key(spark.range(n).select("id", F.lit(what).alias("what")), str(tmp_path / "t"), "id", 4)
    assert rows == [50, 50] and shared.dealt(spark.range(5), "id", 1_000_001).rdd.getNumPartitions() == 5
    assert {(r["id"], r["what"]) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {(i, "new" if i < 30 else "old") for i in range(50)}


def test_named_files_ask_for_the_file_system_once_a_task(tmp_path, monkeypatch):
    asked, real = [], named_files.file_system
    monkeypatch.setattr(named_files, "file_system", lambda folder: asked.append(folder) or real(folder))
    named_files.NamedFilesWriter(str(tmp_path)).write(iter([{"name": f"d{i % 3}/{i}", "content": b"x"} for i in range(30)]))
    assert len(asked) == 1 and sum(len(list(d.iterdir())) for d in tmp_path.iterdir()) == 30


def test_released_memory_is_trimmed(monkeypatch):
    called = []
    monkeypatch.setattr(common.ctypes, "CDLL", lambda name: type("C", (), {"malloc_trim": staticmethod(called.append)}))
    common.release_unused()
    assert called == [0]
