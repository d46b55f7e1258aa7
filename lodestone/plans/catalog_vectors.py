"""Queries over vectors, predictions and boxes: search, fusion, tags by neighbours, metrics, samples.

Searches ask with every row whose id is divisible by 100, against all rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import evaluation, filters, ranking, sampling, tags, vectors
from lodestone.plans.registry import query
from lodestone.plans.views import BOXES, CORPUS, PREDS, boxes, corpus, predictions, table

VECS = "v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec, label FROM embeddings)"
SCORE = "round(list_inner_product(q.vec, c.vec), 6)"


def nn(k: int, where: str = "q.id % 100 = 0", name: str = "nn", side: str = "v", asked: str = "v") -> str:
    return f"{name} AS (SELECT qid, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT q.id AS qid, c.id, {SCORE} AS score, row_number() OVER (PARTITION BY q.id ORDER BY {SCORE} DESC, c.id) AS rank FROM {asked} q JOIN {side} c ON {where}) WHERE rank <= {k})"


V = f"WITH {VECS}, "


def vecs(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def asked(spark, d):
    return vecs(spark, d).where(F.col("id") % 100 == 0).select(F.col("id").alias("qid"), "vec")


def shifted(v: str = "vec") -> str:
    """A second vector of each row, its components moved on by one: the stand-in for text vectors."""
    return f"list_concat({v}[2:], {v}[:1])"


def text_vecs(spark, d):
    return vecs(spark, d).select("id", F.concat(F.slice("vec", 2, 1_000), F.slice("vec", 1, 1)).alias("vec"))


@query(V + nn(10) + " SELECT * FROM nn")
def v01_knn(spark, d):
    return vectors.knn(asked(spark, d), vecs(spark, d), 10)


@query("SELECT vec_id AS id, round(CAST(embedding[1] AS DOUBLE), 6) AS first, CAST(len(embedding) AS INTEGER) AS dim FROM embeddings WHERE vec_id IN (7, 99, 123456789)")
def v02_stored_vector(spark, d):
    return vecs(spark, d).where(F.col("id").isin(7, 99, 123456789)).select("id", F.round(F.element_at("vec", 1).cast("double"), 6).alias("first"), F.size("vec").alias("dim"))


@query(V + "n AS (SELECT id, list_transform(vec, lambda x: 3 * x) AS w, sqrt(list_sum(list_transform(vec, lambda x: 9 * x * x))) AS n FROM v) SELECT id, round(w[1] / n, 6) AS first, round(w[64] / n, 6) AS last FROM n")
def v03_unit_length(spark, d):
    u = vectors.l2_normalised(F.transform("vec", lambda x: 3 * x.cast("double")))
    return vecs(spark, d).select("id", u.alias("u")).select("id", F.round(F.element_at("u", 1), 6).alias("first"), F.round(F.element_at("u", 64), 6).alias("last"))


@query(V + nn(7) + " SELECT qid, id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INTEGER) AS rank FROM nn WHERE id <> qid AND score >= 0.1 QUALIFY rank() OVER (PARTITION BY qid ORDER BY score DESC, id) <= 6")
def v04_similar_by_id(spark, d):
    return vectors.similar(asked(spark, d).select("qid"), vecs(spark, d).select("id", "vec"), 6, 0.10)


@query(f"WITH {VECS}, {CORPUS}, " + nn(100) + " SELECT qid, id, score, rank, building_type FROM nn JOIN corpus ON id = image_id WHERE score >= 0.15 AND rank <= 30")
def v05_search_by_vector(spark, d):
    hits = vectors.knn(asked(spark, d), vecs(spark, d), 100).where("score >= 0.15 and rank <= 30")
    return ranking.with_rows(hits, corpus(spark, d).select("image_id", "building_type")).select("qid", "id", "score", "rank", "building_type")


COMPONENT = f"""{V} seg AS (SELECT id, id // 3 AS image_id, vec FROM v), {nn(32, name='sn', side='seg')}, {nn(16, name='im')},
b AS (SELECT qid, image_id, score, row_number() OVER (PARTITION BY qid, image_id ORDER BY score DESC, s.id) AS p, s.id FROM sn s JOIN seg ON s.id = seg.id WHERE image_id <> qid // 3),
f AS (SELECT qid, image_id, score, 0 AS tier FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM b WHERE p = 1) WHERE r <= 4),
g AS (SELECT * FROM f UNION ALL SELECT qid, id, score, 1 FROM im WHERE id <> qid // 3 AND NOT EXISTS (SELECT 1 FROM f WHERE f.qid = im.qid AND f.image_id = im.id))
SELECT qid, image_id, score, tier, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY tier, score DESC, image_id) AS rank FROM g) WHERE rank <= 4"""


@query(COMPONENT)
def v06_component_search(spark, d):
    v = vecs(spark, d)
    queries = asked(spark, d).select("qid", "vec", F.expr("qid div 3").alias("own_image"))
    segments = v.select("id", F.expr("id div 3").alias("image_id"), "vec")
    return ranking.component_search(queries, segments, v.select("id", "vec"), k=4)


RRF = f"{V} t AS (SELECT id, {shifted()} AS vec FROM v), {nn(20, name='a')}, {nn(20, 'q.id % 100 = 0 AND q.id % 300 <> 0', name='b', side='t')}, "
RRF += "u AS (SELECT *, 0 AS list FROM a UNION ALL SELECT *, 1 FROM b), o AS (SELECT qid, min(list) = max(list) AS alone FROM u GROUP BY 1), z AS (SELECT qid, id, round(CASE WHEN any_value(alone) THEN any_value(score) ELSE sum(1.0::DOUBLE / (60 + rank)) END, 9) AS score, min(list * 1000000 + rank) AS seen FROM u JOIN o USING (qid) GROUP BY 1, 2), fused AS (SELECT qid, id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, seen, id) AS INTEGER) AS rank FROM z)"


def _two_lists(spark, d):
    q = asked(spark, d)
    return vectors.knn(q, vecs(spark, d), 20), vectors.knn(q.where(F.col("qid") % 300 != 0), text_vecs(spark, d), 20)


@query(RRF + " SELECT * FROM fused")
def v07_rank_fusion(spark, d):
    """Queries divisible by 300 have no second list and keep raw scores."""
    return ranking.reciprocal_rank_fusion(list(_two_lists(spark, d)))


@query(f"{V} t AS (SELECT id, {shifted()} AS vec FROM v), {nn(10, name='a')}, w AS (SELECT a.qid, a.id, round(0.6::DOUBLE * a.score + 0.4::DOUBLE * round(list_inner_product(q.vec, c.vec), 6), 6) AS score FROM a JOIN v q ON q.id = a.qid JOIN t c ON c.id = a.id) SELECT qid, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM w) WHERE rank <= 5")
def v08_weighted_hybrid(spark, d):
    q = asked(spark, d)
    hits = vectors.knn(q, vecs(spark, d), 10)
    meta = hits.select("qid", "id").join(q.withColumnRenamed("vec", "qv"), "qid").join(text_vecs(spark, d), "id").select("qid", "id", F.round(vectors.dot(F.col("qv"), F.col("vec")), 6).alias("meta_score"))
    return ranking.weighted_hybrid(hits, meta)


def _mmr_step(i: int) -> str:
    """The i-th choice: the best of what is left, against all that are chosen."""
    if i == 1:
        return "p1 AS (SELECT qid, id, score, vec, 1 AS rank FROM c QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) = 1)"
    chosen = " UNION ALL ".join(f"SELECT * FROM p{j}" for j in range(1, i))
    near = f"SELECT c.qid, c.id, c.score, c.vec, round(0.7::DOUBLE * c.score - 0.3::DOUBLE * max(list_inner_product(c.vec, p.vec)), 12) AS value FROM c JOIN ({chosen}) p ON p.qid = c.qid GROUP BY c.qid, c.id, c.score, c.vec HAVING NOT bool_or(p.id = c.id)"
    return f"p{i} AS (SELECT qid, id, score, vec, {i} AS rank FROM ({near}) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY value DESC, score DESC, id) = 1)"


@query(V + nn(30) + ", c AS (SELECT nn.qid, nn.id, nn.score, v.vec FROM nn JOIN v ON v.id = nn.id), " + ", ".join(map(_mmr_step, range(1, 6))) + " " + " UNION ALL ".join(f"SELECT qid, id, score, rank FROM p{i}" for i in range(1, 6)))
def v09_mmr(spark, d):
    hits = vectors.knn(asked(spark, d), vecs(spark, d), 30)
    return ranking.mmr(hits.join(vecs(spark, d).select("id", "vec"), "id").select("qid", "id", "score", "vec"), k=5)


@query(f"WITH {VECS}, {CORPUS}, " + nn(20) + """, t AS (SELECT nn.qid, nn.id, list_distinct(list_filter(regexp_split_to_array(lower(a.text), '\\s+'), lambda w: w <> '')) AS qw, regexp_split_to_array(lower(b.text), '\\s+') AS dw FROM nn JOIN corpus a ON nn.qid = a.image_id JOIN corpus b ON nn.id = b.image_id),
s AS (SELECT qid, id, round(1 / (1 + exp(-(8.0::DOUBLE * len(list_filter(qw, lambda w: list_contains(dw, w))) / greatest(len(qw), 1) - 4.0::DOUBLE))), 6) AS score FROM t)
SELECT qid, id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INTEGER) AS rank FROM s""")
def v10_rerank(spark, d):
    names = corpus(spark, d).select("image_id", F.col("text").alias("name"))
    hits = vectors.knn(asked(spark, d), vecs(spark, d), 20)
    rows = hits.join(names.select(F.col("image_id").alias("qid"), F.col("name").alias("query")), "qid").join(names.select(F.col("image_id").alias("id"), F.col("name").alias("text")), "id")
    return ranking.reranked(rows).select("qid", "id", "score", "rank")


@query(f"WITH {VECS}, {CORPUS}, c2 AS (SELECT v.id, v.vec FROM v JOIN corpus ON v.id = image_id WHERE ingest_status = 'ready' AND (owner = 'owner_1' OR owner IS NULL)), " + nn(8, side="c2") + " SELECT * FROM nn")
def v11_chunk_retrieval(spark, d):
    c = corpus(spark, d)
    chunks = c.select(F.col("image_id").alias("id"), F.col("image_id").alias("source_id"), "vec")
    sources = c.select(F.col("image_id").alias("source_id"), "owner", "ingest_status")
    return ranking.chunk_search(asked(spark, d), chunks, sources, (F.col("ingest_status") == "ready") & filters.visible("owner_1"))


FILTER = "year_built BETWEEN 1820 AND 2000 AND (array_to_string(materials, ',') ILIKE '%glass%' OR array_to_string(materials, ',') ILIKE '%steel%')"


def _condition():
    return filters.all_of([filters.period("year_built", (1820, 2000)), filters.material(["glass", "steel"], "materials")])


PENALTY = "p AS (SELECT qid, id, round(CASE WHEN tag_status = 'provisional' THEN score * 0.95::DOUBLE ELSE score END, 9) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(CASE WHEN tag_status = 'provisional' THEN score * 0.95::DOUBLE ELSE score END, 9) DESC, rank) AS INTEGER) AS rank FROM h)"


@query(f"WITH {VECS}, {CORPUS}, t AS (SELECT id, {shifted()} AS vec FROM v), {nn(100, asked='t')}, r AS (SELECT *, max(score) OVER (PARTITION BY qid) AS top FROM nn), h AS (SELECT r.*, tag_status FROM r JOIN corpus ON id = image_id WHERE score >= greatest(top - 0.20::DOUBLE, 0.05::DOUBLE) AND {FILTER}), {PENALTY} SELECT p.qid, p.id, p.score, p.rank, style_primary FROM p JOIN corpus ON id = image_id WHERE p.rank <= 20")
def v12_text_search(spark, d):
    asked_ = text_vecs(spark, d).where(F.col("id") % 100 == 0).select(F.col("id").alias("qid"), "vec")
    out = ranking.text_search(asked_, vecs(spark, d).select("id", "vec"), corpus(spark, d), _condition(), threshold=0.05)
    return out.select("qid", "id", "score", "rank", "style_primary")


IMAGE = f"""WITH {VECS}, {CORPUS}, t AS (SELECT id, {shifted()} AS vec FROM v), {nn(40, name='a')}, {nn(40, name='b0', side='t')},
b AS (SELECT qid, id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INTEGER) AS rank FROM b0 WHERE id <> qid),
u AS (SELECT *, 0 AS list FROM a UNION ALL SELECT *, 1 FROM b), z AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(list * 1000000 + rank) AS seen FROM u GROUP BY 1, 2),
fused AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, seen, id) AS rank FROM z),
h AS (SELECT f.*, tag_status FROM fused f LEFT JOIN a ON a.qid = f.qid AND a.id = f.id LEFT JOIN b ON b.qid = f.qid AND b.id = f.id JOIN corpus ON f.id = image_id WHERE (coalesce(a.score, 0) >= 0.12 OR coalesce(b.score, 0) >= 0.12) AND {FILTER}), {PENALTY}
SELECT p.qid, p.id, p.score, p.rank, style_primary FROM p JOIN corpus ON id = image_id WHERE p.rank <= 10"""


@query(IMAGE)
def v13_image_search(spark, d):
    out = ranking.image_search(asked(spark, d), vecs(spark, d).select("id", "vec"), text_vecs(spark, d), corpus(spark, d), _condition(), candidates=40, threshold=0.12)
    return out.select("qid", "id", "score", "rank", "style_primary")


OWN = "((q.id % 300 <> 0 OR c.location_country IN ('en', 'fr')) AND (q.id % 200 <> 0 OR c.year_built BETWEEN 1820 AND 2000) AND (q.id % 500 <> 100 OR array_to_string(c.materials, ',') ILIKE '%glass%' OR array_to_string(c.materials, ',') ILIKE '%steel%'))"


def own_filters(queries):
    """Queries with filters of their own by their number: countries, a period, materials, or none."""
    some = lambda c, *values: F.when(c, F.array(*map(F.lit, values)))
    own = F.create_map(F.lit("country"), some(F.col("qid") % 300 == 0, "en", "FR"), F.lit("period"), some(F.col("qid") % 200 == 0, "1820", "2000"), F.lit("material"), some(F.col("qid") % 500 == 100, "glass", "steel"))
    return queries.withColumn("filters", F.map_filter(own, lambda k, v: v.isNotNull()))


@query(f"WITH {VECS}, {CORPUS}, t AS (SELECT id, {shifted()} AS vec FROM v), z AS (SELECT q.id AS qid, c.image_id AS id, {SCORE.replace('c.vec', 'w.vec')} AS score FROM t q JOIN corpus c ON {OWN} JOIN v w ON w.id = c.image_id WHERE q.id % 100 = 0), z1 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank, max(score) OVER (PARTITION BY qid) AS top FROM z), h AS (SELECT z1.*, tag_status FROM z1 JOIN corpus ON id = image_id WHERE rank <= 100 AND score >= greatest(top - 0.20::DOUBLE, 0.05::DOUBLE)), {PENALTY} SELECT p.qid, p.id, p.score, p.rank, style_primary FROM p JOIN corpus ON id = image_id WHERE p.rank <= 20")
def v12_filters_before(spark, d):
    """Every query has filters of its own and finds its hundred among its own rows."""
    asked_ = own_filters(text_vecs(spark, d).where(F.col("id") % 100 == 0).select(F.col("id").alias("qid"), "vec"))
    out = ranking.text_search(asked_, vecs(spark, d).select("id", "vec"), corpus(spark, d), facets=corpus_facets(), threshold=0.05, filter_mode="pre")
    return out.select("qid", "id", "score", "rank", "style_primary")


OWN_IMAGE = IMAGE.replace(f"JOIN corpus ON f.id = image_id WHERE", "JOIN corpus c ON f.id = image_id JOIN v q ON q.id = f.qid WHERE").replace(FILTER, OWN)


@query(OWN_IMAGE)
def v13_filters_after(spark, d):
    """Every query has filters of its own, held against its candidates."""
    out = ranking.image_search(own_filters(asked(spark, d)), vecs(spark, d).select("id", "vec"), text_vecs(spark, d), corpus(spark, d), facets=corpus_facets(), candidates=40, threshold=0.12)
    return out.select("qid", "id", "score", "rank", "style_primary")


@query(V + nn(3, "true") + " SELECT * FROM nn")
def j07_every_row_asks(spark, d):
    """The three nearest of every row among all rows: blocks of queries meet blocks of vectors."""
    v = vecs(spark, d)
    return vectors.knn(v.select(F.col("id").alias("qid"), "vec"), v, 3, batch=100)


CENTRE = f"{V} m AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM v) GROUP BY 1, 2), g AS (SELECT label, list(m ORDER BY i) AS mv, sqrt(sum(m * m)) AS n FROM m GROUP BY 1), k AS (SELECT label, list_transform(mv, lambda x: x / n) AS lv FROM g), s AS (SELECT v.id, v.label AS own, k.label, round(list_inner_product(v.vec, k.lv), 6) AS cos FROM v CROSS JOIN k)"


def _labels(spark, d):
    """Rows with their own label, and the centroids of the labels."""
    v = vecs(spark, d)
    return v.withColumnRenamed("label", "own"), vectors.centroids(v, "label")


@query(CENTRE + ", e AS (SELECT *, exp(100 * (cos - max(cos) OVER (PARTITION BY id))) AS e FROM s), p AS (SELECT id, label, cos, e / sum(e) OVER (PARTITION BY id) AS p FROM e) SELECT id, CASE WHEN max(p) >= 0.20 THEN arg_max(label, cos - label * 1e-9) END AS label, round(max(p), 4) AS conf FROM p GROUP BY 1")
def v14_zero_shot(spark, d):
    return vectors.zero_shot(*_labels(spark, d)).select("id", "label", F.round("conf", 4).alias("conf"))


@query(f"WITH {VECS}, {CORPUS}, {nn(50)}, h AS (SELECT nn.*, tag_status FROM nn JOIN corpus ON id = image_id), {PENALTY} SELECT * FROM p")
def v15_penalty(spark, d):
    hits = vectors.knn(asked(spark, d), vecs(spark, d), 50).join(corpus(spark, d).select(F.col("image_id").alias("id"), "tag_status"), "id")
    return ranking.penalised(hits).select("qid", "id", "score", "rank")


@query(CENTRE + ", t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cos DESC, label) AS p FROM s WHERE cos >= 0.2) SELECT id, string_agg(CAST(label AS VARCHAR), ',' ORDER BY p) AS styles, max(cos) AS confidence FROM t WHERE p <= 3 GROUP BY 1")
def v16_top_styles(spark, d):
    return vectors.top_styles(*_labels(spark, d))


@query(CENTRE + " SELECT label, round(lv[1], 6) AS first, round(lv[64], 6) AS last FROM k")
def v17_centroids(spark, d):
    return vectors.centroids(vecs(spark, d), "label").select("label", F.round(F.element_at("vec", 1), 6).alias("first"), F.round(F.element_at("vec", 64), 6).alias("last"))


COLLECTION = "(c.class_id = q.id AND (q.id % 3 <> 0 OR c.location_country IN ('en', 'de')) AND (q.id % 2 = 0 OR c.year_built BETWEEN 1850 AND 1980) AND (q.id % 5 <> 4 OR c.materials[1] ILIKE '%no such stuff%' OR c.materials[2] ILIKE '%no such stuff%'))"


def corpus_facets():
    return filters.facets(year="year_built", materials="materials", country_="location_country", styles=(F.col("style_primary"),), types=(F.col("building_type"),), typologies=F.array(F.col("building_type")))


def _collections(spark, d):
    """One (query, filter) pair a style: the style itself, and by its number countries, a period, or a material that nothing has."""
    label, some = F.col("label"), lambda c, *values: F.when(c, F.array(*map(F.lit, values))).otherwise(F.array().cast("array<string>"))
    own = F.create_map(F.lit("style"), F.array(F.concat(F.lit("style_"), label.cast("string"))), F.lit("country"), some(label % 3 == 0, "EN", "de"), F.lit("period"), some(label % 2 == 1, "1850", "1980"), F.lit("material"), some(label % 5 == 4, "no such stuff"))
    return vectors.centroids(vecs(spark, d), "label").select(label.alias("qid"), "vec", own.alias("filters"))


@query(CENTRE.replace("WITH ", f"WITH {CORPUS}, ", 1) + f", q AS (SELECT label AS id, lv FROM k), h AS (SELECT q.id AS qid, v.id, round(list_inner_product(q.lv, v.vec), 6) AS score FROM q JOIN corpus c ON {COLLECTION} JOIN v ON v.id = c.image_id) SELECT qid, id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INTEGER) AS rank FROM h QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= 4")
def v18_style_collections(spark, d):
    """(query, filter) pairs, each with the four best among its own rows, in one scan; two of ten are empty and drop out."""
    return ranking.collections(_collections(spark, d), vecs(spark, d).select("id", "vec"), corpus(spark, d), corpus_facets(), 4)


@query(CENTRE + " SELECT round(avg(cos), 6) AS mean, round(stddev_samp(cos), 6) AS std, count(*) AS n, (SELECT round(avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0.0 END), 6) FROM (SELECT own, label, row_number() OVER (PARTITION BY id ORDER BY cos DESC, label) AS r FROM s) WHERE own = label) AS recall_1, (SELECT round(avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0.0 END), 6) FROM (SELECT own, label, row_number() OVER (PARTITION BY id ORDER BY cos DESC, label) AS r FROM s) WHERE own = label) AS recall_5 FROM s")
def v19_similarity_stats(spark, d):
    return vectors.similarity_stats(*_labels(spark, d))


@query(V + nn(11) + " SELECT qid, id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INTEGER) AS rank FROM nn WHERE id <> qid QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= 10")
def v20_similar_text(spark, d):
    return vectors.similar(asked(spark, d).select("qid"), vecs(spark, d).select("id", "vec"), 10, None)


SUPPRESSED = f"""WITH RECURSIVE {BOXES}, n AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, region) AS p FROM boxes WHERE score >= 0.2),
g AS (SELECT image, 0::BIGINT AS p, []::STRUCT(x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE)[] AS kept, false AS new, NULL::BIGINT AS region, NULL::DOUBLE AS score FROM (SELECT DISTINCT image FROM n)
 UNION ALL SELECT image, p, CASE WHEN ok THEN list_append(kept, struct_pack(x1 := x1, y1 := y1, x2 := x2, y2 := y2)) ELSE kept END, ok, region, score FROM (
 SELECT g.image, n.p, g.kept, n.x1, n.y1, n.x2, n.y2, CAST(n.region AS BIGINT) AS region, n.score, len(g.kept) < 20 AND len(list_filter(g.kept, lambda k: greatest(least(k.x2, n.x2) - greatest(k.x1, n.x1), 0) * greatest(least(k.y2, n.y2) - greatest(k.y1, n.y1), 0)
 / greatest((k.x2 - k.x1) * (k.y2 - k.y1) + (n.x2 - n.x1) * (n.y2 - n.y1) - greatest(least(k.x2, n.x2) - greatest(k.x1, n.x1), 0) * greatest(least(k.y2, n.y2) - greatest(k.y1, n.y1), 0), 1e-9) >= 0.45)) = 0 AS ok FROM g JOIN n ON n.image = g.image AND n.p = g.p + 1))
SELECT image, region, score, CAST(row_number() OVER (PARTITION BY image ORDER BY p) AS INTEGER) AS place FROM g WHERE new"""


@query(SUPPRESSED)
def v21_non_max_suppression(spark, d):
    return ranking.non_max_suppression(boxes(spark, d))


@query(f"WITH {BOXES} SELECT image, region, round(x1 / 200, 4) AS bbox_x, round(y1 / 200, 4) AS bbox_y, round((x2 - x1) / 200, 4) AS bbox_w, round((y2 - y1) / 200, 4) AS bbox_h, round((x2 - x1) * (y2 - y1) / 40000, 4) AS area_ratio FROM boxes")
def x29_box_shape(spark, d):
    return boxes(spark, d).select("image", "region", *ranking.box_shape(*(F.col(c) for c in ("x1", "y1", "x2", "y2")), 200.0, 200.0))


AREA = "(x2 - x1) * (y2 - y1) / 40000"


@query(f"WITH {BOXES}, a AS (SELECT image, region, {AREA} AS area, row_number() OVER (PARTITION BY image ORDER BY {AREA} DESC, region) AS place FROM boxes WHERE {AREA} >= 0.02) SELECT image, region, round(area, 6) AS area, CAST(place AS INTEGER) AS place FROM a WHERE place <= 3")
def f21_largest_regions(spark, d):
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) / 40000
    return filters.largest_regions(boxes(spark, d).withColumn("area", area), "area", n=3).select("image", "region", F.round("area", 6).alias("area"), "place")


@query(f"WITH {BOXES}, a AS (SELECT image, region, score, row_number() OVER (PARTITION BY image ORDER BY score DESC, region) AS place FROM boxes) SELECT image, region, score, CAST(place AS INTEGER) AS place FROM a WHERE place <= 2")
def w03_top_per_group(spark, d):
    return filters.top_of_each(boxes(spark, d), "image", 2, F.desc("score"), "region").select("image", "region", "score", "place")


@query(f"WITH {VECS}, {CORPUS}, {nn(100)} SELECT qid, id, rank FROM nn WHERE id IN (SELECT image_id FROM corpus WHERE {FILTER})")
def f08_combined_filter(spark, d):
    hits = vectors.knn(asked(spark, d), vecs(spark, d), 100).withColumnRenamed("id", "image_id")
    return filters.keep_candidates(hits, corpus(spark, d), _condition()).select("qid", F.col("image_id").alias("id"), "rank")


@query(V + nn(100) + " SELECT qid, id, score FROM nn WHERE score >= 0.2")
def f09_score_floor(spark, d):
    return vectors.knn(asked(spark, d), vecs(spark, d), 100).where("score >= 0.2").select("qid", "id", "score")


@query(V + nn(100) + ", r AS (SELECT *, max(score) OVER (PARTITION BY qid) AS top FROM nn WHERE id <> qid) SELECT qid, id, score FROM r WHERE score >= greatest(top - 0.20::DOUBLE, 0.1::DOUBLE)")
def f10_relative_floor(spark, d):
    hits = vectors.knn(asked(spark, d), vecs(spark, d), 100).where("id <> qid")
    return filters.relative_floor(hits, 0.1).select("qid", "id", "score")


@query(RRF + " SELECT f.qid, f.id FROM fused f LEFT JOIN a ON a.qid = f.qid AND a.id = f.id LEFT JOIN b ON b.qid = f.qid AND b.id = f.id WHERE coalesce(a.score, 0) >= 0.25 OR coalesce(b.score, 0) >= 0.25")
def f11_either_floor(spark, d):
    a, b = _two_lists(spark, d)
    rows = a.select("qid", "id", F.col("score").alias("x")).join(b.select("qid", "id", F.col("score").alias("y")), ["qid", "id"], "full")
    return rows.where(filters.either_floor(0.25, "x", "y")).select("qid", "id")


@query(V + nn(20) + " SELECT qid, id, score FROM nn WHERE id <> qid AND id // 3 <> qid // 3")
def f22_exclude_self_and_parent(spark, d):
    hits = vectors.knn(asked(spark, d), vecs(spark, d), 20)
    return hits.where("id <> qid and id div 3 <> qid div 3").select("qid", "id", "score")


@query(f"WITH {VECS}, {CORPUS}, {nn(15)} SELECT qid, rank, image_id, name FROM nn JOIN (SELECT * FROM corpus WHERE owner IS NOT NULL) c ON id = image_id")
def j01_candidates_with_rows(spark, d):
    hits = vectors.knn(asked(spark, d), vecs(spark, d), 15)
    rows = corpus(spark, d).where("owner is not null").select("image_id", "name")
    return ranking.with_rows(hits, rows).select("qid", "rank", F.col("id").alias("image_id"), "name")


@query(f"WITH {CORPUS} SELECT c.image_id, s.n FROM corpus c JOIN (SELECT source, CAST(count(*) AS BIGINT) AS n FROM documents WHERE source IN ('src1', 'src2', 'src3') GROUP BY 1) s ON c.source = s.source WHERE (owner = 'owner_2' OR owner IS NULL) AND ingest_status = 'ready'")
def j03_chunk_with_source(spark, d):
    s = table(spark, d, "documents").where(F.col("source").isin("src1", "src2", "src3")).groupBy("source").agg(F.count("*").alias("n"))
    c = corpus(spark, d).where(filters.visible("owner_2") & (F.col("ingest_status") == "ready"))
    return c.join(s, "source").select("image_id", "n")


@query(CENTRE + " SELECT id, label, cos FROM s")
def j09_label_scores(spark, d):
    return vectors.class_scores(*_labels(spark, d))


@query(CENTRE.replace("WITH ", f"WITH {CORPUS}, ", 1) + ", n2 AS (SELECT c.image_id AS id, 'style:' || c.style_primary AS key, round(list_inner_product(v.vec, k.lv), 4) AS score FROM corpus c JOIN v ON v.id = c.image_id JOIN k ON k.label = c.class_id) SELECT id, key, score FROM n2")
def t03_prompt_agreement(spark, d):
    v = vecs(spark, d)
    keys = vectors.centroids(v, "label").select(F.concat(F.lit("style:Style_"), F.col("label").cast("string")).alias("key"), F.col("vec").alias("key_vec"))
    rows = corpus(spark, d).select(F.col("image_id").alias("id"), "vec", tags.prompts(F.col("style_primary"), F.lit(""), F.array().cast("array<string>")).alias("prompts"))
    return tags.prompt_agreement(rows, keys).select("id", F.explode("clip").alias("key", "score"))


VOTES = f"WITH {VECS}, {CORPUS}, {nn(11)}, h AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM nn WHERE id <> qid), y AS (SELECT h.qid, n.style_primary AS ns, n.building_type AS nt, o.style_primary AS os, o.building_type AS ot FROM h JOIN corpus n ON h.id = n.image_id JOIN corpus o ON h.qid = o.image_id WHERE r <= 10), w AS (SELECT qid AS id, CAST(count(*) AS BIGINT) AS k, CAST(count(CASE WHEN ns = os THEN 1 END) AS BIGINT) AS style_votes, CAST(count(CASE WHEN nt = ot THEN 1 END) AS BIGINT) AS building_type_votes FROM y GROUP BY 1)"


@query(VOTES + " SELECT *, style_votes >= 6 AS style_pass, building_type_votes >= 6 AS building_type_pass FROM w")
def t04_neighbour_votes(spark, d):
    rows = corpus(spark, d).select(F.col("image_id").alias("id"), F.col("style_primary").alias("style"), "building_type")
    return tags.neighbour_votes(rows, vecs(spark, d), rows.where(F.col("id") % 100 == 0), least_corpus=100)


@query(VOTES.split(", y AS")[0] + " SELECT qid AS id, style_primary AS style, CAST(count(*) AS BIGINT) AS votes FROM h JOIN corpus ON h.id = image_id WHERE r <= 10 GROUP BY 1, 2")
def j12_neighbour_attributes(spark, d):
    hits = vectors.similar(asked(spark, d).select("qid"), vecs(spark, d).select("id", "vec"), 10, None)
    return tags.neighbour_counts(hits, corpus(spark, d).select(F.col("image_id").alias("id"), F.col("style_primary").alias("style")), "style").withColumnRenamed("qid", "id")


IR = f"{V}{nn(20)}, rel AS (SELECT q.id AS qid, c.id FROM v q JOIN v c ON q.label = c.label AND q.id % 100 = 0 AND q.id % 300 <> 0), nr AS (SELECT qid, count(*) AS n_rel FROM rel GROUP BY 1), m AS (SELECT nn.*, CASE WHEN rel.id IS NULL THEN 0 ELSE 1 END AS rel FROM nn LEFT JOIN rel ON rel.qid = nn.qid AND rel.id = nn.id), "
IR += "pq AS (SELECT nr.qid, round(coalesce(1.0::DOUBLE / min(CASE WHEN rel = 1 THEN rank END), 0), 6) AS mrr, " + ", ".join(
    f"round(sum(CASE WHEN rank <= {k} THEN rel ELSE 0 END) / nullif(count(CASE WHEN rank <= {k} THEN 1 END), 0)::DOUBLE, 6) AS p_{k}, round(sum(CASE WHEN rank <= {k} THEN rel ELSE 0 END) / any_value(n_rel)::DOUBLE, 6) AS r_{k}, CAST(max(CASE WHEN rank <= {k} THEN rel ELSE 0 END) AS INTEGER) AS hit_{k}, round(sum(CASE WHEN rank <= {k} THEN rel / log2(rank + 1) ELSE 0 END) / list_sum(list_transform(range(1, least(any_value(n_rel), {k}) + 1), lambda i: 1.0::DOUBLE / log2(i + 1))), 6) AS ndcg_{k}" for k in (5, 10, 20)
) + " FROM nr JOIN m ON nr.qid = m.qid GROUP BY 1)"


def _per_query(spark, d):
    v = vecs(spark, d)
    labelled = v.where(F.col("id") % 100 == 0).where(F.col("id") % 300 != 0).select(F.col("id").alias("qid"), "label")
    return evaluation.retrieval_metrics_by_label(vectors.knn(asked(spark, d), v, 20), labelled, v.select("id", "label"))


@query(IR + " SELECT * FROM pq")
def a12_retrieval_metrics(spark, d):
    return _per_query(spark, d)


@query(IR + " SELECT " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in ["mrr", *[f"{m}_{k}" for k in (5, 10, 20) for m in ("p", "r", "hit", "ndcg")]]) + ", count(*) AS n_labelled, (SELECT count(*) FROM v WHERE id % 100 = 0) - count(*) AS n_unlabelled FROM pq")
def a13_mean_metrics(spark, d):
    return evaluation.mean_metrics(_per_query(spark, d), asked(spark, d))


P = f"WITH {PREDS}, "
REPORT = P + "t AS (SELECT truth AS label, count(*) AS support, count(CASE WHEN truth = pred THEN 1 END) AS tp FROM preds GROUP BY 1), o AS (SELECT pred AS label, count(*) AS told FROM preds GROUP BY 1), j AS (SELECT coalesce(t.label, o.label) AS label, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp, coalesce(told, 0) AS told FROM t FULL JOIN o ON t.label = o.label), r AS (SELECT label, coalesce(tp / nullif(told, 0)::DOUBLE, 0) AS p, coalesce(tp / nullif(support, 0)::DOUBLE, 0) AS r, support FROM j), rep AS (SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1, support FROM r)"


@query(REPORT + " SELECT * FROM rep")
def a14_class_report(spark, d):
    return evaluation.class_report(predictions(spark, d))


@query(REPORT + " SELECT round(avg(CASE WHEN truth = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n, (SELECT round(avg(f1), 6) FROM rep) AS macro_f1 FROM preds")
def a14_accuracy(spark, d):
    return evaluation.accuracy(predictions(spark, d))


@query(P[:-2] + " SELECT truth, pred, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY truth), 6) AS share FROM preds GROUP BY 1, 2")
def a15_confusion(spark, d):
    return evaluation.confusion(predictions(spark, d))


@query(P + "b AS (SELECT ceil(conf * 15) AS bin, count(*) AS n, avg(CASE WHEN truth = pred THEN 1.0::DOUBLE ELSE 0 END) AS acc, avg(conf) AS c FROM preds WHERE conf > 0 GROUP BY 1) SELECT round(sum(n * abs(acc - c)) / sum(n), 6) AS ece, CAST(sum(n) AS BIGINT) AS n FROM b")
def a16_calibration_error(spark, d):
    return evaluation.expected_calibration_error(predictions(spark, d))


@query(P + "b AS (SELECT CAST(floor(conf * 10) AS BIGINT) AS bin, count(*) AS n, round(avg(CASE WHEN truth = pred THEN 1.0::DOUBLE ELSE 0 END), 6) AS acc, round(avg(conf), 6) AS conf FROM preds WHERE conf < 1 GROUP BY 1) SELECT round((range + 0.5::DOUBLE) / 10, 6) AS centre, coalesce(n, 0) AS n, acc, conf FROM range(10) LEFT JOIN b ON bin = range")
def a17_reliability(spark, d):
    return evaluation.reliability(predictions(spark, d))


SWEEP = P + "g AS (SELECT round(0.10::DOUBLE + 0.05::DOUBLE * range, 2) AS threshold FROM range(18)), k AS (SELECT threshold, truth, pred FROM g JOIN preds ON conf >= threshold), f AS (SELECT threshold, avg(2.0::DOUBLE * tp / (t + p)) AS macro_f1 FROM (SELECT threshold, label, count(CASE WHEN truth = label AND pred = label THEN 1 END) AS tp, count(CASE WHEN truth = label THEN 1 END) AS t, count(CASE WHEN pred = label THEN 1 END) AS p FROM k CROSS JOIN (SELECT unnest([0, 1]) AS label) GROUP BY 1, 2) WHERE t + p > 0 GROUP BY 1), sweep AS (SELECT g.threshold, round(count(k.threshold) / (SELECT count(*) FROM preds)::DOUBLE, 6) AS coverage, round(coalesce(count(CASE WHEN truth = pred THEN 1 END) / nullif(count(k.threshold), 0)::DOUBLE, 0), 6) AS accuracy, round(coalesce(any_value(macro_f1), 0), 6) AS macro_f1 FROM g LEFT JOIN k ON k.threshold = g.threshold LEFT JOIN f ON f.threshold = g.threshold GROUP BY 1)"


@query(SWEEP + " SELECT * FROM sweep")
def a18_threshold_sweep(spark, d):
    return evaluation.threshold_sweep(predictions(spark, d))


@query(SWEEP + " SELECT * FROM sweep ORDER BY coverage >= 0.70 DESC, macro_f1 DESC, accuracy DESC, threshold LIMIT 1")
def a19_best_threshold(spark, d):
    return evaluation.best_threshold(evaluation.threshold_sweep(predictions(spark, d)))


STATS = "round(avg(conf), 6) AS mean, round(stddev_pop(conf), 6) AS std, round(min(conf), 6) AS least, round(max(conf), 6) AS most, round(quantile_cont(conf, {}), 6) AS percentile, count(*) AS n"


@query(P[:-2] + f" SELECT truth, {STATS.format(0.95)} FROM preds GROUP BY 1")
def a20_out_of_domain(spark, d):
    return evaluation.confidence_stats(predictions(spark, d), "truth")


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY 1 ORDER BY n DESC, label")
def a22_class_counts(spark, d):
    return evaluation.class_counts(table(spark, d, "embeddings"), "label")


@query(CENTRE + ", r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cos DESC, label) AS rank FROM s), b AS (SELECT v.id, min(r.rank) AS rank FROM v LEFT JOIN r ON r.id = v.id AND r.label = v.label GROUP BY 1) SELECT round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS r_1, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END), 6) AS r_3, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS r_5, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr, count(*) AS n, count(*) - count(rank) AS n_missing FROM b")
def a23_best_positive(spark, d):
    return evaluation.best_positive_ranks(vectors.own_label(*_labels(spark, d)))


MARGIN = CENTRE + ", mm AS (SELECT id, round(max(CASE WHEN label = own THEN cos END) - max(CASE WHEN label IN ((own + 1) % 10, (own + 3) % 10) THEN cos END), 6) AS margin FROM s GROUP BY 1)"


def _margins(spark, d):
    v = vecs(spark, d)
    near = v.select(F.col("label").alias("own_class")).distinct().select("own_class", F.explode(F.array((F.col("own_class") + 1) % 10, (F.col("own_class") + 3) % 10)).alias("negative"))
    return vectors.hard_negative_margins(*_labels(spark, d), near)


@query(MARGIN + " SELECT round(avg(CASE WHEN margin > 0 THEN 1.0 ELSE 0.0 END), 6) AS pass_rate, round(avg(margin), 6) AS mean, round(quantile_cont(margin, 0.1), 6) AS p10, count(*) AS n FROM mm")
def a24_hard_negatives(spark, d):
    return evaluation.margin_summary(_margins(spark, d))


@query(MARGIN + " SELECT id, margin FROM mm ORDER BY margin, id LIMIT 10")
def a24_worst_margins(spark, d):
    return _margins(spark, d).orderBy("margin", "id").limit(10)


@query(CENTRE + " SELECT id, round(avg(cos), 8) AS mean, round(stddev_pop(cos), 8) AS std, min(cos) AS least, max(cos) AS most FROM s GROUP BY 1")
def a25_prompt_consistency(spark, d):
    return vectors.label_consistency(*_labels(spark, d))


@query(CENTRE + ", i AS (SELECT id, round(stddev_pop(cos), 8) AS std FROM s GROUP BY 1) SELECT round(avg(std), 6) AS mean_std, round(quantile_cont(std, 0.9), 6) AS p_std, count(*) AS n FROM i")
def a25_consistency_summary(spark, d):
    return evaluation.consistency_summary(vectors.label_consistency(*_labels(spark, d)))


@query(f"WITH {BOXES} SELECT image % 100 AS label, count(score) AS n, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS std, round(min(score), 6) AS least, round(max(score), 6) AS most, round(quantile_cont(score, 0.25), 6) AS p25, round(quantile_cont(score, 0.5), 6) AS p50, round(quantile_cont(score, 0.75), 6) AS p75 FROM boxes GROUP BY 1")
def a22_described(spark, d):
    """Scores of the boxes of a hundred classes of images, described."""
    return evaluation.described(boxes(spark, d).select((F.col("image") % 100).alias("label"), "score"), "label", "score")


@query(V + "b AS (SELECT label, arg_min(vec, id) AS base_vec, min(id) AS base FROM v GROUP BY 1) SELECT v.label AS id, round(min(list_inner_product(vec, base_vec)), 6) AS least, round(avg(list_inner_product(vec, base_vec)), 6) AS mean, round(avg(CASE WHEN v.id % 10 = base % 10 THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM v JOIN b ON v.label = b.label GROUP BY 1")
def a26_stability(spark, d):
    v = vecs(spark, d)
    base = v.groupBy("label").agg(F.min_by("vec", "id").alias("base_vec"), (F.min("id") % 10).alias("base_label")).withColumnRenamed("label", "id")
    variants = v.select(F.col("label").alias("id"), "vec", (F.col("id") % 10).alias("label"))
    return evaluation.stability(variants, base, vectors.dot(F.col("vec"), F.col("base_vec")))


@query(P[:-2] + f" SELECT {STATS.format(0.9)} FROM preds")
def a27_confidence_stats(spark, d):
    return evaluation.confidence_stats(predictions(spark, d), share=0.9)


@query(P + "m AS (SELECT 'accuracy' AS metric, round(avg(CASE WHEN truth = pred THEN 1.0 ELSE 0.0 END), 6) AS value, 0.5::DOUBLE AS target, '>=' AS direction FROM preds UNION ALL SELECT 'mean_confidence', round(avg(conf), 6), 0.6, '<=' FROM preds UNION ALL SELECT 'rows', count(*), 100, '>=' FROM preds), p AS (SELECT *, CASE WHEN direction = '>=' THEN value >= target ELSE value <= target END AS passed FROM m) SELECT *, count(CASE WHEN passed THEN 1 END) OVER () AS n_pass FROM p")
def a28_scorecard(spark, d):
    p = predictions(spark, d)
    one = p.agg(F.round(F.avg((F.col("truth") == F.col("pred")).cast("double")), 6).alias("a"), F.round(F.avg("conf"), 6).alias("b"), F.count("*").cast("double").alias("c"))
    gate = lambda name, col, target, way: F.struct(F.lit(name).alias("metric"), F.col(col).alias("value"), F.lit(float(target)).alias("target"), F.lit(way).alias("direction"))
    return evaluation.scorecard(one.select(F.inline(F.array(gate("accuracy", "a", 0.5, ">="), gate("mean_confidence", "b", 0.6, "<="), gate("rows", "c", 100, ">=")))))


NLL = "sum(greatest(l0 / t, l1 / t) + ln(exp(l0 / t - greatest(l0 / t, l1 / t)) + exp(l1 / t - greatest(l0 / t, l1 / t))) - CASE WHEN truth = 1 THEN l1 / t ELSE l0 / t END) / count(*)"


@query(P + f"s AS (SELECT pow(10.0::DOUBLE / 0.05::DOUBLE, 1.0::DOUBLE / 59) AS s), g AS (SELECT 0.05::DOUBLE * pow(s, range) AS t FROM range(60), s), f AS (SELECT t, {NLL} AS v FROM g CROSS JOIN preds GROUP BY 1 ORDER BY v, t LIMIT 1), h AS (SELECT f.t * pow(s, (range - 60) / 60.0::DOUBLE) AS t FROM range(121), s, f), b AS (SELECT t, {NLL} AS v FROM h CROSS JOIN preds GROUP BY 1 ORDER BY v, t LIMIT 1) SELECT round(t, 4) AS temperature, round(v, 6) AS nll FROM b")
def a29_temperature(spark, d):
    return evaluation.fit_temperature(predictions(spark, d))


@query(V + nn(10) + " SELECT qid, id, score, rank FROM nn WHERE rank <= 3")
def w02_top_k(spark, d):
    return vectors.knn(asked(spark, d), vecs(spark, d), 10).where("rank <= 3")


E = "e AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('0:' || vec_id), vec_id) AS place, count(*) OVER (PARTITION BY label) AS n FROM embeddings)"


def _labelled(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label")


@query(f"WITH {E} SELECT vec_id, label FROM e WHERE place <= 5")
def w11_balanced(spark, d):
    return sampling.balanced(_labelled(spark, d), "label", "vec_id", 5)


@query(f"WITH {E} SELECT vec_id, label, unnest(CASE WHEN n = 1 THEN ['train', 'val'] WHEN place <= least(20, greatest(1, n // 5)) THEN ['val'] ELSE ['train'] END) AS part FROM e")
def w12_stratified_split(spark, d):
    return sampling.stratified_split(_labelled(spark, d), "label", "vec_id")


@query(f"WITH {E} SELECT vec_id, label, unnest(range(place, 281, n)) AS slot FROM e WHERE place <= 280")
def w13_oversampled(spark, d):
    return sampling.oversampled(_labelled(spark, d), "label", "vec_id")


@query(f"WITH {E}, f AS (SELECT vec_id, label, CASE WHEN place = 1 THEN 'train' ELSE 'test' END AS part FROM e WHERE place <= 2), r AS (SELECT vec_id, label, row_number() OVER (ORDER BY md5('1:' || vec_id), vec_id) AS p FROM e WHERE place > 2), z AS (SELECT greatest(60 - count(CASE WHEN part = 'train' THEN 1 END), 0) AS a, greatest(30 - count(CASE WHEN part = 'test' THEN 1 END), 0) AS b FROM f) SELECT * FROM f UNION ALL SELECT vec_id, label, CASE WHEN p <= a THEN 'train' ELSE 'test' END FROM r, z WHERE p <= a + b")
def w14_guaranteed_split(spark, d):
    return sampling.guaranteed_split(_labelled(spark, d), "label", "vec_id", 60, 30)


@query("""WITH e AS (SELECT vec_id, label, label // 3 AS cluster FROM embeddings), names AS (SELECT cluster, row_number() OVER (ORDER BY cluster) - 1 AS c, count(*) OVER () AS n FROM (SELECT DISTINCT cluster FROM e)),
inside AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY md5('0:' || vec_id), vec_id) AS place, count(*) OVER (PARTITION BY cluster) AS n_in FROM e), slots AS (SELECT range // 8 AS batch, range % 8 AS slot FROM range(96)),
own AS (SELECT batch, slot, cluster, (batch // n) * 8 + slot AS walk FROM slots JOIN names ON batch % n = c), pool AS (SELECT *, row_number() OVER (ORDER BY md5('1:' || vec_id), vec_id) AS place FROM e)
SELECT batch, slot, vec_id, label FROM own JOIN inside USING (cluster) WHERE place = walk % n_in + 1 UNION ALL SELECT batch, slot + 8, vec_id, label FROM slots JOIN pool ON place = batch * 8 + slot + 1""")
def w15_hard_negative_batches(spark, d):
    rows = _labelled(spark, d)
    clusters = rows.select("label").distinct().select(F.expr("label div 3").alias("cluster"), "label")
    return sampling.hard_negative_batches(rows, "label", "vec_id", clusters, 12, 16)


@query("WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS total FROM events) SELECT user_id, event_id FROM n WHERE pos % greatest(1, total // 8) = 0 AND pos < greatest(1, total // 8) * 8")
def w09_evenly_spaced(spark, d):
    return sampling.evenly_spaced(table(spark, d, "events"), "user_id", ["ts", "event_id"], 8).select("user_id", "event_id")


@query("WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events) SELECT user_id, event_id FROM n WHERE pos % 30 = 0 AND pos < 300")
def w10_every_30th(spark, d):
    return sampling.every_nth(table(spark, d, "events"), "user_id", ["ts", "event_id"], 30, 10).select("user_id", "event_id")


@query(CENTRE + ", e AS (SELECT *, exp(100 * (cos - max(cos) OVER (PARTITION BY id))) AS e FROM s), p AS (SELECT id, own, label, e / sum(e) OVER (PARTITION BY id) AS p FROM e) SELECT id, round(p, 4) AS p FROM p WHERE own = label AND p >= 0.05")
def x32_quality_filter(spark, d):
    return vectors.own_label(*_labels(spark, d)).where("p >= 0.05").select("id", F.round("p", 4).alias("p"))
