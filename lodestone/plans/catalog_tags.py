"""The second pass of tag validation, over signals, vectors and neighbours at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import tags, vectors
from lodestone.plans.catalog_rows import SIGNALS, _signals
from lodestone.plans.catalog_vectors import CENTRE, nn, vecs
from lodestone.plans.registry import query
from lodestone.plans.views import CORPUS, corpus

STATUS = "CASE WHEN a IS NOT NULL OR b IS NOT NULL THEN 'quarantined' WHEN vlm >= 0.6 AND (cs >= 0.25 OR coalesce(sv >= 6, false)) THEN 'verified' ELSE 'provisional' END"


@query(CENTRE.split(", s AS")[0].replace("WITH ", f"WITH {CORPUS}, ", 1) + SIGNALS + f""", again AS (SELECT t.image_id AS id, coalesce('Style_' || (c.class_id + 1) % 10, t.style_primary) AS st, 'type_' || (t.image_id + 1) % 6 AS bt, vlm FROM t JOIN corpus c ON c.image_id = t.image_id WHERE (a IS NOT NULL OR b IS NOT NULL) AND t.image_id % 7 <> 0),
{nn(11, 'q.id IN (SELECT id FROM again)')}, near AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM nn WHERE id <> qid),
votes AS (SELECT g.id, count(CASE WHEN n.style_primary = g.st THEN 1 END) AS sv, count(CASE WHEN n.building_type = g.bt THEN 1 END) AS tv FROM near JOIN again g ON g.id = near.qid JOIN corpus n ON n.image_id = near.id WHERE r <= 10 GROUP BY 1),
clip AS (SELECT g.id, round(max(CASE WHEN 'Style_' || k.label = g.st THEN list_inner_product(v.vec, k.lv) END), 4) AS cs, round(max(CASE WHEN 'type_' || k.label = g.bt THEN list_inner_product(v.vec, k.lv) END), 4) AS ct FROM again g JOIN v ON v.id = g.id CROSS JOIN k GROUP BY 1),
told AS (SELECT g.*, cs, ct, sv, tv, CASE WHEN cs < 0.12 AND sv <= 1 THEN 'style:' || st END AS a, CASE WHEN ct < 0.12 AND tv <= 1 THEN 'building_type:' || bt END AS b FROM again g LEFT JOIN clip ON clip.id = g.id LEFT JOIN votes ON votes.id = g.id),
final AS (SELECT id, st, bt, concat_ws(',', a, b) AS stripped, {STATUS} AS status FROM told)
SELECT t.image_id AS id, coalesce(final.st, t.style_primary) AS style_primary, coalesce(final.bt, t.building_type) AS building_type, coalesce(final.status, {STATUS}) AS tag_status, final.id IS NOT NULL AS final, coalesce(final.stripped, '') AS stripped FROM t LEFT JOIN final ON final.id = t.image_id""")
def t08_revalidated(spark, d):
    """Quarantined rows with stripped tags and a second extraction that did not fail are judged anew by all three signals; all others stay."""
    first = _signals(spark, d)
    first = first.withColumn("tag_status", tags.decision(F.col("stripped"), F.col("vlm"), F.col("cs"), F.col("sv") >= 6))
    second = first.select(F.col("image_id").alias("id"), F.concat(F.lit("Style_"), ((F.col("class_id") + 1) % 10).cast("string")).alias("style_primary"), F.concat(F.lit("type_"), ((F.col("image_id") + 1) % 6).cast("string")).alias("building_type"), (F.col("image_id") % 7 != 0).alias("ok"))
    first = first.select(F.col("image_id").alias("id"), "style_primary", "building_type", F.col("vlm").alias("confidence"), "tag_status", "stripped")
    v = vecs(spark, d)
    named = F.explode(F.array(F.concat(F.lit("style:Style_"), F.col("label").cast("string")), F.concat(F.lit("building_type:type_"), F.col("label").cast("string"))))
    keys = vectors.centroids(v, "label").select(named.alias("key"), F.col("vec").alias("key_vec"))
    neighbours = corpus(spark, d).select(F.col("image_id").alias("id"), F.col("style_primary").alias("style"), "building_type")
    out = tags.revalidated(first, second, keys, v, neighbours, ["style_primary", "building_type"], least_corpus=100)
    return out.select("id", "style_primary", "building_type", "tag_status", "final", F.array_join("stripped", ",").alias("stripped"))
