"""Queries over the image table: filters, facets, listings, curation, joins, sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import curation, facets, filters, tags
from lodestone.plans.registry import query
from lodestone.plans.views import CORPUS, HASHES, corpus, hashes, table
from lodestone.sources import scans, sinks

C = f"WITH {CORPUS} "


@query(C + "SELECT image_id, year_built FROM corpus WHERE year_built BETWEEN 1850 AND 1950")
def f01_period(spark, d):
    return corpus(spark, d).where(filters.period("year_built", (1850, 1950))).select("image_id", "year_built")


@query(C + "SELECT image_id, building_type FROM corpus WHERE building_type ILIKE '%type_1%' OR building_type ILIKE '%TYPE_3%'")
def f02_typology(spark, d):
    c = corpus(spark, d)
    return c.where(filters.typology(["type_1", "TYPE_3"], F.array("building_type"), F.col("building_type"))).select("image_id", "building_type")


@query(C + "SELECT image_id, array_to_string(materials, ',') AS materials FROM corpus WHERE array_to_string(materials, ',') ILIKE '%glass%' OR array_to_string(materials, ',') ILIKE '%steel%'")
def f03_material(spark, d):
    return corpus(spark, d).where(filters.material(["glass", "steel"], "materials")).select("image_id", F.array_join("materials", ",").alias("materials"))


@query(C + "SELECT image_id, location_country FROM corpus WHERE lower(location_country) = 'en'")
def f04_country(spark, d):
    return corpus(spark, d).where(filters.country("EN", "location_country")).select("image_id", "location_country")


@query(C + "SELECT image_id, material_1 FROM corpus WHERE replace(material_1, '_', ' ') ILIKE '%reinforced concrete%' OR replace(material_1, '_', ' ') ILIKE '%timber%'")
def f05_structural_system(spark, d):
    return corpus(spark, d).where(filters.one_or_more(["reinforced_concrete", "timber"], F.replace("material_1", F.lit("_"), F.lit(" ")))).select("image_id", "material_1")


@query(C + "SELECT image_id, location_country FROM corpus WHERE location_country ILIKE '%f%'")
def f06_climate_zone(spark, d):
    return corpus(spark, d).where(filters.one_or_more("f", "location_country")).select("image_id", "location_country")


@query(C + "SELECT image_id, style_primary FROM corpus WHERE replace(lower(style_primary), '_', ' ') IN ('style 3', 'style 7')")
def f07_style(spark, d):
    return corpus(spark, d).where(filters.style(["style_3", "Style 7"], F.col("style_primary"))).select("image_id", "style_primary")


@query(C + "SELECT image_id, owner FROM corpus WHERE owner = 'owner_1' OR owner IS NULL")
def f12_owner_documents(spark, d):
    return corpus(spark, d).where(filters.visible("owner_1")).select("image_id", "owner")


@query(C + "SELECT image_id, owner FROM corpus WHERE owner = 'owner_1'")
def f12_owner_images(spark, d):
    return corpus(spark, d).where(filters.visible("owner_1", shared=False)).select("image_id", "owner")


@query(C + "SELECT ingest_status, CAST(count(*) AS BIGINT) AS n, CAST(count(CASE WHEN ingest_status IN ('queued','indexing','failed') OR (ingest_status = 'ready' AND tag_status IS NULL) THEN 1 END) AS BIGINT) AS needs FROM corpus GROUP BY 1")
def f13_status(spark, d):
    needs = filters.needs_index("ingest_status", F.when(F.col("tag_status").isNotNull(), 1))
    return corpus(spark, d).groupBy("ingest_status").agg(F.count("*").alias("n"), F.count_if(needs).alias("needs"))


@query(C + "SELECT image_id, name, coalesce(year_built, 0) AS year_built, coalesce(array_to_string(materials, '|'), '') AS materials, coalesce(nullif(trim(name), ''), building_type) AS description, round(image_id / 7.0, 4) AS score FROM corpus")
def f14_result_projection(spark, d):
    meta = F.struct("name", F.coalesce("year_built", F.lit(0)).alias("year_built"))
    out = corpus(spark, d).select("image_id", meta.alias("metadata"), F.coalesce("materials", F.array().cast("array<string>")).alias("m"), F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.col("building_type")).alias("description"), F.round(F.col("image_id") / 7.0, 4).alias("score"))
    return out.select("image_id", "metadata.name", "metadata.year_built", F.array_join("m", "|").alias("materials"), "description", "score")


@query(C + "SELECT image_id, style_primary, year_built FROM corpus WHERE contains(replace(lower(style_primary), '_', ' '), 'style') AND location_country = 'en' AND (year_built IS NULL OR year_built BETWEEN 1900 AND 2000)")
def f15_library_filter(spark, d):
    c = corpus(spark, d)
    keep = filters.library_filter(F.col("style_primary"), F.col("building_type"), F.col("location_country"), F.col("year_built"), style="Style", country="en", between=(1900, 2000))
    return c.where(keep).select("image_id", "style_primary", "year_built")


@query(C + "SELECT image_id, array_to_string(list_filter(materials, lambda t: t IS NOT NULL AND (contains(lower(t), 'gla') OR contains(lower(t), 'slate'))), ',') AS hit FROM corpus")
def f23_highlighted_tags(spark, d):
    return corpus(spark, d).select("image_id", F.array_join(filters.highlighted(F.array_compact("materials"), "Gla,  slate"), ",").alias("hit"))


@query(C + "SELECT image_id, CAST(owner IS NULL AS INTEGER) AS ephemeral FROM corpus")
def f25_stored_first(spark, d):
    """Stored items before ephemeral ones: a flag and a sort by ranges of (flag, id)."""
    return corpus(spark, d).select("image_id", F.col("owner").isNull().cast("int").alias("ephemeral")).orderBy("ephemeral", "image_id")


@query("SELECT coalesce(source, '') AS source, CAST(count(*) AS BIGINT) AS n, bool_or(length(text) > 2000) AS has_long, CAST(count(CASE WHEN length(text) > 0 THEN 1 END) AS BIGINT) AS ready FROM documents GROUP BY 1")
def f26_readiness(spark, d):
    t = table(spark, d, "documents")
    return t.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count("*").alias("n"), F.bool_or(F.length("text") > 2000).alias("has_long"), F.count_if(F.length("text") > 0).alias("ready"))


def _facet(value: str, n: int, rows: str = "corpus WHERE ingest_status = 'ready'") -> str:
    return C + f"SELECT {value} AS value, CAST(count(*) AS BIGINT) AS n FROM {rows} GROUP BY 1 HAVING value IS NOT NULL AND value NOT IN ('', 'null') ORDER BY n DESC, value LIMIT {n}"


@query(_facet("replace(lower(trim(style_primary)), '_', ' ')", 30))
def a01_style_facet(spark, d):
    return facets.style_facet(corpus(spark, d))


@query(_facet("replace(lower(trim(building_type)), '_', ' ')", 10))
def a02_building_type_facet(spark, d):
    return facets.building_type_facet(corpus(spark, d))


@query(C + "SELECT lower(m) AS value, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(materials) AS m FROM corpus WHERE ingest_status = 'ready') GROUP BY 1 HAVING value IS NOT NULL AND value <> '' ORDER BY n DESC, value LIMIT 30")
def a03_material_facet(spark, d):
    return facets.material_facet(corpus(spark, d))


@query(C + ", vals AS (SELECT unnest(['glass','Slate','oak','type_2','stone']) AS value) SELECT value, CAST((SELECT count(*) FROM corpus WHERE contains(lower(concat_ws(' ', array_to_string(materials, ' '), building_type)), lower(value))) AS BIGINT) AS n FROM vals")
def a04_contained_counts(spark, d):
    values = spark.createDataFrame([(v,) for v in ("glass", "Slate", "oak", "type_2", "stone")], "value string")
    return facets.contained_counts(corpus(spark, d), values, [F.array_join("materials", " "), F.col("building_type")])


STATUS_SQL = C + ", s AS (SELECT unnest(['verified','provisional','quarantined','unvalidated']) AS tag_status), n AS (SELECT s.tag_status, CAST(count(c.image_id) AS BIGINT) AS n FROM s LEFT JOIN corpus c ON coalesce(c.tag_status, 'unvalidated') = s.tag_status GROUP BY 1) "


@query(STATUS_SQL + "SELECT * FROM n")
def a05_status_counts(spark, d):
    return facets.status_counts(corpus(spark, d))


@query(STATUS_SQL + "SELECT *, round(100.0::DOUBLE * n / greatest(sum(n) OVER (), 1), 4) AS percent FROM n")
def a06_status_shares(spark, d):
    return facets.status_shares(corpus(spark, d))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, ts FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 50")
def a07_newest_diagnostics(spark, d):
    rows = table(spark, d, "events").where("event_type = 'error'")
    return facets.newest(rows.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), "ts"), [F.desc("ts"), F.col("event_id")], 50)


@query("SELECT CAST(count(*) AS BIGINT) AS n, max(ts) AS newest, CAST((SELECT count(*) FROM embeddings) AS BIGINT) AS n_vectors FROM events")
def a08_corpus_stats(spark, d):
    return facets.corpus_stats(table(spark, d, "events"), "ts", ("vectors", table(spark, d, "embeddings")))


OUTCOME = "CASE WHEN event_type = 'error' THEN 'failed' WHEN value < 5 THEN 'duplicate' ELSE 'ok' END"


def _outcomes(spark, d):
    return table(spark, d, "events").withColumn("outcome", F.expr(OUTCOME))


SUMMARY = "CAST(count(*) AS BIGINT) AS total, CAST(count(CASE WHEN o = 'ok' THEN 1 END) AS BIGINT) AS ok, CAST(count(CASE WHEN o = 'duplicate' THEN 1 END) AS BIGINT) AS duplicate, CAST(count(CASE WHEN o = 'failed' THEN 1 END) AS BIGINT) AS failed, CAST(CASE WHEN count(CASE WHEN o = 'failed' THEN 1 END) = 0 THEN 0 WHEN count(CASE WHEN o = 'failed' THEN 1 END) < count(*) THEN 1 ELSE 2 END AS INTEGER) AS exit_class"


@query(f"SELECT {SUMMARY} FROM (SELECT {OUTCOME} AS o FROM events)")
def a09_run_summary(spark, d):
    return facets.run_summary(_outcomes(spark, d), "outcome")


@query(f"SELECT event_id, event_type, value FROM events WHERE {OUTCOME} = 'failed'")
def a09_failed_records(spark, d):
    return facets.failed_records(_outcomes(spark, d), "outcome", "event_id", "event_type", "value")


@query(f"SELECT event_type, {SUMMARY} FROM (SELECT event_type, {OUTCOME} AS o FROM events) GROUP BY 1")
def a10_ingest_result(spark, d):
    return facets.run_summary(_outcomes(spark, d), "outcome", "event_type")


EDGES = [50.0, 100.0, 200.0, 500.0, 1000.0, 2000.0, 5000.0]


@query("SELECT le, CAST((SELECT count(*) FROM events WHERE value * 20 <= le) AS BIGINT) AS n FROM (SELECT unnest([50.0,100.0,200.0,500.0,1000.0,2000.0,5000.0]::DOUBLE[]) AS le) UNION ALL SELECT NULL, CAST(count(value) AS BIGINT) FROM events")
def a21_latency_buckets(spark, d):
    return facets.cumulative_buckets(table(spark, d, "events"), F.col("value") * 20, EDGES)


@query("SELECT user_id, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE -1 END) AS BIGINT) AS rating, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END), 6) AS up_share FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1")
def a30_ratings(spark, d):
    return facets.ratings(table(spark, d, "events"), "user_id", F.col("event_type") == "purchase", F.col("event_type") == "error")


@query("SELECT o_orderkey, substring(o_orderpriority, 1, 2) || row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS instance FROM orders")
def a31_label_counters(spark, d):
    return facets.numbered_labels(table(spark, d, "orders"), "o_custkey", "o_orderpriority", "o_orderkey").select("o_orderkey", "instance")


@query(C + "SELECT image_id, year_built, (SELECT count(*) FROM corpus) AS total FROM corpus ORDER BY year_built DESC NULLS LAST, image_id LIMIT 20 OFFSET 10")
def w01_listing(spark, d):
    return scans.listed_page(corpus(spark, d), "year_desc", "image_id", "image_id", "year_built", 10, 20).select("image_id", "year_built", "total")


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS p FROM events) WHERE p = 1")
def w04_best_per_parent(spark, d):
    return curation.first_of_each(table(spark, d, "events").withColumn("neg", -F.col("value")), "user_id", "neg", "event_id").select("user_id", "event_id", "value")


@query("SELECT user_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY f, event_type) - 1 AS INTEGER) AS position FROM (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY 1, 2)")
def w05_ordered_distinct(spark, d):
    return scans.in_order(table(spark, d, "events"), "user_id", "event_type", "event_id")


@query("SELECT event_id, ts FROM events WHERE event_id > 137 ORDER BY event_id LIMIT 50")
def w07_keyset_page(spark, d):
    return scans.after_cursor(table(spark, d, "events"), "event_id", 137, 50).select("event_id", "ts")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 100")
def w08_batch_queue(spark, d):
    return curation.batch_queue(table(spark, d, "orders"), F.col("o_orderstatus") == "P", "o_orderdate", "o_orderkey", 100).select("o_orderkey", "o_orderdate")


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 8")
def w16_recent(spark, d):
    return facets.newest(table(spark, d, "events").select("event_id", "ts"), [F.desc("ts"), F.col("event_id")], 8)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (3, 500, 777777)")
def s11_point_lookup(spark, d):
    return scans.by_id(table(spark, d, "orders"), "o_orderkey", 3, 500, 777777).select("o_orderkey", "o_totalprice")


@query("SELECT doc_id, source FROM documents WHERE coalesce(source, '') NOT IN (SELECT DISTINCT source FROM documents WHERE n_chars > 20000 AND source IS NOT NULL)")
def s18_cascade_delete(spark, d):
    t = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    return sinks.delete_cascade(t.where("n_chars > 20000"), "source", t.select("doc_id", "source"))[0]


@query("SELECT vec_id AS id, CAST(len(embedding) AS INTEGER) AS dim FROM embeddings")
def s15_vector_version(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.lit(0).alias("added_at"))
    both = e.unionByName(e.withColumn("added_at", F.lit(1)))  # added twice: the later one stays
    return sinks.vector_version(both, "v1", 64).select("id", F.size("vec").alias("dim"))


@query("SELECT CAST(count(e.vec_id) AS BIGINT) AS indexed, CAST(count(*) - count(e.vec_id) AS BIGINT) AS failed, CAST(count(*) AS BIGINT) AS total FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id")
def s16_rebuild(spark, d):
    images = table(spark, d, "documents").select(F.col("doc_id").alias("image_id"))
    return sinks.rebuilt(images, table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")))[1]


@query("SELECT outcome, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN d.doc_id % 50 = 7 THEN 'bad json' WHEN e.vec_id IS NOT NULL THEN 'present' WHEN d.source = 'src1' OR d.source IS NULL THEN 'no file' WHEN sha256(d.text) IN (SELECT sha256(x.text) FROM documents x JOIN embeddings y ON x.doc_id = y.vec_id) THEN 'duplicate' ELSE 'restored' END AS outcome FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id) GROUP BY 1")
def s17_restore(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("path"), F.sha2("text", 256).alias("sha256"), F.when(F.col("doc_id") % 50 == 7, "bad json").otherwise("ok").alias("outcome"))
    stored = docs.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("id")), "id", "left_semi")
    files = docs.select("path").where("path <> 'src1'").distinct()
    return sinks.restorable(docs, stored, files).groupBy("outcome").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 400000")
def j02_child_with_parent(spark, d):
    """A child table with its parents, restricted to hits."""
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    hits = o.where("o_totalprice > 400000").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return curation.with_parents(hits, c.withColumnRenamed("c_nationkey", "n_nationkey"), n, "c_custkey", "n_nationkey").select("o_orderkey", "c_name", "n_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice > 300000)")
def j04_backfill(spark, d):
    """Customers without a large order."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders").where("o_totalprice > 300000")
    return curation.without_rows(c, "c_custkey", o, "o_custkey").select("c_custkey")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j05_not_yet_done(spark, d):
    return curation.without_rows(table(spark, d, "documents").select("doc_id"), "doc_id", table(spark, d, "labels"), "doc_id")


@query(C + ", b AS (SELECT doc_id AS image_id, CAST(1700 + doc_id % 100 AS INTEGER) AS year_built, lang || '_b' AS owner FROM documents) SELECT c.image_id, coalesce(c.year_built, b.year_built) AS year_built, coalesce(c.owner, b.owner) AS owner FROM corpus c LEFT JOIN b ON c.image_id = b.image_id")
def j06_coalesce_update(spark, d):
    b = table(spark, d, "documents").select(F.col("doc_id").alias("image_id"), (1700 + F.col("doc_id") % 100).cast("int").alias("year_built"), F.concat("lang", F.lit("_b")).alias("owner"))
    return curation.coalesce_update(corpus(spark, d).select("image_id", "year_built", "owner"), b, ["image_id"], ["year_built", "owner"])


HAM = f"WITH {HASHES}, n AS (SELECT doc_id, CAST('0x' || phash AS UHUGEINT) AS h FROM hashes), p AS (SELECT a.doc_id AS a, b.doc_id AS b, CAST(bit_count(CAST(xor(a.h, b.h) & 9223372036854775807 AS BIGINT)) + CAST(xor(a.h, b.h) >> 63 AS BIGINT) AS INTEGER) AS distance FROM n a JOIN n b ON a.doc_id < b.doc_id AND a.doc_id // 4 = b.doc_id // 4) "


@query(HAM.replace(" AND a.doc_id // 4 = b.doc_id // 4", "") + "SELECT b AS doc_id, min(a) AS near_duplicate_of, CAST(arg_min(distance, a) AS INTEGER) AS distance FROM p WHERE distance < 10 GROUP BY 1")
def j08_near_duplicates(spark, d):
    return curation.near_duplicate_of(hashes(spark, d), "doc_id", "phash")


@query("SELECT r.r_id, r.position, 'IMG-' || (r.position + 1) AS label, d.n_chars FROM (SELECT doc_id AS r_id, unnest([doc_id, doc_id // 2, doc_id // 3]) AS want, generate_subscripts([1, 2, 3], 1) - 1 AS position FROM documents) r JOIN documents d ON r.want = d.doc_id")
def j10_ordered_lookup(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    requests = docs.select(F.col("doc_id").alias("r_id"), F.array(F.col("doc_id"), F.expr("doc_id div 2"), F.expr("doc_id div 3")).alias("ids"))
    return curation.ordered_lookup(requests, docs, "ids", "doc_id").select("r_id", F.col("position").cast("long").alias("position"), "label", "n_chars")


@query(C + ", f AS (SELECT image_id, unnest([material_1, material_2, building_type]) AS v FROM corpus), p AS (SELECT DISTINCT a.image_id, b.image_id AS related FROM f a JOIN f b ON a.v = b.v AND a.image_id <> b.image_id) SELECT image_id, related, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY related) AS place FROM p) WHERE place <= 6")
def j11_related_by_overlap(spark, d):
    c = corpus(spark, d).withColumn("tags", F.array("material_1", "material_2", "building_type"))
    return curation.related_by_overlap(c, "image_id", ["tags"])


@query("SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS has_rows FROM documents")
def j13_already_done(spark, d):
    docs, done = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id").distinct()
    have = docs.join(done, "doc_id", "left_semi").withColumn("has_rows", F.lit(True))
    return have.unionByName(docs.join(done, "doc_id", "left_anti").withColumn("has_rows", F.lit(False)))


@query("SELECT 'customer' AS kind, c_name AS name, c_acctbal AS acctbal, NULL AS size FROM customer UNION ALL SELECT 'supplier', s_name, s_acctbal, NULL FROM supplier UNION ALL SELECT 'part', p_name, NULL, p_size FROM part")
def u01_union_sources(spark, d):
    c = table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"))
    s = table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal"))
    p = table(spark, d, "part").select(F.lit("part").alias("kind"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    return curation.union_sources(c, s, p)


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS sha FROM documents GROUP BY 2 HAVING NOT bool_or(coalesce(source, '') = 'src2')")
def u02_exact_duplicates(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.sha2("text", 256).alias("sha"))
    return curation.new_by_digest(rows, rows.where("source = 'src2'"), "sha", "doc_id").select("doc_id", "sha")


@query("SELECT DISTINCT lang, source FROM documents")
def u03_distinct_prompts(spark, d):
    return curation.distinct_prompts(table(spark, d, "documents"), "lang", "source")


@query("SELECT 0 AS tier, s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT 1, c_custkey, c_name FROM customer")
def u04_tiers(spark, d):
    return curation.tiers(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))).select("tier", "id", "name")


@query("SELECT CAST(json_extract(props, '$.k') AS INTEGER) AS item, arg_max(event_type, event_id) AS payload FROM events GROUP BY 1 HAVING count(*) % 2 = 1")
def u05_favourites(spark, d):
    e = table(spark, d, "events").select(F.get_json_object("props", "$.k").cast("int").alias("item"), "event_id", F.col("event_type").alias("payload"))
    return curation.favourites(e, "item", ["event_id"], "payload")


@query(C + "SELECT image_id, replace(lower(trim(style_primary)), '_', ' ') AS style FROM corpus")
def t01_normal_label(spark, d):
    return corpus(spark, d).select("image_id", filters.normal("style_primary").alias("style"))


N = "replace(lower(trim({})), '_', ' ')"


@query(C + f"SELECT image_id, 'style:' || style_primary AS key, 'a photo of a ' || {N.format('style_primary')} || ' ' || {N.format('building_type')} || ' building' AS prompt FROM corpus WHERE style_primary IS NOT NULL UNION ALL SELECT image_id, 'building_type:' || building_type, 'a photo of a ' || {N.format('building_type')} || ' building' FROM corpus UNION ALL SELECT image_id, 'material:' || m, 'a photo of a building made of ' || {N.format('m')} FROM (SELECT image_id, unnest(materials) AS m FROM corpus) WHERE m IS NOT NULL")
def t02_tag_prompts(spark, d):
    made = tags.prompts(F.col("style_primary"), F.col("building_type"), F.col("materials"))
    return corpus(spark, d).select("image_id", F.inline(made))


SIGNALS = ", s AS (SELECT image_id, style_primary, building_type, (image_id % 30) / 100.0::DOUBLE AS cs, (image_id % 41) / 100.0::DOUBLE AS ct, CASE WHEN image_id % 5 <> 0 THEN image_id % 11 END AS sv, CASE WHEN image_id % 5 <> 0 THEN image_id % 3 END AS tv, (image_id % 13) / 12.0::DOUBLE AS vlm FROM corpus), t AS (SELECT *, CASE WHEN cs < 0.12 AND sv <= 1 THEN 'style:' || style_primary END AS a, CASE WHEN ct < 0.12 AND tv <= 1 THEN 'building_type:' || building_type END AS b FROM s) "


def _signals(spark, d):
    i = F.col("image_id")
    some = lambda n: F.when(i % 5 != 0, i % n)
    rows = corpus(spark, d).withColumns({"cs": (i % 30) / F.lit(100.0), "ct": (i % 41) / F.lit(100.0), "sv": some(11), "tv": some(3), "vlm": (i % 13) / F.lit(12.0)})
    return rows.withColumn("stripped", tags.conflicting(F.col("style_primary"), F.col("building_type"), F.col("cs"), F.col("ct"), F.col("sv"), F.col("tv")))


@query(C + SIGNALS + "SELECT image_id, concat_ws(',', a, b) AS stripped, CASE WHEN a IS NOT NULL OR b IS NOT NULL THEN 'quarantined' WHEN vlm >= 0.6 AND (cs >= 0.25 OR coalesce(sv >= 6, false)) THEN 'verified' ELSE 'provisional' END AS status FROM t")
def t05_decision(spark, d):
    s = _signals(spark, d)
    return s.select("image_id", F.array_join("stripped", ",").alias("stripped"), tags.decision(F.col("stripped"), F.col("vlm"), F.col("cs"), F.col("sv") >= 6).alias("status"))


@query(C + SIGNALS + "SELECT image_id, CASE WHEN a IS NOT NULL THEN '' ELSE style_primary END AS style_primary, CASE WHEN b IS NOT NULL THEN '' ELSE building_type END AS building_type FROM t")
def t06_strip(spark, d):
    return tags.strip_conflicting(_signals(spark, d)).select("image_id", "style_primary", "building_type")


@query(C + SIGNALS + "SELECT image_id, CASE WHEN a IS NULL AND b IS NULL THEN '' ELSE concat_ws(chr(10), CASE WHEN a IS NOT NULL THEN 'CLIP zero-shot scoring (score=None) and corpus neighbor consensus (' || sv || ' of 10 neighbors agree) suggest this building is NOT ''' || style_primary || ''' (style). Re-examine the visual evidence carefully before assigning style.' END, CASE WHEN b IS NOT NULL THEN 'CLIP zero-shot scoring (score=None) and corpus neighbor consensus (' || sv || ' of 10 neighbors agree) suggest this building is NOT ''' || building_type || ''' (building_type). Re-examine the visual evidence carefully before assigning building_type.' END) END AS said FROM t")
def t07_retry_instruction(spark, d):
    none = F.create_map().cast("map<string,double>")
    return _signals(spark, d).select("image_id", tags.retry_instruction(F.col("stripped"), none, F.col("sv"), F.lit(10)).alias("said"))


@query(C + ", z AS (SELECT doc_id, 'second_' || quality AS style_primary FROM labels) SELECT image_id, coalesce(z.style_primary, c.style_primary) AS style_primary, z.doc_id IS NOT NULL AS final FROM corpus c LEFT JOIN z ON c.image_id = z.doc_id")
def t08_second_pass(spark, d):
    second = table(spark, d, "labels").select(F.col("doc_id").alias("image_id"), F.concat(F.lit("second_"), F.col("quality").cast("string")).alias("style_primary"))
    return tags.second_pass(corpus(spark, d).select("image_id", "style_primary"), second, "image_id", ["style_primary"])


@query(C + "SELECT image_id, owner IS NULL OR coalesce(tag_status = 'quarantined', false) AS skipped FROM corpus")
def t09_skipped(spark, d):
    status = F.when(F.col("tag_status") == "quarantined", "not_applicable").otherwise(F.col("tag_status"))
    return corpus(spark, d).select("image_id", tags.skipped(F.col("owner"), status).alias("skipped"))


@query(C + "SELECT image_id, building_type <> 'type_5' AND (image_id % 13) / 12.0::DOUBLE >= 0.15 AS ok FROM corpus")
def t10_subject_gate(spark, d):
    kind = F.when(F.col("building_type") == "type_5", "not_applicable").otherwise(F.col("building_type"))
    return corpus(spark, d).select("image_id", tags.subject_ok(kind, (F.col("image_id") % 13) / F.lit(12.0)).alias("ok"))


@query("WITH RECURSIVE e AS (SELECT DISTINCT c_nationkey AS src, o_orderkey % 1000 + 100 AS dst FROM orders JOIN customer ON o_custkey = c_custkey UNION SELECT DISTINCT o_orderkey % 1000 + 100, 5000 + o_custkey % 300 FROM orders), w AS (SELECT 3 AS node, 0 AS depth UNION SELECT e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.node WHERE w.depth < 2) SELECT CAST(node AS BIGINT) AS node, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY 1")
def x33_bounded_traversal(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    first = o.join(c, o.o_custkey == c.c_custkey).select(F.col("c_nationkey").cast("long").alias("src"), (F.col("o_orderkey") % 1000 + 100).alias("dst"))
    second = o.select((F.col("o_orderkey") % 1000 + 100).alias("src"), (5000 + F.col("o_custkey") % 300).alias("dst"))
    return curation.reachable(first.union(second).distinct(), spark.range(3, 4).withColumnRenamed("id", "node"))


@query("WITH RECURSIVE e0 AS (SELECT DISTINCT user_id AS src, 1000 + CAST(json_extract(props, '$.k') AS INTEGER) AS dst FROM events UNION SELECT DISTINCT 1000 + CAST(json_extract(props, '$.k') AS INTEGER), user_id FROM events WHERE event_type = 'purchase' UNION SELECT DISTINCT 0, user_id FROM events), e AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS n FROM e0 WHERE dst IS NOT NULL) WHERE n <= 12), w AS (SELECT 0 AS node, 0 AS depth UNION SELECT e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.node WHERE w.depth < 6) SELECT CAST(node AS BIGINT) AS node, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY 1")
def x33_cyclic_with_hub(spark, d):
    """Users and the items of their events, with ways back (cycles) and a hub that leads to every user; a node leads to twelve at most."""
    e = table(spark, d, "events").select(F.col("user_id").cast("long").alias("user"), (1000 + F.get_json_object("props", "$.k").cast("long")).alias("item"), "event_type")
    edges = e.select(F.col("user").alias("src"), F.col("item").alias("dst")).union(e.where("event_type = 'purchase'").select("item", "user")).union(e.select(F.lit(0).cast("long"), "user"))
    return curation.reachable(edges, spark.range(1).withColumnRenamed("id", "node"), depth=6, fan_out=12)
