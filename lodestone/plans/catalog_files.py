"""Queries over files: Spark writes them from the given tables into the shared place, sinks and scans take them from there."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import evaluation, ranking
from lodestone.plans.catalog_stream import workspace
from lodestone.plans.catalog_text import CHUNKS, chunks
from lodestone.plans.catalog_vectors import OWN, SCORE, VECS, corpus_facets, own_filters, vecs
from lodestone.plans.registry import query
from lodestone.plans.views import CORPUS, corpus, table
from lodestone.sources import scans, sinks
from lodestone.sources.named_files import write_named


@query("SELECT 'about ' || lang || ' ' || doc_id AS query, CAST(len(CASE WHEN doc_id % 3 = 0 THEN [] ELSE [1, 2] END) AS INTEGER) AS n_relevant, CASE WHEN doc_id % 2 = 0 THEN lang END AS country, source AS notes FROM documents")
def s05_golden(spark, d):
    """A golden file with a line per document, and lines to be skipped."""
    home, t = workspace(spark), table(spark, d, "documents")
    relevant = F.when(F.col("doc_id") % 3 != 0, F.array(F.lit("a"), F.lit("b")))
    filters = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("country"), F.col("lang")))
    row = F.struct(F.concat(F.lit("about "), "lang", F.lit(" "), F.col("doc_id").cast("string")).alias("query"), relevant.alias("relevant_image_ids"), filters.alias("filters"), F.col("source").alias("notes"))
    lines = t.select(F.to_json(row).alias("value")).unionByName(t.select(F.concat(F.lit("# "), F.col("doc_id").cast("string")).alias("value"))).unionByName(t.select(F.lit("").alias("value")))
    lines.write.text(f"{home}/golden")
    return scans.golden(spark, f"{home}/golden").select("query", F.size("relevant").alias("n_relevant"), F.try_element_at(F.try_element_at("filters", F.lit("country")), F.lit(1)).alias("country"), "notes")


METRICS = ["mrr", *[f"{m}_{k}" for k in (5, 10, 20) for m in ("p", "r", "hit", "ndcg")]]
GOLDEN = f"WITH {VECS}, {CORPUS}, z AS (SELECT q.id AS qid, w.id, {SCORE.replace('c.vec', 'w.vec')} AS score FROM v q JOIN corpus c ON {OWN} JOIN v w ON w.id = c.image_id WHERE q.id % 100 = 0), hits AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM z QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= 20), "
GOLDEN += "rel AS (SELECT q.id AS qid, c.id FROM v q JOIN v c ON q.label = c.label AND q.id % 100 = 0 AND q.id % 300 <> 0), nr AS (SELECT qid, count(*) AS n_rel FROM rel GROUP BY 1), m AS (SELECT hits.*, CASE WHEN rel.id IS NULL THEN 0 ELSE 1 END AS rel FROM hits LEFT JOIN rel ON rel.qid = hits.qid AND rel.id = hits.id), pq AS (SELECT nr.qid, round(coalesce(1.0::DOUBLE / min(CASE WHEN rel = 1 THEN rank END), 0), 6) AS mrr, "
GOLDEN += ", ".join(f"round(coalesce(sum(CASE WHEN rank <= {k} THEN rel ELSE 0 END) / nullif(count(CASE WHEN rank <= {k} THEN 1 END), 0)::DOUBLE, 0), 6) AS p_{k}, round(sum(CASE WHEN rank <= {k} THEN rel ELSE 0 END) / any_value(n_rel)::DOUBLE, 6) AS r_{k}, CAST(max(CASE WHEN rank <= {k} THEN rel ELSE 0 END) AS INTEGER) AS hit_{k}, round(sum(CASE WHEN rank <= {k} THEN rel / log2(rank + 1) ELSE 0 END) / list_sum(list_transform(range(1, least(any_value(n_rel), {k}) + 1), lambda i: 1.0::DOUBLE / log2(i + 1))), 6) AS ndcg_{k}" for k in (5, 10, 20))
GOLDEN += " FROM nr LEFT JOIN m ON nr.qid = m.qid GROUP BY 1) SELECT " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in METRICS) + ", count(*) AS n_labelled, (SELECT count(*) FROM v WHERE id % 100 = 0) - count(*) AS n_unlabelled FROM pq"


@query(GOLDEN)
def a13_golden_run(spark, d):
    """The evaluation of a golden file: its queries with filters of their own are searched, and the metrics of the labelled ones averaged."""
    home, v = workspace(spark), vecs(spark, d)
    asked = own_filters(v.where(F.col("id") % 100 == 0).withColumnRenamed("id", "qid"))
    same = v.groupBy("label").agg(F.collect_list(F.col("id").cast("string")).alias("ids"))  # a class of the golden file's answers
    lines = asked.join(same, "label").select(F.concat(F.lit("q"), F.col("qid").cast("string")).alias("query"), F.when(F.col("qid") % 300 != 0, F.col("ids")).alias("relevant_image_ids"), "filters")
    lines.select(F.to_json(F.struct("*")).alias("value")).write.text(f"{home}/golden")
    rows = scans.golden(spark, f"{home}/golden").withColumn("qid", F.substring("query", 2, 20).cast("long"))
    queries = rows.join(v.select(F.col("id").alias("qid"), "vec"), "qid").select("qid", "vec", "filters")
    hits = ranking.filtered_knn(queries, v.select("id", "vec"), corpus(spark, d), 20, facets=corpus_facets())
    relevant = rows.select("qid", F.explode(F.col("relevant").cast("array<bigint>")).alias("id"))
    return evaluation.mean_metrics(evaluation.retrieval_metrics(hits, relevant), rows)


@query("SELECT 'url' AS kind, loc FROM (SELECT url || '?p=' || page_id AS loc FROM pages ORDER BY loc LIMIT 500)")
def s10_sitemap(spark, d):
    """The sitemap of all pages; a scan gives 500 addresses at most."""
    home, t = workspace(spark), table(spark, d, "pages")
    loc = F.concat("url", F.lit("?p="), F.col("page_id").cast("string"))
    t.select(loc.alias("loc")).write.format("xml").option("rowTag", "url").option("rootTag", "urlset").save(f"{home}/sitemap")
    return scans.sitemap(spark, f"{home}/sitemap")


@query("WITH f AS (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS p FROM documents), s AS (SELECT sha256(text) AS k FROM documents WHERE source = 'src0') SELECT doc_id, sha256(text) AS sha FROM f WHERE p = 1 AND sha256(text) NOT IN (SELECT k FROM s)")
def s12_insert_if_absent(spark, d):
    """What the sink adds, in two runs of which the second changes nothing, to a table that holds one source already."""
    home, rows = workspace(spark), table(spark, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("sha"))
    stored = rows.where("source = 'src0'")
    for part in (stored, rows, rows):
        sinks.insert_if_absent(part, f"{home}/images", "sha", "doc_id")
    return spark.read.parquet(f"{home}/images").join(stored.select("sha"), "sha", "left_anti").select("doc_id", "sha")


@query(f"WITH {CHUNKS}, old AS (SELECT doc_id // 2 AS doc, doc_id AS v FROM documents) SELECT doc, count(*) AS n, 'new' AS kind FROM chunks GROUP BY 1 UNION ALL SELECT doc, count(*), 'old' FROM old WHERE doc NOT IN (SELECT doc FROM chunks) GROUP BY 1")
def s13_replace_by_key(spark, d):
    """The table after the chunks of all chunked documents replaced their old rows."""
    home = workspace(spark)
    sinks.replace_by_key(table(spark, d, "documents").select(F.expr("doc_id div 2").alias("doc"), F.lit("old").alias("kind")), f"{home}/chunks", "doc")
    sinks.replace_by_key(chunks(spark, d).select("doc", F.lit("new").alias("kind")), f"{home}/chunks", "doc")
    return spark.read.parquet(f"{home}/chunks").groupBy("doc", "kind").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey, s_name, CAST(s_nationkey AS INTEGER) AS s_nationkey, s_suppkey || '.json' AS file FROM supplier")
def s14_json_sidecars(spark, d):
    """A sidecar file for each supplier, named by its key, read back."""
    home, t = workspace(spark), table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    sinks.write_sidecars(t, "s_suppkey", f"{home}/sidecars")
    meta = F.from_json("value", "s_suppkey long, s_name string, s_nationkey int").alias("m")
    return spark.read.text(f"{home}/sidecars", wholetext=True).select(meta, F.col("_metadata.file_name").alias("file")).select("m.s_suppkey", "m.s_name", "m.s_nationkey", "file")


@query("SELECT 'class_' || (doc_id % 5) AS label, doc_id || CASE WHEN doc_id % 3 = 0 THEN '.PNG' ELSE '.jpg' END AS file, CAST(8 + octet_length(encode(coalesce(text, ''))) AS BIGINT) AS length FROM documents WHERE doc_id % 4 <> 0")
def s01_image_files(spark, d):
    """Files in a folder for each class, a fourth of them no pictures by their names, scanned with their classes."""
    home, t = workspace(spark), table(spark, d, "documents")
    i = F.col("doc_id")
    kind = F.when(i % 4 == 0, ".txt").when(i % 3 == 0, ".PNG").otherwise(".jpg")
    name = F.concat(F.lit("class_"), (i % 5).cast("string"), F.lit("/"), i.cast("string"), kind)
    write_named(t, f"{home}/images", name, F.concat(F.lit(b"\x89PNG\r\n\x1a\n"), F.encode(F.coalesce("text", F.lit("")), "UTF-8")))
    files = scans.image_files(spark, f"{home}/images", labelled=True)
    return files.select("label", F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "length")


@query("SELECT file, length, CASE WHEN length > 2000 THEN 'too large' ELSE 'ok' END AS outcome FROM (SELECT 'p' || lpad(CAST(page_id AS VARCHAR), 9, '0') || '.jpg' AS file, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS length FROM pages WHERE page_id % 5 <> 0 ORDER BY 1 LIMIT 200)")
def s03_listing(spark, d):
    """A bucket of pages under picture names in folders of their own, a fifth of another kind; the listing stops at its cap of 200."""
    home, t = workspace(spark), table(spark, d, "pages")
    name = F.concat(F.lit("all/p"), F.lpad(F.col("page_id").cast("string"), 9, "0"), F.when(F.col("page_id") % 5 == 0, ".html").otherwise(".jpg"))
    write_named(t, f"{home}/bucket", name, F.coalesce("html", F.lit("")))
    found = scans.listing(spark, f"{home}/bucket", largest=2000)
    return found.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "length", "outcome")


UUID = "substring(md5('{0}' || {1}), 1, 8) || '-' || substring(md5('{0}' || {1}), 9, 4) || '-' || substring(md5('{0}' || {1}), 13, 4) || '-' || substring(md5('{0}' || {1}), 17, 4) || '-' || substring(md5('{0}' || {1}), 21, 12)".format("u", "doc_id")


@query(f"SELECT CASE WHEN doc_id % 11 = 0 THEN 'image ' || doc_id ELSE {UUID} END AS id, CASE WHEN doc_id % 11 = 0 THEN 'bad name' WHEN doc_id % 7 = 0 THEN 'bad json' ELSE 'ok' END AS outcome, CASE WHEN doc_id % 7 <> 0 THEN lang END AS lang, CASE WHEN doc_id % 7 <> 0 THEN CAST(doc_id AS INTEGER) END AS number FROM documents")
def s04_sidecar_scan(spark, d):
    """A metadata file for each document under a UUID, some with bad JSON and some with other names, scanned with outcomes."""
    home, t = workspace(spark), table(spark, d, "documents")
    i = F.col("doc_id")
    stem = F.when(i % 11 == 0, F.concat(F.lit("image "), i.cast("string"))).otherwise(F.regexp_replace(F.md5(F.concat(F.lit("u"), i.cast("string"))), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))
    body = F.when(i % 7 == 0, F.lit('{"lang": ')).otherwise(F.to_json(F.struct("lang", i.alias("number"))))
    write_named(t, f"{home}/metadata", F.concat(stem, F.lit(".json")), body)
    return scans.sidecars(spark, f"{home}/metadata", "lang string, number int").select("id", "outcome", "meta.lang", "meta.number")


@query("SELECT 'oai:' || doc_id AS identifier, 'Title ' || doc_id AS title, CAST(CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS INTEGER) AS n_creators, 'http://h/' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.PDF' ELSE '' END AS source_url, CASE WHEN doc_id % 3 = 0 THEN 'http://h/' || doc_id || '.PDF' END AS image_url, CAST(1900 + doc_id % 100 AS INTEGER) AS year FROM documents WHERE doc_id % 9 <> 4 AND (doc_id % 3 = 0 OR doc_id % 5 = 0)")
def s06_oai_theses(spark, d):
    """Saved OAI-PMH answers with namespaces, a hundred records each, some deleted; theses and records with a PDF, with their year."""
    home, t = workspace(spark), table(spark, d, "documents")
    i = F.col("doc_id").cast("string")
    tag = lambda name, *value: F.concat(F.lit(f"<dc:{name}>"), *value, F.lit(f"</dc:{name}>"))
    when = lambda n, value: F.when(F.col("doc_id") % n == 0, value).otherwise(F.lit(""))
    dc = F.concat(
        F.lit('<metadata><oai_dc:dc xmlns:oai_dc="http://www.openarchives.org/OAI/2.0/oai_dc/" xmlns:dc="http://purl.org/dc/elements/1.1/">'), tag("title", F.lit("Title "), i), tag("creator", F.lit("A. One")), when(2, tag("creator", F.lit("B. Two"))),
        tag("subject", F.lit("Towns")), when(5, tag("subject", F.lit("Doctoral Thesis"))), tag("date", F.lit("n.d.")), tag("date", (1900 + F.col("doc_id") % 100).cast("string"), F.lit("-05")),
        tag("identifier", F.lit("local/"), i), tag("identifier", F.lit("http://h/"), i, when(3, F.lit(".PDF"))), F.lit("</oai_dc:dc></metadata>"),
    )
    gone = F.col("doc_id") % 9 == 4
    record = F.concat(F.lit("<record><header"), F.when(gone, ' status="deleted"').otherwise(""), F.lit("><identifier>oai:"), i, F.lit("</identifier></header>"), F.when(gone, "").otherwise(dc), F.lit("</record>"))
    answers = t.groupBy(F.expr("doc_id div 100").alias("page")).agg(F.concat_ws("", F.collect_list(record)).alias("records"))  # a hundred records at most
    write_named(answers, f"{home}/oai", F.concat(F.lit("answer-"), F.col("page").cast("string"), F.lit(".xml")), F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><OAI-PMH xmlns="http://www.openarchives.org/OAI/2.0/"><ListRecords>'), "records", F.lit("</ListRecords></OAI-PMH>")))
    rows = scans.thesis_rows(scans.oai_records(spark, f"{home}/oai"), [])
    return rows.select("identifier", "title", F.size("creators").alias("n_creators"), "source_url", "image_url", "year")
