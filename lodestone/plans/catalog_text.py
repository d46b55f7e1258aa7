"""Queries over texts: chunks, search text, keys, model JSON, licences, pages, dialogue."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from lodestone.functions import licences, model_json, models, text
from lodestone.operators import rag, vectors
from lodestone.plans.catalog_vectors import nn
from lodestone.plans.registry import query
from lodestone.plans.views import CORPUS, corpus, table
from lodestone.sources import scans, sinks

C = f"WITH {CORPUS} "

CHUNKS = r"""chunks AS (SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY w) - 1 AS INTEGER) AS chunk_index, chunk FROM (
 SELECT doc, w, array_to_string(words[w * 337 + 1 : w * 337 + 375], ' ') AS chunk FROM (
  SELECT doc, words, unnest(range(0, CAST(greatest(ceil((len(words) - 375) / 337.0), 0) AS BIGINT) + 1)) AS w FROM (
   SELECT doc_id AS doc, string_split_regex(clean, '\s+') AS words FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[ \t]+', ' ', 'g'), '^\s+', ''), '\s+$', '') AS clean FROM documents) WHERE length(clean) >= 40)))
 WHERE length(chunk) >= 40)"""


def chunks(spark, d):
    return text.chunk_pages(table(spark, d, "documents").select("doc_id", F.lit(1).alias("page"), "text"), "doc_id", "page", "text")


@query(f"WITH {CHUNKS} SELECT doc, chunk_index, sha256(chunk) AS sha, CAST(length(chunk) AS INTEGER) AS n FROM chunks")
def x02_chunks(spark, d):
    return chunks(spark, d).select("doc", "chunk_index", F.sha2("chunk", 256).alias("sha"), F.length("chunk").alias("n"))


@query(f"WITH {CHUNKS} SELECT d.doc_id, CAST(count(c.doc) AS BIGINT) AS chunk_count, CASE WHEN count(c.doc) > 0 THEN 'ready' ELSE 'failed' END AS index_status FROM documents d LEFT JOIN chunks c ON c.doc = d.doc_id GROUP BY 1")
def a11_chunk_counts(spark, d):
    sources = table(spark, d, "documents").select(F.col("doc_id").alias("source_id"))
    out = sinks.chunk_counts(chunks(spark, d).withColumnRenamed("doc", "source_id"), sources)
    return out.select(F.col("source_id").alias("doc_id"), "chunk_count", "index_status")


@query(C + "SELECT image_id, replace(array_to_string(list_filter([text, building_type, style_primary, material_1, material_2, 'tag_' || class_id, 'tag_' || class_id], lambda x: x IS NOT NULL AND x <> ''), ' '), '_', ' ') AS search_text FROM corpus")
def x01_search_text(spark, d):
    tag = F.concat(F.lit("tag_"), F.col("class_id").cast("string"))
    made = text.search_text(*[text.as_list(F.col(c)) for c in ("text", "building_type", "style_primary")], F.col("materials"), text.as_list(tag), text.as_list(tag))
    return corpus(spark, d).select("image_id", made.alias("search_text"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha, substring(sha256(coalesce(text, '')), 1, 16) AS query_hash, sha256('{\"focus\":' || CASE WHEN lang IS NULL THEN 'null' ELSE '\"' || lang || '\"' END || ',\"image_ids\":[' || doc_id || ',' || (doc_id + 1) || '],\"v\":3}') AS cache_key FROM documents")
def x03_keys(spark, d):
    t = table(spark, d, "documents")
    body = F.coalesce("text", F.lit(""))
    key = text.cache_key(image_ids=F.array(F.col("doc_id"), F.col("doc_id") + 1), focus=F.col("lang"), v=F.lit(3))
    return t.select("doc_id", F.sha2(body, 256).alias("sha"), text.query_hash(body).alias("query_hash"), key.alias("cache_key"))


@query("WITH cache AS (SELECT user_id, arg_min(event_id, ts) AS value FROM events GROUP BY 1) SELECT c_custkey, value, value IS NOT NULL AS hit FROM customer LEFT JOIN cache ON c_custkey = user_id")
def x04_cache_lookup(spark, d):
    cache = table(spark, d, "events").select(F.col("user_id").alias("c_custkey"), F.col("event_id").alias("value"), F.col("ts").alias("created_at"))
    return text.with_cached(table(spark, d, "customer").select("c_custkey"), cache, "c_custkey", "value")


@query("SELECT doc_id, coalesce(nullif(source, ''), 'unknown') || '/' || substring(sha256(text), 1, 2) || '/' || sha256(text) || '.jpg' AS path FROM documents WHERE text IS NOT NULL")
def x05_storage_path(spark, d):
    t = table(spark, d, "documents").where("text is not null")
    return t.select("doc_id", text.storage_path(F.col("source"), F.sha2("text", 256)).alias("path"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url ELSE '/new/' || CASE WHEN page_id % 3 = 1 THEN 'images/' ELSE 'metadata/a/' END || page_id || '.x' END AS path FROM pages")
def x06_rerooted(spark, d):
    i = F.col("page_id").cast("string")
    path = F.when(F.col("page_id") % 3 == 0, F.col("url")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("/old/x/images/"), i, F.lit(".x"))).otherwise(F.concat(F.lit("/y/metadata/a/"), i, F.lit(".x")))
    return table(spark, d, "pages").select("page_id", text.rerooted(path, "/new").alias("path"))


def _raw(spark, d):
    """Model replies about each document: with thoughts and fences, bare, in prose, or broken."""
    i, q = F.col("doc_id").cast("string"), F.coalesce("source", F.lit("none"))
    obj = F.concat(F.lit('{"title": "'), q, F.lit('", "n": '), i, F.lit(', "intent": "'), F.col("lang"), F.lit('", "queries": ["a'), i, F.lit('", "", "b", "c", "d"], "faithfulness": "0.'), i, F.lit('", "reason": "r"}'))
    raw = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("<think>x {\n</think> ```json\n"), obj, F.lit("\n```"))).when(F.col("doc_id") % 4 == 1, obj).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("Sure: "), obj, F.lit(" done."))).otherwise(F.concat(F.lit("no json "), i))
    return table(spark, d, "documents").select("doc_id", "source", "lang", raw.alias("raw"))


SUMMARY = "CASE WHEN doc_id % 4 = 3 THEN 'no json ' || doc_id ELSE coalesce(source, 'none') END"


@query(f"SELECT doc_id, CASE WHEN doc_id % 4 <> 3 THEN coalesce(source, 'none') END AS title, CASE WHEN doc_id % 4 <> 3 THEN doc_id END AS n, doc_id % 4 = 3 AS parse_error, {SUMMARY} AS summary FROM documents WHERE lang IS NOT NULL")
def x07_model_json(spark, d):
    schema = "title string, n bigint"
    rows = _raw(spark, d).where("lang is not null").withColumn("p", model_json.parsed(F.col("raw"), schema))
    return rows.select("doc_id", "p.title", "p.n", F.col("p").isNull().alias("parse_error"), model_json.summary_fallback(F.col("raw"), F.col("p.title")).alias("summary"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN [doc_id] ELSE [doc_id, doc_id + 1] END[1] AS a, 'x' || chr(10) || lang AS b FROM documents WHERE lang IS NOT NULL")
def x08_lenient_json(spark, d):
    i = F.col("doc_id").cast("string")
    raw = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('{"a": ['), i, F.lit(',], "b": "x\n'), F.col("lang"), F.lit('",}'))).otherwise(F.concat(F.lit('{"a": ['), i, F.lit(","), i, F.lit('], "b": "x\\n'), F.col("lang"), F.lit('"}')))
    rows = table(spark, d, "documents").where("lang is not null").select("doc_id", model_json.lenient(raw, "a array<bigint>, b string").alias("p"))
    return rows.select("doc_id", F.element_at("p.a", 1).alias("a"), "p.b")


@query("SELECT doc_id, 'H' || doc_id AS heading, CAST(doc_id % 100 AS INTEGER) AS ref, doc_id % 5 = 0 AS none FROM documents")
def x09_sections(spark, d):
    i, r = F.col("doc_id").cast("string"), (F.col("doc_id") % 100).cast("string")
    raw = F.when(F.col("doc_id") % 5 == 0, F.lit('{"sections": [{"heading": "", "body_md": "x"}]}')).otherwise(F.concat(F.lit('```json\n{"sections": [{"heading": "H'), i, F.lit('", "body_md": "b", "image_refs": ['), r, F.lit(', "x", "7a"]}, {"heading": "no body"}]}\n```')))
    rows = table(spark, d, "documents").select("doc_id", model_json.sections(raw).alias("s"))
    none = model_json.no_sections(F.col("s"))
    first = F.try_element_at("s", F.lit(1))
    return rows.select("doc_id", F.coalesce(first["heading"], F.concat(F.lit("H"), F.col("doc_id").cast("string"))).alias("heading"), F.coalesce(F.try_element_at(first["image_refs"], F.lit(1)), (F.col("doc_id") % 100).cast("int")).alias("ref"), none.alias("none"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang || ',' || source WHEN doc_id % 3 = 1 THEN lang || ',x,' || source ELSE '' END AS flat FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def x10_flatten(spark, d):
    t = table(spark, d, "documents").where("lang is not null and source is not null")
    many = F.to_json(F.array("lang", "source"))
    obj = F.concat(F.lit('{"a": ["'), F.col("lang"), F.lit('", "x"], "b": ["'), F.col("source"), F.lit('"]}'))
    raw = F.when(F.col("doc_id") % 3 == 0, many).when(F.col("doc_id") % 3 == 1, obj).otherwise(F.lit("17"))
    return t.select("doc_id", F.array_join(text.flattened(F.try_parse_json(raw)), ",").alias("flat"))


@query(C + r"SELECT image_id, concat_ws(chr(10), CASE WHEN name <> '' THEN 'Name: ' || name END, CASE WHEN year_built IS NOT NULL THEN 'Year: ' || year_built END, 'Style: ' || style_primary, 'Facade elements: ' || material_1 || ', cornice', 'Materials: ' || array_to_string(materials, ', '), 'Structural relationships: ' || material_1 || ' on ' || building_type) AS block FROM corpus")
def x11_context_block(spark, d):
    relations = F.array(F.struct(F.col("material_1").alias("source"), F.lit("on").alias("relation"), F.col("building_type").alias("target")), F.struct(F.lit("x").alias("source"), F.lit(None).cast("string").alias("relation"), F.lit("y").alias("target")))
    block = text.context_block(
        text.line("Name", F.col("name")), text.line("Architect", F.lit(None)), text.line("Year", F.col("year_built")), text.line("Style", F.col("style_primary")),
        text.listed(f"{text.group_label('facade')} elements", F.array("material_1", F.lit("cornice"))), text.listed("Materials", F.col("materials")), text.listed("Structural relationships", text.triples(relations), "; "),
    )
    return corpus(spark, d).select("image_id", block.alias("block"))


@query(C + "SELECT image_id, coalesce(nullif(trim(material_2), ''), nullif(trim(owner), ''), trim(building_type)) AS first, style_primary || ' (' || printf('%.1f', CAST(class_id * 10.0 AS DOUBLE)) || '%)' AS label, substring(text, 1, 1200) AS index_text FROM corpus")
def x12_merged_fields(spark, d):
    top = F.array(F.struct(F.col("style_primary").alias("label"), (F.col("class_id") / 10.0).alias("p")))
    return corpus(spark, d).select("image_id", text.first_string(F.col("material_2"), F.col("owner"), F.col("building_type")).alias("first"), F.try_element_at(text.style_labels(top), F.lit(1)).alias("label"), text.excerpt(F.col("text")).alias("index_text"))


@query(C + "SELECT c.image_id, coalesce(c.owner, d.lang || '_ctx') AS owner, c.building_type FROM corpus c JOIN documents d ON c.image_id = d.doc_id")
def x13_context_overlay(spark, d):
    context = table(spark, d, "documents").select(F.col("doc_id").alias("image_id"), F.struct(F.concat("lang", F.lit("_ctx")).alias("owner"), F.lit("other").alias("building_type")).alias("context"))
    rows = corpus(spark, d).join(context, "image_id")
    return rows.select("image_id", *[text.overlay(F.col(c), F.col(f"context.{c}")).alias(c) for c in ("owner", "building_type")])


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Untitled building' ELSE c_name END AS title, CASE WHEN c_custkey % 2 = 0 THEN n_name ELSE c_name || ', ' || n_name END AS place FROM customer JOIN nation ON c_nationkey = n_nationkey")
def x14_identity(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    name, city = F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")), F.when(F.col("c_custkey") % 2 != 0, F.col("c_name"))
    return rows.select("c_custkey", text.display_title(name, F.lit("")).alias("title"), text.location(city, F.col("n_name")).alias("place"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN CAST(1000 + doc_id % 9000 AS INTEGER) END AS year, CASE WHEN doc_id % 3 <> 1 THEN CAST(doc_id AS INTEGER) END AS parsed FROM documents")
def x15_x16_years(spark, d):
    """A year column filled only from four digits, and a lenient parse to int or null."""
    i = F.col("doc_id")
    four = F.when(i % 2 == 0, (1000 + i % 9000).cast("string")).otherwise(F.concat(F.lit("c. "), i.cast("string")))
    loose = F.when(i % 3 != 1, F.concat(F.lit(" "), i.cast("string"))).otherwise("unknown")
    return table(spark, d, "documents").select("doc_id", text.four_digit_year(four).alias("year"), text.year(loose).alias("parsed"))


RIGHTS = {0: "http://creativecommons.org/licenses/by/4.0/", 1: "http://creativecommons.org/licenses/by-sa/3.0/", 2: "http://creativecommons.org/licenses/by-nc/4.0/", 3: "http://creativecommons.org/publicdomain/mark/1.0/", 4: "http://rightsstatements.org/vocab/InC/1.0/", 5: "all rights reserved"}


def _rights(column: str = "doc_id"):
    i = F.col(column) % 6
    value = F.lit(RIGHTS[5])
    for k in range(5):
        value = F.when(i == k, RIGHTS[k]).otherwise(value)
    return value


@query("SELECT doc_id, ['CC-BY-4.0', 'CC-BY-SA-3.0', 'Unknown', 'Public Domain', 'Public Domain', 'Unknown'][doc_id % 6 + 1] AS strict, ['CC-BY-4.0', 'CC-BY-SA-3.0', 'CC-BY-4.0', 'Public Domain', 'Public Domain', 'Unknown'][doc_id % 6 + 1] AS lax, doc_id % 6 IN (0, 1, 3) AS accepted FROM documents")
def x17_licence_from_rights(spark, d):
    r = F.array(F.lit("see below"), _rights())
    return table(spark, d, "documents").select("doc_id", licences.from_rights(r).alias("strict"), licences.from_rights(r, strict=False).alias("lax"), licences.rights_accepted(r).alias("accepted"))


@query("SELECT doc_id, ['CC-BY-4.0', 'CC-BY-SA-3.0', 'CC-BY-4.0', 'CC0-1.0', 'own', 'own'][doc_id % 6 + 1] AS licence FROM documents")
def x18_resolved_licence(spark, d):
    return table(spark, d, "documents").select("doc_id", licences.resolved(F.array(_rights()), F.lit("own"), ["http://creativecommons.org", "cc-by"]).alias("licence"))


@query("SELECT page_id, CASE WHEN page_id % 6 IN (0, 1, 3) THEN ['CC-BY-4.0', 'CC-BY-SA-3.0', NULL, 'CC-BY-1.0'][page_id % 6 + 1] END AS licence FROM pages")
def x19_licence_from_page(spark, d):
    """Pages with a licence link put before their own text."""
    page = F.concat(F.lit('<link rel="license" href="'), _rights("page_id"), F.lit('">'), F.coalesce("html", F.lit("")))
    return table(spark, d, "pages").select("page_id", licences.from_page(page)["licence"].alias("licence"))


LINE = "nullif(regexp_extract(text, '(?i)licensed under (?:the )?([^.\\n]+)', 1), '')"


@query(f"WITH l AS (SELECT doc_id, coalesce({LINE}, ['CC BY-SA 4.0', 'cc0', 'All rights reserved', 'CC-BY-ND-4.0', 'pd-us', ''][doc_id % 6 + 1]) AS licence FROM documents), n AS (SELECT *, trim(regexp_replace(regexp_replace(trim(lower(licence)), '[-/ ]\\d+\\.\\d+.*$', ''), '\\s+', ' ', 'g')) AS norm FROM l) SELECT doc_id, licence, norm IN ('cc by-sa', 'cc0', 'pd-us') AS allowed, norm LIKE 'cc by%' OR norm LIKE 'cc-by%' OR norm LIKE 'cc0%' OR norm LIKE 'pd%' AS accepted FROM n")
def f16_f17_licence_gate(spark, d):
    """The licence lines of the texts, and assumed ones where a text has none."""
    line = F.nullif(F.regexp_extract("text", r"(?i)licensed under (?:the )?([^.\n]+)", 1), F.lit(""))
    some = F.element_at(F.array(*[F.lit(x) for x in ("CC BY-SA 4.0", "cc0", "All rights reserved", "CC-BY-ND-4.0", "pd-us", "")]), (F.col("doc_id") % 6 + 1).cast("int"))
    rows = table(spark, d, "documents").select("doc_id", F.coalesce(line, some).alias("licence"))
    return rows.select("doc_id", "licence", licences.allowed(F.col("licence")).alias("allowed"), licences.source_accepts(F.col("licence")).alias("accepted"))


@query("SELECT doc_id FROM documents WHERE regexp_matches(lower(concat_ws(' ', text, ['Urban housing', 'Cooking', 'Facade studies', NULL][doc_id % 4 + 1])), 'architecture|building|urban|facade|structural|architectural|housing|dwelling|landscape')")
def f18_on_topic(spark, d):
    """Texts with assumed subjects, as the texts are invented words."""
    subject = F.element_at(F.array(*[F.lit(x) for x in ("Urban housing", "Cooking", "Facade studies", None)]), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, d, "documents").where(licences.on_topic(F.col("text"), subject)).select("doc_id")


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN CAST(1990 + doc_id % 30 AS INTEGER) END AS year, CASE WHEN doc_id % 2 = 0 THEN 'id' || doc_id || '.pdf' ELSE 'http://x/' || doc_id END AS url FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0")
def f19_theses(spark, d):
    i = F.col("doc_id").cast("string")
    rows = table(spark, d, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("MSc Thesis"))).otherwise(F.array(F.lit("other"))).alias("subjects"),
        F.when(F.col("doc_id") % 2 == 0, F.array(F.concat(F.lit("id"), i, F.lit(".pdf")))).otherwise(F.array(F.lit("plain"), F.concat(F.lit("http://x/"), i))).alias("identifiers"),
        F.when(F.col("doc_id") % 4 == 1, F.array(F.lit("ca. 1900"), (1990 + F.col("doc_id") % 30).cast("string"))).otherwise(F.array(F.lit("n.d."))).alias("dates"),
    )
    first = F.try_element_at(F.filter("identifiers", lambda x: x.rlike("^https?://")), F.lit(1))
    return scans.thesis_rows(rows.withColumn("source_url", first), []).select("doc_id", "year", "url")


@query("SELECT event_id FROM events WHERE event_type IN ('click', 'view') AND user_id % 7 <> 0")
def f20_media_type(spark, d):
    rows = table(spark, d, "events").select("event_id", F.col("event_type").alias("mediatype"), F.when(F.col("user_id") % 7 != 0, F.col("user_id")).alias("page_id"))
    return scans.media_files(rows, ("click", "view")).select("event_id")


@query("SELECT page_id, coalesce(regexp_replace(html, '<[^>]+>', '', 'g'), '') AS plain, coalesce(nullif(regexp_extract(html, '(\\d{4}-\\d{2}-\\d{2})', 1), ''), substring(html, 1, 10)) AS date FROM pages")
def x20_without_tags(spark, d):
    return table(spark, d, "pages").select("page_id", F.coalesce(text.without_tags(F.col("html")), F.lit("")).alias("plain"), text.iso_date(F.col("html")).alias("date"))


@query("SELECT p_partkey, lower(p_brand_name) || ' architecture' AS style FROM (SELECT p_partkey, trim(regexp_replace(regexp_replace(p_name, '[-_]+', ' ', 'g'), '\\s+', ' ', 'g')) AS p_brand_name FROM part)")
def x21_style_from_file_name(spark, d):
    stem = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("_640x480_ezgif-3"))
    return table(spark, d, "part").select("p_partkey", text.style_from_file_name(stem).alias("style"))


def _hits(spark, d, most: int | None = None):
    """Chunk hits of each conversation: the documents whose id is congruent to it, by rank; ``most``: as many characters of a text are wanted."""
    whole = F.col("text") if most is None else F.substring("text", 1, most).alias("text")
    c = table(spark, d, "conversations").select("conv_id").distinct()
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("T"), (F.col("doc_id") % 7).cast("string")).alias("title"), (F.col("doc_id") % 3 + 1).alias("page"), whole)
    rank = [F.struct((F.col("conv_id") + k * k).alias("doc_id"), F.lit(k + 1).alias("rank")) for k in range(5)]
    asked = c.select(F.col("conv_id").alias("qid"), F.inline(F.array(*rank)))
    return asked.join(docs, "doc_id").select("qid", "rank", "title", "page", F.coalesce("text", F.lit("")).alias("text"))


HITS = "h AS (SELECT c.conv_id AS qid, k + 1 AS rank, 'T' || (doc_id % 7) AS title, doc_id % 3 + 1 AS page, coalesce(text, '') AS text FROM (SELECT DISTINCT conv_id FROM conversations) c CROSS JOIN range(5) r(k) JOIN documents ON doc_id = c.conv_id + k * k)"


@query(f"WITH {HITS}, f AS (SELECT *, row_number() OVER (PARTITION BY qid, title, page ORDER BY rank) AS p FROM h), a AS (SELECT *, qid % 2 = 0 AND page = 1 AS named FROM f WHERE p = 1), b AS (SELECT *, max(CASE WHEN named THEN 1 ELSE 0 END) OVER (PARTITION BY qid) AS some_named, row_number() OVER (PARTITION BY qid, named ORDER BY rank) AS place FROM a) SELECT qid, title, page, CASE WHEN length(text) > 240 THEN substring(text, 1, 240) || '…' ELSE text END AS snippet, CAST(place AS INTEGER) AS place FROM b WHERE CASE WHEN some_named = 1 THEN named ELSE place <= 3 END")
def x22_citations(spark, d):
    """Answers of even conversations name page 1 of every title, the others nothing."""
    named = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: rag.label(F.concat(F.lit("T"), i.cast("string")), F.lit(1))), " ")
    answers = table(spark, d, "conversations").select(F.col("conv_id").alias("qid")).distinct().withColumn("answer", F.when(F.col("qid") % 2 == 0, named).otherwise(F.lit("nothing")))
    return rag.citations(_hits(spark, d, rag.SNIPPET + 1), answers)


@query("SELECT conv_id, turn, contains(lower(text), 'the') AND length(text) < 80 AS not_found FROM conversations WHERE text IS NOT NULL")
def x23_not_found(spark, d):
    return table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", rag.is_not_found(F.col("text"), "the").alias("not_found"))


@query(f"WITH {HITS} SELECT qid, sha256(string_agg('[' || title || ', p.' || page || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rank)) AS sha FROM h GROUP BY 1")
def x24_excerpts(spark, d):
    return rag.excerpts(_hits(spark, d)).select("qid", F.sha2("context", 256).alias("sha"))


@query(r"SELECT doc_id, sha256(regexp_replace(replace(coalesce(text, ''), '…', '...'), '[^\x{00}-\x{FF}]', '?', 'g')) AS sha FROM documents")
def x25_latin1(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(text.latin1(F.coalesce("text", F.lit(""))), 256).alias("sha"))


@query(C + "SELECT image_id, concat_ws(' | ', 'style: ' || style_primary, 'owner: ' || owner, 'year: ' || year_built) AS said FROM corpus")
def x28_key_value_text(spark, d):
    return corpus(spark, d).select("image_id", text.key_value_text(style=F.col("style_primary"), owner=F.col("owner"), year=F.col("year_built")).alias("said"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 <> 3 AND lang IN ('en', 'de') THEN lang ELSE 'other' END AS intent, CASE WHEN doc_id % 4 <> 3 THEN 'a' || doc_id || ',b,c' ELSE 'no json ' || doc_id END AS queries FROM documents WHERE lang IS NOT NULL")
def x30_routing(spark, d):
    rows = _raw(spark, d).where("lang is not null")
    return rows.select("doc_id", model_json.intent(F.col("raw"), ["en", "de"], "other").alias("intent"), F.array_join(model_json.sub_queries(F.col("raw"), F.col("raw")), ",").alias("queries"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 <> 3 THEN CAST('0.' || doc_id AS DOUBLE) ELSE 0 END AS faithfulness, CAST(0 AS DOUBLE) AS relevance, CASE WHEN doc_id % 4 <> 3 THEN 'r' ELSE '' END AS reason FROM documents WHERE lang IS NOT NULL")
def x31_judgement(spark, d):
    rows = _raw(spark, d).where("lang is not null")
    return rows.select("doc_id", model_json.judgement(F.col("raw")).alias("j")).select("doc_id", "j.faithfulness", "j.relevance", "j.reason")


@query("""WITH t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS p FROM conversations)
SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || text, chr(10) ORDER BY p DESC) AS history FROM t WHERE p <= 6 AND trim(coalesce(text, '')) <> '' GROUP BY 1""")
def w06_last_turns(spark, d):
    return rag.last_turns(table(spark, d, "conversations"))


@query("""WITH a AS (SELECT page_id, url, generate_subscripts(l, 1) AS i, unnest(l) AS raw FROM (SELECT page_id, url, regexp_extract_all(html, '(?i)<a\\b[^>]*\\shref=["'']([^"'']+)["'']', 1) AS l FROM pages)),
b AS (SELECT page_id, i, CASE WHEN regexp_matches(raw, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN raw WHEN raw LIKE '/%' THEN regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || raw ELSE regexp_extract(regexp_replace(url, '[?#].*$', ''), '^([a-z]+://[^/]+(?:/.*)?/)[^/]*$', 1) || raw END AS link FROM a)
SELECT page_id, link, CAST(row_number() OVER (PARTITION BY page_id ORDER BY f, link) - 1 AS INTEGER) AS position FROM (SELECT page_id, link, min(i) AS f FROM b GROUP BY 1, 2)""")
def s08_page_links(spark, d):
    return scans.page_links(table(spark, d, "pages"), "page_id", "url", "html")


@query("SELECT page_id, 'http://x/' || page_id || '.png' AS link, 0 AS position FROM pages UNION ALL SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || '/b.jpg', 1 FROM pages")
def s08_image_links(spark, d):
    """Pages with image tags put before their own text, which has none."""
    tags = F.concat(F.lit('<img src="http://x/'), F.col("page_id").cast("string"), F.lit('.png"><img class="l" data-src="/b.jpg" srcset="/s.pdf 1x, /b.jpg 2x"><img src="/c.svg">'))
    pages = table(spark, d, "pages").withColumn("html", F.concat(tags, F.coalesce("html", F.lit(""))))
    return scans.image_links(pages, "page_id", "url", "html").select("page_id", "link", "position")


@query("SELECT page_id, nullif(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '') AS title, 'ann|bob' AS authors, 'http://x/o.jpg|http://x/j.png' AS images FROM pages")
def s09_articles(spark, d):
    head = F.lit('<meta name="author" content="ann; bob,"><meta content="http://x/o.jpg" property="og:image"><script type="application/ld+json">{"image": "http://x/j.png"}</script>')
    pages = table(spark, d, "pages").withColumn("html", F.concat(head, F.coalesce("html", F.lit(""))))
    out = scans.articles(pages, "html")
    return out.select("page_id", "title", F.array_join("authors", "|").alias("authors"), F.array_join("images", "|").alias("images"))


@query("SELECT event_id, event_type AS title, 'http://i/' || event_id AS image_url, CASE WHEN event_id % 2 = 0 THEN 'one' ELSE 'one,two' END AS creators, substring(CAST(ts AS VARCHAR), 1, 10) AS date FROM events")
def s07_api_items(spark, d):
    """JSON records in which a field is a scalar or a list."""
    i = F.col("event_id").cast("string")
    creator = F.when(F.col("event_id") % 2 == 0, F.lit('"one"')).otherwise(F.lit('["one", "two"]'))
    raw = F.concat(F.lit('{"title": ["'), F.col("event_type"), F.lit('", "other"], "preview": "x", "shown": ["ftp://a", "http://i/'), i, F.lit('"], "creator": '), creator, F.lit(', "date": "'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('"}'))
    out = scans.api_items(table(spark, d, "events").select("event_id", raw.alias("raw")), "raw", ["preview", "shown"])
    return out.select("event_id", "title", "image_url", F.array_join("creators", ",").alias("creators"), "date")


@query("SELECT doc_id, CASE WHEN octet_length(encode(head)) < 12 THEN NULL WHEN doc_id % 4 = 0 THEN 'png' WHEN doc_id % 4 = 1 THEN 'jpeg' WHEN doc_id % 4 = 2 THEN 'webp' END AS kind FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 9 THEN 'short' ELSE repeat('x', 20) END AS head FROM documents)")
def s02_file_kind(spark, d):
    """Bytes with the magic numbers of pictures put before each text."""
    i = F.col("doc_id")
    magic = F.when(i % 4 == 0, F.lit(b"\x89PNG\r\n\x1a\n")).when(i % 4 == 1, F.lit(b"\xff\xd8\xff\xe0")).when(i % 4 == 2, F.lit(b"RIFF1234WEBP")).otherwise(F.lit(b""))
    body = F.encode(F.concat(F.coalesce("text", F.lit("")), F.lit("............")), "UTF-8")
    content = F.when(i % 10 == 9, F.lit(b"short")).otherwise(F.concat(magic, body))
    return table(spark, d, "documents").select("doc_id", scans.file_kind(content).alias("kind"))


BAG = "SELECT id, list_transform(range(64), lambda i: len(list_filter(w, lambda x: CAST('0x' || substring(md5(x), 1, 8) AS BIGINT) % 64 = i))::DOUBLE) AS c"


@query("WITH w AS (SELECT doc_id AS id, list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS w FROM documents), b AS (" + BAG + " FROM w), n AS (SELECT id, c, sqrt(list_sum(list_transform(c, lambda x: x * x))) AS n FROM b), v AS (SELECT id, list_transform(c, lambda x: CASE WHEN n = 0 THEN x ELSE x / n END) AS vec FROM n), " + nn(5) + " SELECT * FROM nn")
def p01_embed_and_search(spark, d):
    """Whole texts of all documents embedded by the default embedder, as queries and as passages."""
    c = table(spark, d, "documents")
    passages = models.embed_passages(c.select(F.col("doc_id").alias("id"), "text"))
    asked = models.embed_queries(c.where(F.col("doc_id") % 100 == 0).select(F.col("doc_id").alias("qid"), F.col("text").alias("query")))
    return vectors.knn(asked, passages, 5)


def _plain_model():
    """A stand-in for an image or text encoder: the first four bytes of the item's digest, as numbers."""
    return lambda items: [[float(b) for b in hashlib.md5(i.encode()).digest()[:4]] if i else [] for i in items]


@query("WITH b AS (SELECT doc_id AS id, text, list_transform(range(4), lambda i: CAST(CAST('0x' || substring(md5(text), CAST(2 * i + 1 AS BIGINT), 2) AS INTEGER) AS DOUBLE)) AS v FROM documents), n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM b) SELECT id, CASE WHEN text <> '' THEN round(v[1] / n, 6) END AS first, CASE WHEN text <> '' THEN round(v[4] / n, 6) END AS last FROM n")
def p02_item_embedder(spark, d):
    """A model that the caller supplies, loaded once a worker, in batches of 32."""
    out = models.embed_items(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("item")), models.embedder(_plain_model))
    return out.select("id", F.round(F.element_at("vec", 1), 6).alias("first"), F.round(F.element_at("vec", 4), 6).alias("last"))


def _plain_extractor():
    """A stand-in for a language model: JSON with fences, thoughts and prose around it, and now and then none."""

    def extract(texts: list) -> list:
        out = []
        for t in texts:
            n = len(t or "")
            body = json.dumps({"title": (t or "")[:10], "size": n})
            out.append([f"```json\n{body}\n```", f"<think>{{}}</think>{body}", f"Here it is: {body}.", "no answer"][n % 4])
        return out

    return extract


@query("SELECT doc_id, CASE WHEN length(coalesce(text, '')) % 4 <> 3 THEN substring(coalesce(text, ''), 1, 10) END AS title, CASE WHEN length(coalesce(text, '')) % 4 <> 3 THEN CAST(length(coalesce(text, '')) AS INTEGER) END AS size, length(coalesce(text, '')) % 4 = 3 AS failed FROM documents")
def p04_extractor(spark, d):
    """An extractor that the caller supplies; what it says goes on as model JSON."""
    rows = models.extracted(table(spark, d, "documents").select("doc_id", "text"), models.extractor(_plain_extractor))
    schema = "title string, size int"
    found = rows.select("doc_id", "raw").withColumn("m", model_json.parsed(F.col("raw"), schema))
    return found.select("doc_id", "m.title", "m.size", F.col("m").isNull().alias("failed"))
