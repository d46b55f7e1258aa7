"""Scans: files, sidecars, records, pages, sitemaps, tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.sources import folders

# Fixed values.
IMAGE_TYPES = ("jpg", "jpeg", "png", "webp", "tif", "tiff")
LARGEST_IMAGE, LARGEST_LISTING, LARGEST_SITEMAP = 12 * 1024 * 1024, 200, 500


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def image_files(spark: SparkSession, folder: str, labelled: bool = False, kinds: tuple[str, ...] = IMAGE_TYPES, content: bool = False) -> DataFrame:
    """path, length, modificationTime (and label, the parent folder), in the order of names."""
    wanted = extension(F.col("path")).isin(list(kinds))
    root = folders.mounted(spark, folder)
    found = root and folders.listed(spark, root, deep=labelled)
    if root and (labelled or found.where("folder").isEmpty()):  # other folders can be partitions, whose columns Spark adds
        files = found.where(~F.col("folder") & wanted).drop("folder")
        files = folders.contents(files) if content else files
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", str(labelled).lower()).load(folder).where(wanted)
    if labelled:
        files = files.withColumn("label", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))
    return (files if content else files.drop("content")).orderBy("path")


def file_kind(content: Column) -> Column:
    """The type that the first bytes tell; null under twelve bytes or for none known."""
    start = lambda magic, at=1: F.substring(content, at, len(magic)) == F.lit(magic)
    return F.when(
        F.octet_length(content) >= 12,
        F.when(start(b"\xff\xd8\xff"), "jpeg").when(start(b"\x89PNG\r\n\x1a\n"), "png").when(start(b"RIFF") & start(b"WEBP", 9), "webp")
        .when(start(b"GIF87a") | start(b"GIF89a"), "gif").when(start(b"BM"), "bmp").when(start(b"II*\x00") | start(b"MM\x00*"), "tiff"),
    )


def usable_images(files: DataFrame, largest: int = LARGEST_IMAGE) -> DataFrame:
    """Files whose bytes are an image and that are not too large, with ``kind``."""
    return files.withColumn("kind", file_kind(F.col("content"))).where(F.col("kind").isNotNull() & (F.octet_length("content") <= largest))


def listing(spark: SparkSession, prefix: str, most: int = LARGEST_LISTING, largest: int = LARGEST_IMAGE) -> DataFrame:
    """path, length, outcome (ok or the reason of the skip) of up to ``most`` images below a prefix, e.g. s3a://bucket/prefix."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(prefix).select("path", "length").where(extension(F.col("path")).isin(list(IMAGE_TYPES)))
    return files.orderBy("path").limit(most).withColumn("outcome", F.when(F.col("length") > largest, "too large").otherwise("ok"))


def sidecars(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """id (the file's stem), meta, outcome: ok, bad json, or bad name for stems that are no UUID."""
    if root := folders.mounted(spark, folder):
        found = folders.listed(spark, root).where(~F.col("folder") & F.col("path").endswith(".json")).select("path")
        files = folders.contents(found).select(F.col("content").cast("string").alias("value"), F.substring_index("path", "/", -1).alias("name"))
    else:
        files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json", recursiveFileLookup=True).select("value", F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B"))).alias("name"))  # given percent-encoded
    stem = file_stem(F.col("name"))
    uuid = stem.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
    good = F.try_parse_json("value").isNotNull()
    outcome = F.when(~uuid, "bad name").when(~good, "bad json").otherwise("ok")
    return files.select(stem.alias("id"), F.when(good, F.from_json("value", schema)).alias("meta"), outcome.alias("outcome"))


def golden(spark: SparkSession, path: str) -> DataFrame:
    """query, relevant, filters (facet -> values, given as a scalar or a list), notes of a JSONL file; blank and # lines are skipped, bad JSON and a missing query fail."""
    lines = spark.read.text(path).where(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    row = F.from_json("value", "query string, relevant_image_ids array<string>, filters map<string,variant>, notes string", {"mode": "FAILFAST"}).alias("r")
    query = F.when(F.coalesce(F.col("r.query"), F.lit("")) != "", F.col("r.query")).otherwise(F.raise_error(F.lit("a line has no query")))
    values = lambda v: F.coalesce(F.try_variant_get(v, "$", "array<string>"), F.array_compact(F.array(F.try_variant_get(v, "$", "string"))))
    filters = F.transform_values("r.filters", lambda _, v: values(v)).alias("filters")
    return lines.select(row).select(query.alias("query"), F.coalesce("r.relevant_image_ids", F.array().cast("array<string>")).alias("relevant"), filters, "r.notes")


def oai_records(spark: SparkSession, path: str) -> DataFrame:
    """identifier, title, creators, rights, dates, subjects, identifiers, image_url, source_url of OAI-PMH Dublin Core; deleted ones are skipped."""
    schema = "header struct<_status: string, identifier: string>, metadata struct<`oai_dc:dc`: struct<`dc:title`: array<string>, `dc:creator`: array<string>, `dc:rights`: array<string>, `dc:date`: array<string>, `dc:subject`: array<string>, `dc:description`: array<string>, `dc:identifier`: array<string>>>"
    rows = spark.read.format("xml").option("rowTag", "record").schema(schema).load(path).where("header._status is null or header._status <> 'deleted'")
    dc = lambda name: F.coalesce(F.col("metadata")["oai_dc:dc"][f"dc:{name}"], F.array().cast("array<string>"))
    ids = dc("identifier")
    first = lambda pattern: F.try_element_at(F.filter(ids, lambda x: F.lower(x).rlike(pattern)), F.lit(1))
    return rows.select(
        F.col("header.identifier").alias("identifier"), F.try_element_at(dc("title"), F.lit(1)).alias("title"), dc("creator").alias("creators"), dc("rights").alias("rights"), dc("date").alias("dates"),
        dc("subject").alias("subjects"), F.concat_ws(" ", dc("description")).alias("description"), ids.alias("identifiers"), first(r"\.(jpe?g|png|tiff?|pdf)$").alias("image_url"), first("^https?://").alias("source_url"),
    )


def thesis_rows(records: DataFrame, prefixes: list[str]) -> DataFrame:
    """Records that are theses or have a PDF, with the year of the first date that starts with four digits and a source address."""
    thesis = F.exists("subjects", lambda s: F.contains(F.lower(s), F.lit("thesis"))) | F.exists("identifiers", lambda s: F.lower(s).endswith(".pdf"))
    date = F.try_element_at(F.filter("dates", lambda d: d.rlike(r"^\d{4}")), F.lit(1))
    url = F.coalesce("source_url", F.try_element_at("identifiers", F.lit(1)))
    return records.where(thesis).withColumn("year", F.substring(date, 1, 4).cast("int")).withColumn("url", url)


def api_items(records: DataFrame, raw: str, image_keys: list[str]) -> DataFrame:
    """title, creators, image_url, excerpt, date from JSON records whose fields are a scalar or a list."""
    v = F.try_parse_json(raw)
    many = lambda name: F.coalesce(F.try_variant_get(v, f"$.{name}", "array<string>"), F.array_compact(F.array(F.try_variant_get(v, f"$.{name}", "string"))))
    one = lambda name: F.try_element_at(many(name), F.lit(1))
    url = F.coalesce(*[F.try_element_at(F.filter(many(k), lambda u: u.rlike("^https?://")), F.lit(1)) for k in image_keys])
    return records.select("*", one("title").alias("title"), many("creator").alias("creators"), url.alias("image_url"), F.substring(one("description"), 1, 1000).alias("excerpt"), F.substring(one("date"), 1, 10).alias("date"))


def media_files(records: DataFrame, kinds: tuple[str, ...] = ("BITMAP", "DRAWING")) -> DataFrame:
    return records.where(F.col("mediatype").isin(list(kinds)) & F.col("page_id").isNotNull())


def absolute(url: Column, base: Column) -> Column:
    """``url`` against a page's address: absolute, //host, /path or relative."""
    scheme, root, folder = F.regexp_extract(base, r"^([a-z]+):", 1), F.regexp_extract(base, r"^([a-z]+://[^/?#]+)", 1), F.regexp_extract(F.regexp_replace(base, r"[?#].*$", ""), r"^([a-z]+://[^/]+(?:/.*)?/)[^/]*$", 1)
    return F.when(url.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), url).when(url.startswith("//"), F.concat(scheme, F.lit(":"), url)).when(url.startswith("/"), F.concat(root, url)).otherwise(F.concat(F.when(folder == "", F.concat(root, F.lit("/"))).otherwise(folder), url))


def image_links(pages: DataFrame, key: str, url: str, html: str, most: int = 200) -> DataFrame:
    """key, position, link: of every img the first source attribute and the last srcset entry, made absolute, each once, in order."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<img\b[^>]*>"), F.lit(0))
    attr = lambda tag, name: F.nullif(F.regexp_extract(tag, rf"""(?i)\s{name}=["']([^"']+)["']""", 1), F.lit(""))
    first = lambda tag: F.coalesce(*[attr(tag, n) for n in ("src", "data-src", "data-original", "data-lazy-src")])
    last = lambda tag: F.substring_index(F.trim(F.element_at(F.split(attr(tag, "srcset"), ","), -1)), " ", 1)
    found = pages.select(key, url, F.posexplode(F.flatten(F.transform(tags, lambda t: F.array(first(t), last(t))))).alias("i", "raw")).where(F.coalesce("raw", F.lit("")) != "")
    links = found.select(key, "i", absolute(F.col("raw"), F.col(url)).alias("link"))
    ext = extension(F.regexp_replace("link", r"[?#].*$", ""))
    links = links.where((ext == "") | ext.isin(list(IMAGE_TYPES)) | ~F.regexp_replace("link", r"^[a-z]+://[^/]*", "").rlike(r"\.[A-Za-z0-9]+(?:[?#].*)?$"))
    return in_order(links, key, "link", "i", most)


def in_order(rows: DataFrame, key: str, value: str, place: str, most: int | None = None) -> DataFrame:
    """key, position, value: each value once per key, at its first place."""
    first = rows.groupBy(key, value).agg(F.min(place).alias("_at"))
    out = first.withColumn("position", (F.row_number().over(W.partitionBy(key).orderBy("_at", value)) - 1).cast("int")).drop("_at")
    return out.where(F.col("position") < most) if most else out


def page_links(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """key, position, link: the page's anchors, made absolute, each once, in order."""
    raw = F.regexp_extract_all(html, F.lit(r"""(?i)<a\b[^>]*\shref=["']([^"']+)["']"""), F.lit(1))
    found = pages.select(key, url, F.posexplode(raw).alias("i", "raw"))
    return in_order(found.select(key, "i", absolute(F.col("raw"), F.col(url)).alias("link")), key, "link", "i")


def meta_content(html: Column, name: str) -> Column:
    """The content of a meta tag named ``name``, with its attributes in any of three orders."""
    patterns = (rf"""(?i)<meta[^>]+property=["']{name}["'][^>]+content=["']([^"']*)["']""", rf"""(?i)<meta[^>]+name=["']{name}["'][^>]+content=["']([^"']*)["']""", rf"""(?i)<meta[^>]+content=["']([^"']*)["'][^>]+(?:property|name)=["']{name}["']""")
    return F.coalesce(*[F.nullif(F.regexp_extract(html, p, 1), F.lit("")) for p in patterns])


def articles(pages: DataFrame, html: str, most: int = 10) -> DataFrame:
    """Adds title, description, authors, images (og:image first, each once, ten at most)."""
    h = F.col(html)
    block = F.regexp_extract_all(h, F.lit(r"""(?s)<script[^>]+ld\+json[^>]*>(.*?)</script>"""), F.lit(1))
    linked = F.flatten(F.transform(block, lambda b: F.regexp_extract_all(b, F.lit(r'"(?:image|contentUrl|url)"\s*:\s*"(https?://[^"]+\.(?:jpe?g|png|webp))"'), F.lit(1))))
    inline = F.regexp_extract_all(h, F.lit(r"""(?i)<img\b[^>]*\ssrc=["'](https?://[^"']+)["']"""), F.lit(1))
    images = F.slice(F.array_distinct(F.concat(F.array_compact(F.array(meta_content(h, "og:image"))), linked, inline)), 1, most)
    title = F.coalesce(meta_content(h, "og:title"), F.nullif(F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1), F.lit("")))
    authors = F.filter(F.transform(F.split(F.coalesce(meta_content(h, "author"), F.lit("")), "[,;]"), lambda a: F.trim(a)), lambda a: a != "")
    return pages.select("*", title.alias("title"), meta_content(h, "og:description").alias("description"), authors.alias("authors"), images.alias("images"))


def sitemap(spark: SparkSession, path: str, most: int = LARGEST_SITEMAP) -> DataFrame:
    """kind (sitemap or url), loc: nested sitemaps, and at most ``most`` pages."""
    nested = spark.read.format("xml").option("rowTag", "sitemap").schema("loc string").load(path).select(F.lit("sitemap").alias("kind"), F.trim("loc").alias("loc"))
    urls = spark.read.format("xml").option("rowTag", "url").schema("loc string").load(path).select(F.lit("url").alias("kind"), F.trim("loc").alias("loc")).orderBy("loc").limit(most)
    return nested.unionByName(urls)


def by_id(rows: DataFrame, key: str, *ids) -> DataFrame:
    """Point lookup: the filter reaches the scan."""
    return rows.where(F.col(key).isin(list(ids)))


def listed_page(rows: DataFrame, sort: str, key: str, created: str, year: str, skip: int, limit: int) -> DataFrame:
    """One page of a listing: created_desc, created_asc, year_desc (nulls last), year_asc (nulls first); each row with the listing's ``total``."""
    order = {"created_desc": F.col(created).desc(), "created_asc": F.col(created).asc(), "year_desc": F.col(year).desc_nulls_last(), "year_asc": F.col(year).asc_nulls_first()}[sort]
    return rows.orderBy(order, key).offset(skip).limit(limit).withColumn("total", rows.agg(F.count("*")).scalar())


def after_cursor(rows: DataFrame, key: str, cursor, limit: int) -> DataFrame:
    """Keyset pagination."""
    return (rows if cursor is None else rows.where(F.col(key) > cursor)).orderBy(key).limit(limit)
