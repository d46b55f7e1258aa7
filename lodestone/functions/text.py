"""Text and struct functions, all of them column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNK_WORDS, OVERLAP, LEAST_CHARS = 375, 38, 40
EXCERPT, INDEX_TEXT = 1000, 1200


def spaced(c: Column) -> Column:
    return F.replace(c, F.lit("_"), F.lit(" "))


def search_text(*parts: Column) -> Column:
    """Scalars and arrays in order, blanks left out, underscores as spaces. Name an array twice to weigh it twice."""
    flat = F.flatten(F.array(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts]))
    return spaced(F.array_join(F.filter(flat, lambda x: x.isNotNull() & (x != "")), " "))


def as_list(c: Column) -> Column:
    return F.array(c)


# The order in which an image's fields make up its search text; the retrieval tags come twice.
SEARCH_FIELDS = (
    "title", "description", "building_type", "architecture_style_classified", "style.primary", "style.secondary", "style.style_evidence", "style.emergent_tags", "materials", "material_details.textures",
    "material_details.construction_expression", "architectural_elements.structural", "architectural_elements.facade", "architectural_elements.roofing", "architectural_elements.openings",
    "architectural_elements.ornamental", "spatial_features.massing", "spatial_features.geometry", "environment.setting", "environment.urban_context", "semantic_keywords", "retrieval_tags", "retrieval_tags",
)


def chunk_pages(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """doc, page, chunk_index, chunk: windows of 375 words with an overlap of 38 inside each page.

    Short pages and chunks (under 40 characters) drop out; the index counts over the document's pages.
    """
    clean = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[ \t]+", " "))
    clean = F.regexp_replace(clean, r"(?U)^\s+|\s+$", "")
    words = pages.select(F.col(doc).alias("doc"), F.col(page).alias("page"), clean.alias("clean")).where(F.length("clean") >= LEAST_CHARS)
    words = words.select("doc", "page", F.split("clean", r"(?U)\s+").alias("words"))
    n = F.greatest(F.ceil((F.size("words") - CHUNK_WORDS) / F.lit(float(CHUNK_WORDS - OVERLAP))), F.lit(0)).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), n), lambda w: F.array_join(F.slice("words", w * (CHUNK_WORDS - OVERLAP) + 1, CHUNK_WORDS), " "))
    chunks = words.select("doc", "page", F.posexplode(chunks).alias("w", "chunk")).where(F.length("chunk") >= LEAST_CHARS)
    index = F.row_number().over(W.partitionBy("doc").orderBy("page", "w")) - 1
    return chunks.select("doc", "page", index.alias("chunk_index"), "chunk")


def query_hash(query: Column) -> Column:
    return F.left(F.sha2(query, 256), F.lit(16))


def cache_key(**parts: Column) -> Column:
    """sha256 of the parts as JSON with sorted names."""
    return F.sha2(F.to_json(F.struct(*[parts[k].alias(k) for k in sorted(parts)]), {"ignoreNullFields": "false"}), 256)


def with_cached(requests: DataFrame, cache: DataFrame, key: str, value: str) -> DataFrame:
    """Requests with the cached value and ``hit``; of entries with one key the first written wins."""
    first = cache.groupBy(key).agg(F.min_by(value, "created_at").alias(value))
    return requests.join(first, key, "left").withColumn("hit", F.col(value).isNotNull())


def storage_path(spider: Column, digest: Column) -> Column:
    """``spider/aa/digest.jpg`` with defaults for blanks."""
    return F.concat_ws("/", F.coalesce(F.nullif(spider, F.lit("")), F.lit("unknown")), F.left(digest, F.lit(2)), F.concat(digest, F.lit(".jpg")))


def rerooted(path: Column, root: Column | str = "/data") -> Column:
    """From the first ``images`` or ``metadata`` component on, under another root; else the path itself."""
    tail = F.regexp_extract(path, r"/((?:images|metadata)/.*)$", 1)
    base = F.lit(root) if isinstance(root, str) else root
    return F.when(tail != "", F.concat(base, F.lit("/"), tail)).otherwise(path)


def first_string(*values: Column) -> Column:
    """The first value that is not blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(v), F.lit("")) for v in values])


def excerpt(c: Column, n: int = INDEX_TEXT) -> Column:
    return F.substring(c, 1, n)


def style_labels(top: Column) -> Column:
    """array<struct<label, p>> -> ``label (12.3%)`` strings; entries without a label or a share are left out."""
    return F.transform(F.filter(top, lambda s: s["label"].isNotNull() & s["p"].isNotNull()), lambda s: F.format_string("%s (%.1f%%)", s["label"], s["p"] * 100))


def flattened(variant: Column) -> Column:
    """Strings of a list, or of the lists in an object, from a variant; else an empty array."""
    as_list_ = F.try_variant_get(variant, "$", "array<string>")
    as_map = F.try_variant_get(variant, "$", "map<string, array<string>>")
    return F.coalesce(as_list_, F.flatten(F.map_values(as_map)), F.array().cast("array<string>"))


def line(label: str, value: Column) -> Column:
    return F.when(F.coalesce(value.cast("string"), F.lit("")) != "", F.concat(F.lit(f"{label}: "), value.cast("string")))


def listed(label: str, values: Column, glue: str = ", ") -> Column:
    return line(label, F.array_join(F.filter(values, lambda v: v.isNotNull()), glue))


def group_label(name: str) -> str:
    return f"{name.replace('_', ' ').title()}"


def triples(relations: Column) -> Column:
    """source relation target strings of complete triples."""
    whole = F.filter(relations, lambda r: r["source"].isNotNull() & r["relation"].isNotNull() & r["target"].isNotNull())
    return F.transform(whole, lambda r: F.concat_ws(" ", r["source"], r["relation"], r["target"]))


def context_block(*lines: Column) -> Column:
    """The lines that are there, one below the other."""
    return F.coalesce(F.nullif(F.concat_ws("\n", *lines), F.lit("")), F.lit("No artifact data available."))


def overlay(own: Column, context: Column) -> Column:
    """A request's context fills what is blank."""
    return first_string(own, context)


def display_title(*names: Column) -> Column:
    return F.coalesce(*[F.nullif(n, F.lit("")) for n in names], F.lit("Untitled building"))


def location(city: Column, country: Column) -> Column:
    return F.nullif(F.concat_ws(", ", F.nullif(city, F.lit("")), F.nullif(country, F.lit(""))), F.lit(""))


def year(c: Column) -> Column:
    return F.trim(c).try_cast("int")


def four_digit_year(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{4}$"), c).cast("int")


def without_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]+>", "")


def iso_date(c: Column) -> Column:
    """The first ISO date in the text, else its first ten characters."""
    return F.coalesce(F.nullif(F.regexp_extract(c, r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")), F.substring(c, 1, 10))


#: Fixed renamings of styles.
STYLE_ALIASES = {"persian iranian architecture": "persian architecture", "mannerism architecture": "mannerist architecture"}


def style_from_file_name(stem: Column) -> Column:
    """A style's name out of a picture's file name."""
    c = F.regexp_replace(stem, r"(?i)ezgif.*$", "")
    for pattern, new in ((r"[-_]+", " "), (r"(?i)\b\d+x\d+\b", " "), (r"\d+$", " "), (r"(?<=[a-z])(?=[A-Z])", " "), (r"\s+", " ")):
        c = F.regexp_replace(c, pattern, new)
    c = F.lower(F.trim(F.regexp_replace(F.replace(F.trim(c), F.lit("architecture"), F.lit(" architecture")), r"\s+", " ")))
    c = F.when(c.endswith("architecture"), c).otherwise(F.concat(c, F.lit(" architecture")))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in STYLE_ALIASES.items() for x in kv]), c), c)


#: Fixed replacements before text goes to a Latin-1 font; what else is not Latin-1 becomes a question mark.
LATIN1 = {
    "‑": "-", "‒": "-", "–": "-", "—": "--", "―": "--", "‘": "'", "’": "'", "“": '"', "”": '"', "′": "'", "″": '"',
    "…": "...", "•": "-", "·": "-", " ": " ", " ": " ", " ": " ",
}


def latin1(c: Column) -> Column:
    one = "".join(k for k, v in LATIN1.items() if len(v) == 1)
    c = F.translate(c, one, "".join(LATIN1[k] for k in one))
    for k, v in LATIN1.items():
        if len(v) > 1:
            c = F.replace(c, F.lit(k), F.lit(v))
    return F.regexp_replace(c, r"[^\x{00}-\x{FF}]", "?")


def key_value_text(**values: Column) -> Column:
    """``name: value`` of what is there, joined by bars."""
    return F.concat_ws(" | ", *[line(k, v) for k, v in values.items()])
