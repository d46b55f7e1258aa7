"""Tag validation from three signals: the model's confidence, prompt agreement, neighbours' votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.filters import normal
from lodestone.operators.vectors import dot, knn, ranked

# Fixed thresholds.
CLIP_FLOOR, CLIP_AGREES, VLM_CONFIDENT = 0.12, 0.25, 0.6
NEIGHBOURS, CONSENSUS, LEAST_CORPUS, FEW_VOTES = 10, 6, 500, 1
SUBJECT_CONFIDENCE = 0.15


def prompts(style: Column, kind: Column, materials: Column) -> Column:
    """array<struct<key, prompt>>: one prompt for each tag that is there."""
    one = lambda key, prompt: F.struct(key.alias("key"), prompt.alias("prompt"))
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    styled = F.replace(F.concat(F.lit("a photo of a "), normal(style), F.lit(" "), normal(F.coalesce(kind, F.lit(""))), F.lit(" building")), F.lit("  "), F.lit(" "))
    none = F.array().cast("array<struct<key:string,prompt:string>>")
    return F.concat(
        F.when(has(style), F.array(one(F.concat(F.lit("style:"), style), styled))).otherwise(none),
        F.when(has(kind), F.array(one(F.concat(F.lit("building_type:"), kind), F.concat(F.lit("a photo of a "), normal(kind), F.lit(" building"))))).otherwise(none),
        F.transform(F.filter(materials, has), lambda m: one(F.concat(F.lit("material:"), m), F.concat(F.lit("a photo of a building made of "), normal(m)))),
    )


def prompt_agreement(rows: DataFrame, prompt_vectors: DataFrame) -> DataFrame:
    """id, clip (map of key -> cosine): (id, vec, prompts) rows against (key, key_vec) vectors."""
    asked = rows.select("id", "vec", F.explode("prompts").alias("p")).select("id", "vec", "p.key")
    scored = asked.join(prompt_vectors, "key").select("id", F.struct("key", F.round(dot(F.col("vec"), F.col("key_vec")), 4).alias("score")).alias("e"))
    return scored.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list("e"))).alias("clip"))


def neighbour_votes(rows: DataFrame, vectors: DataFrame, asked: DataFrame | None = None, k: int = NEIGHBOURS, least_corpus: int = LEAST_CORPUS, consensus: int = CONSENSUS) -> DataFrame:
    """id, k, style_votes, building_type_votes and passes of (id, style, building_type) rows; nothing for a small corpus."""
    vectors = vectors.select("id", "vec")
    asked = (rows if asked is None else asked).select(F.col("id").alias("qid"), F.col("style").alias("own_style"), F.col("building_type").alias("own_type"))
    if vectors.count() < least_corpus:
        asked = asked.limit(0)
    hits = knn(asked.join(vectors, asked.qid == vectors.id).select("qid", "vec"), vectors, k + 1).where("id <> qid")
    hits = ranked(hits.drop("rank")).where(F.col("rank") <= k)
    voted = hits.join(rows.select("id", "style", "building_type"), "id").join(asked, "qid")
    same = lambda a, b: F.count_if((F.coalesce(F.col(b), F.lit("")) != "") & (normal(a) == normal(b)))
    out = voted.groupBy("qid").agg(F.count("*").alias("k"), same("style", "own_style").alias("style_votes"), same("building_type", "own_type").alias("building_type_votes"))
    return out.select(F.col("qid").alias("id"), "k", "style_votes", "building_type_votes", (F.col("style_votes") >= consensus).alias("style_pass"), (F.col("building_type_votes") >= consensus).alias("building_type_pass"))


def neighbour_counts(hits: DataFrame, rows: DataFrame, attribute: str) -> DataFrame:
    """qid, attribute, votes: how many of a query's (qid, id) neighbours have each value of an attribute of (id, attribute) rows."""
    return hits.join(rows.select("id", attribute), "id").groupBy("qid", attribute).agg(F.count("*").alias("votes"))


def conflicting(style: Column, kind: Column, clip_style: Column, clip_kind: Column, style_votes: Column, kind_votes: Column) -> Column:
    """The tags that prompt score and neighbours both reject, as field:tag. Without neighbours nothing is rejected."""

    def one(field: str, tag: Column, clip: Column, votes: Column) -> Column:
        rejected = (F.coalesce(tag, F.lit("")) != "") & (clip < CLIP_FLOOR) & (votes <= FEW_VOTES)
        return F.when(F.coalesce(rejected, F.lit(False)), F.concat(F.lit(f"{field}:"), tag))

    return F.array_compact(F.array(one("style", style, clip_style, style_votes), one("building_type", kind, clip_kind, kind_votes)))


def decision(stripped: Column, confidence: Column, clip_style: Column, style_pass: Column) -> Column:
    agrees = F.coalesce(clip_style >= CLIP_AGREES, F.lit(False)) | F.coalesce(style_pass, F.lit(False))
    return F.when(F.size(stripped) > 0, "quarantined").when((F.coalesce(confidence, F.lit(0.0)) >= VLM_CONFIDENT) & agrees, "verified").otherwise("provisional")


def strip_conflicting(rows: DataFrame, stripped: str = "stripped") -> DataFrame:
    """Empties style_primary, building_type and tags where ``stripped`` names them; everything else stays."""
    gone = lambda field, tag: F.exists(stripped, lambda s: s == F.concat(F.lit(f"{field}:"), tag))
    styles = F.filter(stripped, lambda s: s.startswith("style:"))
    bad = F.transform(styles, lambda s: normal(F.substr(s, F.lit(7))))
    out = rows.withColumn("style_primary", F.when(gone("style", F.col("style_primary")), "").otherwise(F.col("style_primary")))
    out = out.withColumn("building_type", F.when(gone("building_type", F.col("building_type")), "").otherwise(F.col("building_type")))
    return out.withColumn("tags", F.filter("tags", lambda t: ~F.array_contains(bad, normal(t)))) if "tags" in rows.columns else out


def retry_instruction(stripped: Column, clip: Column, votes: Column, k: Column) -> Column:
    """What the model is told for each stripped tag; the sentence is a fixed value."""

    def say(entry: Column) -> Column:
        field, tag = F.substring_index(entry, ":", 1), F.regexp_replace(entry, "^[^:]*:", "")
        score = F.coalesce(F.try_element_at(clip, entry).cast("string"), F.lit("None"))
        return F.concat(
            F.lit("CLIP zero-shot scoring (score="), score, F.lit(") and corpus neighbor consensus ("), F.coalesce(votes.cast("string"), F.lit("None")), F.lit(" of "), F.coalesce(k.cast("string"), F.lit("?")),
            F.lit(" neighbors agree) suggest this building is NOT '"), tag, F.lit("' ("), field, F.lit("). Re-examine the visual evidence carefully before assigning "), field, F.lit("."),
        )

    return F.array_join(F.transform(stripped, say), "\n")


def second_pass(first: DataFrame, second: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with a second extraction take its columns, and that is final."""
    again = second.select(key, *[F.col(c).alias(f"second_{c}") for c in columns], F.lit(True).alias("retried"))
    out = first.join(again, key, "left")
    new = [F.coalesce(f"second_{c}", c).alias(c) if c in columns else F.col(c) for c in first.columns]
    return out.select(*new, F.coalesce("retried", F.lit(False)).alias("final"))


def rejudged(rows: DataFrame, clip: DataFrame, votes: DataFrame, confidence: str = "confidence", status: str = "tag_status") -> DataFrame:
    """After a second pass: final rows get ``stripped`` and the status that the signals of their new tags give, others keep their status.

    ``clip`` is what ``prompt_agreement`` and ``votes`` what ``neighbour_votes`` gives for the final rows (both by id).
    """
    both = rows.join(clip.select("id", "clip"), "id", "left").join(votes.select("id", "style_votes", "building_type_votes", "style_pass"), "id", "left")
    score = lambda field, tag: F.try_element_at("clip", F.concat(F.lit(f"{field}:"), tag))
    style, kind = F.col("style_primary"), F.col("building_type")
    clip_style = score("style", style)
    found = conflicting(style, kind, clip_style, score("building_type", kind), F.col("style_votes"), F.col("building_type_votes"))
    out = both.withColumn("stripped", F.when(F.col("final"), found).otherwise(F.array().cast("array<string>")))
    anew = decision(F.col("stripped"), F.col(confidence), clip_style, F.col("style_pass"))
    return out.withColumn(status, F.when(F.col("final"), anew).otherwise(F.col(status))).select(*rows.columns, "stripped")


def retried(first: DataFrame, second: DataFrame, key: str, status: str = "tag_status", stripped: str = "stripped") -> DataFrame:
    """The rows of ``second`` (a second extraction) that count: of quarantined rows with stripped tags, and not failed (``ok``)."""
    asked = first.where((F.col(status) == "quarantined") & (F.size(stripped) > 0)).select(key)
    return second.where(F.coalesce(F.col("ok"), F.lit(False))).join(asked, key, "left_semi")


def revalidated(first: DataFrame, second: DataFrame, key_vectors: DataFrame, vectors: DataFrame, neighbours: DataFrame, columns: list[str], confidence: str = "confidence", status: str = "tag_status", least_corpus: int = LEAST_CORPUS) -> DataFrame:
    """The second pass as one step: ``first`` rows (id, style_primary, building_type, confidence, status, stripped), with their final status.

    Only quarantined rows with stripped tags and a second extraction that did not fail take its ``columns``; for those alone prompt
    agreement (against (key, key_vec) vectors) and neighbours' votes (among (id, style, building_type) rows) are computed anew, and their new tags are judged.
    """
    again = retried(first, second, "id", status)
    merged = second_pass(first.drop("stripped"), again, "id", columns)
    final = merged.where("final").select("id", "style_primary", "building_type")
    keys = prompts(F.col("style_primary"), F.col("building_type"), F.array().cast("array<string>"))
    clip = prompt_agreement(final.join(vectors.select("id", "vec"), "id").select("id", "vec", keys.alias("prompts")), key_vectors)
    votes = neighbour_votes(neighbours, vectors, final.withColumnRenamed("style_primary", "style"), least_corpus=least_corpus)
    return rejudged(merged, clip, votes, confidence, status)


def skipped(artifacts: Column, status: Column) -> Column:
    return artifacts.isNull() | F.coalesce(status == "not_applicable", F.lit(False))


def subject_ok(kind: Column, confidence: Column, least: float = SUBJECT_CONFIDENCE) -> Column:
    return F.coalesce((kind != "") & (kind != "not_applicable") & (confidence >= least), F.lit(False))
