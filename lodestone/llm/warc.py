"""A content-addressed WARC archive: payload bytes once per strong digest, exact record headers apart.

``write`` makes two tables in the shared folder. ``payloads`` has a row per distinct payload
(SHA-256, SHA-1, bytes); payloads of equal digest are verified by their SHA-1 and length while they are
merged, so that their bytes are shuffled once. ``records`` has the exact header bytes of each record and
the SHA-256 that leads to its payload. ``rebuild`` joins them back into whole WARC records, and
``read_back`` tells from those bytes alone what each record is.

Of the records whose payloads are equal and hold at least ``least`` bytes, the one with the
largest page_id is a response and the others are revisits of it.

Defined results: null html is an empty payload; a null url leaves out the target URI; rows that
repeat the largest page_id are responses too; where all page_ids of equal payloads are null,
each is a response; an empty table gives an empty archive; further columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import materialise

CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"
_ID = "urn:lodestone:page:"


class Archive(NamedTuple):
    records: DataFrame
    payloads: DataFrame


def _line(name: str, *value: Column | str) -> Column:
    """``name: value`` and a line end; null (and so absent) if any part of the value is null."""
    return F.concat(F.lit(f"{name}: "), *[F.lit(v) if isinstance(v, str) else v for v in value], F.lit(CRLF))


def write(pages: DataFrame, least: int = 1000) -> Archive:
    src = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).withColumn("sha256", F.sha2("payload", 256))
    proof = F.struct(F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("n"))
    kept = src.withColumn("proof", proof).groupBy("sha256").agg(F.max("page_id").alias("response"), F.min("proof").alias("low"), F.max("proof").alias("high"), F.any_value("payload").alias("payload"))
    two = F.raise_error(F.concat(F.lit("two payloads have the SHA-256 "), F.col("sha256"))).cast("binary")
    one = F.when(F.col("low") == F.col("high"), F.col("payload")).otherwise(two)
    payloads = materialise(kept.select("sha256", F.col("low.sha1").alias("sha1"), F.col("low.n").alias("n"), "response", one.alias("payload")), "warc-payloads")

    rows = src.select("page_id", "url", "sha256").join(payloads.select("sha256", "sha1", "n", "response"), "sha256")
    revisit = (F.col("n") >= least) & F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}"), _line("Content-Type", "text/html; charset=utf-8"), _line("Content-Length", F.col("n").cast("string")), F.lit(CRLF))
    held = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n"))
    empty = F.lit("")
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", f"<{_ID}", F.coalesce(F.col("page_id").cast("string"), F.lit("none")), ">"),
        _line("WARC-Date", DATE),
        F.coalesce(_line("WARC-Target-URI", F.regexp_replace("url", "[\r\n]+", "")), empty),
        _line("WARC-Payload-Digest", "sha1:", F.col("sha1")),
        F.when(revisit, F.concat(_line("WARC-Refers-To", f"<{_ID}", F.col("response").cast("string"), ">"), _line("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(empty),
        _line("Content-Type", "application/http; msgtype=response"),
        _line("Content-Length", held.cast("string")),
        F.lit(CRLF),
    )
    return Archive(materialise(rows.select("sha256", F.encode(F.concat(header, http), "UTF-8").alias("header")), "warc-records"), payloads)


def _is_revisit() -> Column:
    return F.contains("header", F.lit(f"{CRLF}WARC-Type: revisit{CRLF}").cast("binary"))


def verified(payloads: DataFrame) -> DataFrame:
    """sha256 and payload of the stored bytes, the digest computed anew; a mismatch stops the job."""
    wrong = F.raise_error(F.concat(F.lit("stored payload differs from its digest "), F.col("sha256")))
    return payloads.select(F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("sha256")).otherwise(wrong).alias("sha256"), "payload")


def rebuild(archive: Archive) -> DataFrame:
    """sha256, record: the bytes of each whole WARC record. Responses are joined with their payloads; revisits have none."""
    end = F.lit(2 * CRLF).cast("binary")
    whole = archive.records.where(~_is_revisit()).join(verified(archive.payloads), "sha256").select("sha256", F.concat("header", "payload", end).alias("record"))
    return whole.unionByName(archive.records.where(_is_revisit()).select("sha256", F.concat("header", end).alias("record")))


def read_back(archive: Archive) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, all from the bytes of the rebuilt records.

    A revisit's payload is the stored one that its record leads to; its length and digest come from those bytes.
    """
    text = F.col("record").cast("string")  # the same bytes, unchecked
    head = F.substring_index(text, 2 * CRLF, 1)
    start = F.octet_length(F.substring_index(text, 2 * CRLF, 2)) + 5
    rows = rebuild(archive).select("sha256", head.alias("head"), F.expr("record").substr(start, F.octet_length("record") - start - 3).alias("payload"))
    number = lambda name: F.regexp_extract("head", rf"\r\n{name}: <{_ID}(-?[0-9]+)>", 1).try_cast("long")
    kind, told = F.regexp_extract("head", r"\r\nWARC-Type: (\w+)", 1), F.regexp_extract("head", r"\r\nWARC-Payload-Digest: sha1:(\w+)", 1)
    rows = rows.select("sha256", number("WARC-Record-ID").alias("page_id"), kind.alias("record_type"), number("WARC-Refers-To").alias("refers_to"), told.alias("told"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    true = F.when(F.col("told") == F.col("payload_digest"), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("a header tells another digest than its payload has: "), F.col("told"))))
    facts = archive.payloads.select("sha256", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    both = rows.where("record_type <> 'revisit'").unionByName(rows.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest").join(facts, "sha256"))
    return both.select("page_id", "payload_bytes", true.alias("payload_digest"), "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
k AS (SELECT h, max(page_id) AS response FROM p GROUP BY h)
SELECT p.page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes, sha1(p.h) AS payload_digest,
       CASE WHEN strlen(p.h) >= 1000 AND p.page_id <> k.response THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(p.h) >= 1000 AND p.page_id <> k.response THEN k.response END AS refers_to
FROM p JOIN k ON p.h = k.h
"""
