"""Document chat: excerpts, dialogue turns, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SNIPPET = 240
NOT_FOUND = "I could not find this in your documents"


def last_turns(turns: DataFrame, n: int = 6) -> DataFrame:
    """conv_id, history: the last n turns as ``User: …`` and ``Assistant: …`` lines; blank ones are left out."""
    place = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("text")))
    kept = turns.withColumn("place", place).where(F.col("place") <= n).where(F.trim(F.coalesce("text", F.lit(""))) != "")
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), "text")
    told = kept.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("place")).alias("p"), line.alias("line")))).alias("lines"))
    return told.select("conv_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("history"))


def label(title: Column, page: Column) -> Column:
    return F.concat(F.lit("["), title, F.lit(", p."), page.cast("string"), F.lit("]"))


def excerpts(hits: DataFrame) -> DataFrame:
    """qid, context: ``[title, p.N]`` and the text of each hit in rank order, parted by blank lines."""
    block = F.concat(label(F.col("title"), F.col("page")), F.lit("\n"), F.col("text"))
    told = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))).alias("blocks"))
    return told.select("qid", F.array_join(F.transform("blocks", lambda x: x["block"]), "\n\n").alias("context"))


def citations(hits: DataFrame, answers: DataFrame, length: int = SNIPPET, fallback: int = 3) -> DataFrame:
    """qid, title, page, snippet, place: one citation a (source, page) in rank order, those named in the answer, else the first three."""
    snippet = F.when(F.length("text") > length, F.concat(F.substring("text", 1, length), F.lit("…"))).otherwise(F.col("text"))
    short = hits.select("qid", "rank", "title", "page", snippet.alias("snippet"))  # whole texts go through no sort
    first = short.withColumn("_p", F.row_number().over(W.partitionBy("qid", "title", "page").orderBy("rank"))).where("_p = 1").drop("_p")
    named = first.join(answers, "qid").withColumn("named", F.contains(F.col("answer"), label(F.col("title"), F.col("page"))).cast("int"))
    any_ = F.max("named").over(W.partitionBy("qid"))
    place = F.row_number().over(W.partitionBy("qid", "named").orderBy("rank"))
    kept = named.withColumn("any_", any_).withColumn("place", place).where(F.when(F.col("any_") == 1, F.col("named") == 1).otherwise(F.col("place") <= fallback))
    return kept.select("qid", "title", "page", "snippet", "place")


def is_not_found(answer: Column, reply: str = NOT_FOUND, shorter: int = 80) -> Column:
    return F.contains(F.lower(answer), F.lit(reply.lower())) & (F.length(answer) < shorter)
