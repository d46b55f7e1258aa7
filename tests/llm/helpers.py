"""Small inputs that hold the odd cases of every operator."""

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, label string, key long, n long, h long"
WORDS = "the quick brown fox jumps over a lazy dog while seven old owls watch from tall dark trees near our quiet river bank".split()


def docs(spark: SparkSession, texts: list, ids: list | None = None, sources: list | None = None) -> DataFrame:
    """Documents with further columns whose names clash with those used inside; two partitions."""
    ids = list(range(len(texts))) if ids is None else ids
    sources = [f"s{i % 3}" for i in range(len(texts))] if sources is None else sources
    rows = [(i, t, None, s, None, 0.5, "x", 1, 2, 3) for i, t, s in zip(ids, texts, sources, strict=True)]
    return spark.createDataFrame(rows, DOCS).repartition(2) if rows else spark.createDataFrame([], DOCS)


def prose(seed: int, n: int = 60) -> str:
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "ly", "s", str(rng.randrange(50))]) for _ in range(n))


ODD = [None, "", " \n\t ", "word", "x" * 200_000, "7" * 50_000, "a b " * 30_000, "é▁ü   🙂 \x00 end", "same text here", "same text here", "a@" * 5_000, "+1 " * 5_000]
