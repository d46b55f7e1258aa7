"""Information-theoretic sanitisation of personal data, in Spark SQL functions only.

Base patterns find protected values (e-mail, IP, card, phone). Protected entities are those values and
their classes: the kind, an e-mail's domain, an IP's first three parts, a card's first six digits, a
phone number without its last seven. Corpus co-occurrence tells how strongly a term t (a word of three
letters or more outside of the base spans) reveals an entity c:

    share(c, t) = PMI(c; t) / IC(c),   PMI = log2( n(c,t) * N / (n(c) * n(t)) ),   IC = log2(N / n(c))

All counts are numbers of different whole texts, wherever in a text the two stand, so that exact copies
are no evidence. A pair counts where its log-likelihood ratio G2 is significant at ``error`` (0.001) over all
pairs that are tested (Bonferroni: p < error / pairs), so that what one text alone holds by chance, which every text does, tells nothing;
two texts that hold both are the least evidence. (What stands beside an entity in the one text that holds either has the full share, yet
evidence of one: of such words those that look like names, ``[NAME]`` and ``[ACRONYM]``, are generalised, and none is removed.) A term with a share of ``remove_at`` for some entity of a text is
removed from that text, one of ``generalise_at`` is generalised to the class of words of its shape
(``[NAME]``, ``[ACRONYM]``, ``[WORD]``); every occurrence becomes a further span.

Entities that the same texts hold tell the same, so they are one set of holders. An entity of a single
text needs no pairs at all (n(c) = n(c,t) = 1). Thus a text with very many values is no square.

Defined results: null text counts as empty; empty texts have no spans; repeated rows each get
their spans; an empty table gives an empty result; other columns of the input are kept by
``sanitise`` and ignored by ``find``, whatever their names.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import join_small, materialise

KINDS = ("email", "ip", "card", "phone")
# Possessive forms of the contract's patterns: the same matches, no backtracking and no deep recursion on long runs.
# A run is entered at its start, or where the match before it ended, as a later entry cannot succeed where that one failed.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_IP = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"
_WORD = r"(?<![\p{L}\p{N}])\p{L}{3,}+(?![\p{L}\p{N}])"


PAGE = 4096  # code points of a page; rewriting works on pages, so that a long text is not walked for every span
COPIES = 1000  # rows of one text that meet in a task; texts of more rows are dealt over several


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start,end,value>> of the leftmost non-overlapping matches, in code points, end exclusive.

    Many matches are placed in parts of about the square root of their number, as an array that grows by one costs its length.
    """
    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    zero = F.lit(0).cast("long")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        one = F.array(F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("value")))
        return F.struct(end.alias("at"), F.concat(acc["out"], one).alias("out"))

    def placed(pairs: Column, at: Column) -> Column:
        return F.aggregate(pairs, F.struct(at.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def starts(parts: Column) -> Column:
        size = lambda part: F.aggregate(part, zero, lambda n, x: n + F.length(x["gap"]) + F.length(x["hit"]))
        first = F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(parts, first, lambda acc, part: F.struct((acc["at"] + size(part)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def place(pairs: Column) -> Column:
        per = F.ceil(F.sqrt(F.size(pairs))).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.ceil(F.size(pairs) / per).cast("int") - 1), lambda i: F.slice(pairs, i * per + 1, per))
        return F.when(F.size(pairs) <= 64, placed(pairs, zero)).otherwise(_let(parts, lambda p: F.flatten(F.zip_with(p, starts(p), placed))))

    def paired(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
        return F.when(F.size(found) > 0, _let(F.zip_with(gaps, found, lambda g, h: F.struct(g.alias("gap"), h.alias("hit"))), place)).otherwise(none)

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), paired)


def pages(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PAGE}}}"), F.lit(0))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.when(n.between(16, 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0).otherwise(False)


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(_IP)
    if kind == "card":
        return _luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    must = {"email": "@", "phone": "+", "ip": "."}.get(kind)
    found = F.filter(matches(text, PATTERNS[kind]), lambda m: _valid(kind, m["value"]))
    if must:
        found = F.when(F.contains(text, F.lit(must)), found).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,value:string>>"))
    return F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def entities(base: Column) -> Column:
    """Hashes of the protected values of ``base`` and of their classes."""

    def told(s: Column) -> Column:
        digits = _digits(s["value"])
        group = (
            F.when(s["kind"] == "email", F.substring_index(F.lower(s["value"]), "@", -1)).when(s["kind"] == "ip", F.substring_index(s["value"], ".", 3))
            .when(s["kind"] == "card", F.substring(digits, 1, 6)).otherwise(F.substring(digits, F.lit(1), F.length(digits) - 7))
        )
        return F.array(F.xxhash64(s["kind"]), F.xxhash64(s["kind"], F.lit("class"), group), F.xxhash64(s["kind"], F.lit("value"), F.lower(s["value"])))

    return F.array_distinct(F.flatten(F.transform(base, told)))


def _words(text: Column) -> Column:
    """array<struct<start,end,term,shape>>: every word of the text with its place; ``term`` is a hash of the word in lower case."""
    shape = lambda w: F.when(w.rlike(r"^\p{Lu}{2}"), "[ACRONYM]").when(w.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")
    return F.transform(matches(text, _WORD), lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), F.xxhash64(F.lower(w["value"])).alias("term"), shape(w["value"]).alias("shape")))


def _terms(words: Column) -> Column:
    return F.array_distinct(F.transform(words, lambda w: w["term"]))


def g2(n_ct: Column, n_c: Column, n_t: Column, n: Column) -> Column:
    """The log-likelihood ratio of the 2 x 2 table of texts with and without entity and term."""
    cell = lambda x, row, col: F.when(x > 0, x * F.log(x * n / (row * col))).otherwise(0.0)
    return 2 * (cell(n_ct, n_c, n_t) + cell(n_c - n_ct, n_c, n - n_t) + cell(n_t - n_ct, n - n_c, n_t) + cell(n - n_c - n_t + n_ct, n - n_c, n - n_t))


def significant(error: float, tests: float) -> float:
    """The least G2 (chi-squared of one degree of freedom) at which one of so many tests is significant."""
    return NormalDist().inv_cdf(error / max(tests, 1.0) / 2) ** 2


def marked(docs: DataFrame, *, generalise_at: float = 0.8, remove_at: float = 0.95, error: float = 0.001) -> DataFrame:
    """row (a struct of the columns of ``docs``), base (spans of the patterns), added (spans of the disclosing terms, by start) of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    scan = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("text"), F.concat(*[base_spans(text, k) for k in KINDS]).alias("base"))
    private = F.size("base") > 0
    scan = scan.select("row", "base", private.alias("private"), F.md5(F.col("text").cast("binary")).alias("whole"), F.when(private, entities(F.col("base"))).alias("entities"), F.when(private, _words(blanked(F.col("text"), F.col("base")))).alias("words"))
    scan = materialise(scan, "pii-scan")
    copies = materialise(scan.groupBy("whole").agg(F.count("*").alias("copies")), "pii-copies")
    n = F.lit(float(max(copies.count(), 1)))  # different whole texts
    several = copies.where("copies > 1")

    texts = scan.where("private").groupBy("whole").agg(F.any_value("entities").alias("entities"), F.any_value("words").alias("words"))
    texts = materialise(texts.select("whole", "entities", "words", _terms(F.col("words")).alias("terms")), "pii-texts")
    clean = join_small(scan.where("not private").select("whole", F.coalesce("row.text", F.lit("")).alias("text")), several, "whole", "left")
    clean_terms = F.array_distinct(F.transform(F.regexp_extract_all(F.col("text"), F.lit(_WORD), F.lit(0)), lambda w: F.xxhash64(F.lower(w))))
    seen = clean.select(F.explode(clean_terms).alias("term"), (1.0 / F.coalesce("copies", F.lit(1))).alias("part"), F.lit(0).alias("own"))  # a text's copies add up to one
    seen = seen.unionByName(texts.select(F.explode("terms").alias("term"), F.lit(1.0).alias("part"), F.lit(1).alias("own")))
    counts = seen.groupBy("term").agg(F.round(F.sum("part")).alias("n_t"), F.sum("own").cast("double").alias("n_p"))  # n_p: texts with personal data
    # the largest share that a term can have is that for an entity of just its n_p texts; most terms cannot reach the threshold for any
    reach = F.when(F.col("n_p") < n, 1 - F.log2(F.col("n_t") / F.col("n_p")) / F.log2(n / F.col("n_p"))).otherwise(0.0)
    counts = counts.where((F.col("n_p") > 0) & ((F.col("n_t") == 1) | ((F.col("n_p") >= 2) & (reach >= generalise_at - 1e-6))))
    counts = materialise(counts, "pii-terms")

    held = texts.select("whole", F.explode("entities").alias("entity"))
    holders = held.groupBy("entity").agg(F.count("*").alias("n_c"), F.bit_xor(F.xxhash64("whole")).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), "whole")).alias("b"))
    sets = join_small(held, holders, "entity", "inner").select("whole", F.struct("n_c", "a", "b").alias("holders")).distinct()
    sets = materialise(sets, "pii-holders")

    n_sets = sets.groupBy("whole").agg(F.count("*").alias("n_sets"))
    tests = texts.join(n_sets, "whole").agg(F.sum(F.size("terms").cast("double") * F.col("n_sets"))).first()[0]  # a pair counts in each text that holds it
    least = significant(error, tests or 1.0)

    def told(pairs: DataFrame) -> DataFrame:
        """Pairs with n_c, n_ct and n_t that disclose, with their action."""
        ic, pmi = F.log2(n / F.col("n_c")), F.log2(F.col("n_ct") * n / (F.col("n_c") * F.col("n_t")))
        found = pairs.withColumn("share", F.when(ic > 0, F.round(pmi / ic, 9)).otherwise(0.0)).where(F.col("share") >= generalise_at)
        return found.where("n_ct >= 2").where(g2(F.col("n_ct"), F.col("n_c"), F.col("n_t"), n) >= least).withColumn("action", F.when(F.col("share") >= remove_at, "removed").otherwise("generalised"))

    # what a pair can reach at most, were every text of the rarer side to hold both, spares most pairs
    terms = materialise(texts.select("whole", F.explode("terms").alias("term")).join(counts, "term"), "pii-occurrences")
    pairs = sets.where("holders.n_c > 1").join(terms.where("n_t > 1"), "whole").select("whole", "holders", "term", "n_t", F.col("holders.n_c").alias("n_c"), "n_p")
    pairs = materialise(told(pairs.withColumn("n_ct", F.least("n_c", "n_p"))).select("whole", "holders", "term", "n_t", "n_c"), "pii-pairs")
    shared = told(pairs.groupBy("holders", "term", "n_t", "n_c").agg(F.count("*").cast("double").alias("n_ct"))).select("holders", "term", "action")
    alone = terms.join(sets.where("holders.n_c = 1").select("whole").distinct(), "whole", "left_semi")
    once = alone.where("n_t = 1").select("whole", "term", F.lit("alone").alias("action"))  # the weakest action by name too
    both = once.unionByName(join_small(pairs.select("whole", "holders", "term"), shared, ["holders", "term"], "inner").select("whole", "term", "action")).groupBy("whole", "term").agg(F.max("action").alias("action"))

    at = texts.select("whole", F.inline("words")).join(both, ["whole", "term"]).where("action <> 'alone' or shape <> '[WORD]'")
    at = at.withColumn("action", F.when(F.col("action") == "alone", "generalised").otherwise(F.col("action")))
    spans = at.groupBy("whole").agg(F.sort_array(F.collect_list(F.struct("start", "end", "action", "shape"))).alias("added"))  # a text's own words at most
    lots = lambda copies: F.ceil(copies / F.lit(COPIES))
    spans = spans.join(several, "whole", "left").select("whole", "added", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(lots(F.col("copies")), F.lit(1)).cast("long") - 1)).alias("lot"))
    rows = join_small(scan.where("private").select("row", "base", "whole"), several, "whole", "left")
    rows = rows.withColumn("lot", F.pmod(F.xxhash64(F.col("row").getField("doc_id")), F.coalesce(lots(F.col("copies")), F.lit(1)).cast("long"))).drop("copies")
    none = F.array().cast(spans.schema["added"].dataType)
    rows = rows.join(spans, ["whole", "lot"], "left").select("row", "base", F.coalesce("added", none).alias("added"))
    return scan.where("not private").select("row", "base", none.alias("added")).unionByName(rows)


def find(docs: DataFrame, **options) -> DataFrame:
    """One row per document row: doc_id, base spans of all kinds, ``added`` term spans with their action."""
    return marked(docs.select("doc_id", "text"), **options).select(F.col("row.doc_id").alias("doc_id"), "base", "added")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from ``find``."""
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    terms = F.transform("added", lambda s: F.struct(F.lit("term").alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["action"].alias("value")))
    return found.select("doc_id", *[n(k) for k in KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", terms)).alias("spans"), F.size("added").cast("long").alias("n_term"))


def rewritten(text: Column, marks: Column) -> Column:
    """``text`` with each of ``marks`` (struct<start,end,mark>, sorted) replaced by its ``mark``, or by as many blanks where that is null.

    Of overlapping marks the first is taken, the others only cover what is left.
    """

    def rewrite(x: Column) -> Column:
        """One page: ``x.at`` is where marks of earlier pages end."""
        off = x["off"]

        def step(acc: Column, s: Column) -> Column:
            kept = F.substring(x["page"], (acc["at"] - off + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0).cast("long")).cast("int"))
            blank = F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(s["start"], acc["at"]), F.lit(0).cast("long")).cast("int"))
            mark = F.when(s["mark"].isNull(), blank).when(s["start"] >= acc["at"], s["mark"]).otherwise("")
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], kept, mark).alias("out"))

        zero = F.struct(F.greatest(x["at"], off).alias("at"), F.lit("").alias("out"))
        done = lambda acc: F.concat(acc["out"], F.substring(x["page"], F.least(acc["at"] - off + 1, F.lit(PAGE + 1)).cast("int"), F.lit(PAGE)))
        return F.aggregate(x["marks"], zero, step, done)

    def whole(found: Column) -> Column:
        """Pages with their marks, found in two levels: chapters of about the square root of the pages, then pages."""

        def chapters(p: Column) -> Column:
            per = F.ceil(F.sqrt(F.size(p))).cast("int")
            span = lambda m, n: F.floor(m["start"] / (PAGE * n)).cast("int")

            def chapter(c: Column) -> Column:
                return _let(F.filter(found, lambda m: span(m, per) == c), lambda own: F.transform(F.slice(p, c * per + 1, per), lambda page, i: F.struct(page.alias("page"), F.filter(own, lambda m: span(m, 1) == c * per + i).alias("marks"))))

            return F.flatten(F.transform(F.sequence(F.lit(0), F.ceil(F.size(p) / per).cast("int") - 1), chapter))

        last = lambda x: F.coalesce(F.array_max(F.transform(x["marks"], lambda m: m["end"])), F.lit(0).cast("long"))
        first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
        ends = lambda o: F.aggregate(o, first, lambda acc, x: F.struct(F.greatest(acc["at"], last(x)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        placed = lambda o: F.zip_with(F.transform(o, lambda x, i: F.struct(x["page"].alias("page"), x["marks"].alias("marks"), (i.cast("long") * PAGE).alias("off"))), ends(o), lambda x, at: F.struct(at.alias("at"), x["page"].alias("page"), x["marks"].alias("marks"), x["off"].alias("off")))
        return F.array_join(F.transform(_let(_let(pages(text), chapters), placed), rewrite), "")

    return F.when(F.size(marks) > 0, _let(marks, whole)).otherwise(text)


def _mark(s: Column, mark: Column) -> Column:
    return F.struct(s["start"].alias("start"), s["end"].alias("end"), mark.alias("mark"))


def blanked(text: Column, base: Column) -> Column:
    """``text`` with blanks for its base spans: the words that remain keep their places."""
    return rewritten(text, F.sort_array(F.transform(base, lambda s: _mark(s, F.lit(None).cast("string")))))


def sanitised(text: Column, base: Column, added: Column) -> Column:
    """``text`` with base spans replaced by ``[KIND]``, generalised terms by the class of their shape, and removed terms cut out."""
    kinds = F.transform(base, lambda s: _mark(s, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))
    return rewritten(text, F.sort_array(F.concat(kinds, F.transform(added, lambda s: _mark(s, F.when(s["action"] == "removed", "").otherwise(s["shape"]))))))


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every span taken out of ``text``; all other columns and rows stay (null text stays null)."""
    found = marked(docs, **options)
    text = sanitised(F.col("row").getField("text"), F.col("base"), F.col("added"))
    return found.select(*[text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
