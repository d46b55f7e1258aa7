"""Predicates and projections over the image table. Every predicate is false, not null, where it cannot be told."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def told(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(or_, conditions, F.lit(False))


def contains_any(column: Column | str, values: Iterable[str], spaced: bool = False) -> Column:
    """Any value is in the text without regard to case; ``%`` and ``_`` in a value are wildcards."""
    return any_of(told(_c(column).ilike(f"%{v.replace('_', ' ') if spaced else v}%")) for v in values)


def period(column: Column | str, between: tuple[int, int] | None) -> Column:
    return told(_c(column).between(*between)) if between and len(between) == 2 else F.lit(True)


def typology(values: list[str], typologies: Column, *types: Column) -> Column:
    joined = F.array_join(typologies, ",")
    return any_of(contains_any(c, values) for c in (joined, *types))


def material(values: list[str], materials: Column | str) -> Column:
    return contains_any(F.array_join(_c(materials), ","), values)


def country(value: str, column: Column | str) -> Column:
    return told(F.lower(_c(column)) == value.lower())


def one_or_more(value: str | list[str], column: Column | str) -> Column:
    """Structural system and climate zone: a value or a list, underscores as spaces."""
    return contains_any(column, [value] if isinstance(value, str) else value, spaced=True)


def normal(label: Column | str) -> Column:
    return F.replace(F.lower(F.trim(_c(label))), F.lit("_"), F.lit(" "))


def style(values: list[str], *columns: Column) -> Column:
    return any_of(contains_any(F.replace(F.lower(c), F.lit("_"), F.lit(" ")), [v.lower() for v in values], spaced=True) for c in columns)


def all_of(conditions: Iterable[Column]) -> Column:
    """AND across facets; no facet lets everything pass."""
    return reduce(and_, conditions, F.lit(True))


MOST_PREDICATES = 4096  # different (facet, value) predicates of one call
Facets = dict[str, Callable[[str], Column]]


def facets(*, year: Column | str | None = None, typologies: Column | None = None, types: tuple[Column, ...] = (), materials: Column | str | None = None, country_: Column | str | None = None, structure: Column | str | None = None, climate: Column | str | None = None, styles: tuple[Column, ...] = ()) -> Facets:
    """The facets of filters that come as data: for each name a predicate over the given columns for one value (a period is ``from..to``)."""
    found: Facets = {}
    if year is not None:
        found["period"] = lambda v: told(_c(year).between(*(F.lit(x).try_cast("int") for x in v.split("..", 1))))
    if typologies is not None:
        found["typology"] = lambda v: typology([v], typologies, *types)
    if materials is not None:
        found["material"] = lambda v: material([v], materials)
    if country_ is not None:
        found["country"] = lambda v: country(v, country_)
    if structure is not None:
        found["structural_system"] = lambda v: one_or_more(v, structure)
    if climate is not None:
        found["climate_zone"] = lambda v: one_or_more(v, climate)
    if styles:
        found["style"] = lambda v: style([v], *styles)
    return found


def compiled(queries: DataFrame, rows: DataFrame, known: Facets, column: str = "filters") -> tuple[DataFrame, DataFrame]:
    """(queries with ``wanted``, rows with ``bits``) for queries that carry a map of facet -> values each.

    The different (facet, value) predicates of all queries are evaluated once a row, into ``bits``; ``wanted`` names, for each
    facet of the query, the places (from 1) of those of which one must hold. A null or empty map, an empty list, a facet that is not
    known and a period that is not of two values let everything pass.
    """
    entries = F.filter(F.map_entries(F.coalesce(F.col(column), F.create_map().cast("map<string,array<string>>"))), lambda e: e["key"].isin(list(known)) & (F.size(e["value"]) > 0) & ((e["key"] != "period") | (F.size(e["value"]) == 2)))
    values = lambda e: F.when(e["key"] == "period", F.array(F.array_join(e["value"], ".."))).otherwise(F.array_compact(e["value"]))
    named = F.transform(entries, lambda e: F.transform(values(e), lambda v: F.concat(e["key"], F.lit("\n"), v)))
    asked = queries.withColumn("wanted", named)
    rows_ = asked.select(F.explode(F.flatten("wanted")).alias("p")).distinct().limit(MOST_PREDICATES + 1).collect()
    if len(rows_) > MOST_PREDICATES:
        raise ValueError(f"more than {MOST_PREDICATES} different predicates in one call")
    predicates = sorted(r["p"] for r in rows_)
    places = F.array(*[F.lit(p) for p in predicates]).cast("array<string>")
    asked = asked.withColumn("wanted", F.transform("wanted", lambda facet: F.transform(facet, lambda p: F.array_position(places, p).cast("int"))))
    held = [told(known[name](value)) for name, value in (p.split("\n", 1) for p in predicates)]
    return asked, rows.withColumn("bits", F.array(*held).cast("array<boolean>"))


def passes(wanted: Column | str, bits: Column | str) -> Column:
    """Whether a row of ``bits`` meets a query of ``wanted``."""
    return F.forall(_c(wanted), lambda facet: F.exists(facet, lambda place: F.element_at(_c(bits), place)))


def keep_candidates(candidates: DataFrame, rows: DataFrame, condition: Column, key: str = "image_id") -> DataFrame:
    """Candidates (with their rank) whose row meets the condition; one semi-join, order by the carried rank."""
    return candidates.join(rows.where(condition).select(key), key, "left_semi")


def relative_floor(scored: DataFrame, threshold: float, drop: float = 0.20, query: str = "qid") -> DataFrame:
    """score >= max(top of the query - drop, threshold)."""
    top = F.max("score").over(W.partitionBy(query))
    return scored.withColumn("floor", F.greatest(top - drop, F.lit(threshold))).where(F.col("score") >= F.col("floor")).drop("floor")


def either_floor(threshold: float, *scores: Column | str) -> Column:
    return any_of(F.coalesce(_c(s), F.lit(0.0)) >= threshold for s in scores)


def visible(owner: str | None, column: Column | str = "owner", shared: bool = True) -> Column:
    """Documents: own or ownerless (``shared``); images: own only; without an owner, everything."""
    if owner is None:
        return F.lit(True)
    mine = told(_c(column) == owner)
    return (mine | _c(column).isNull()) if shared else mine


def needs_index(status: Column | str, chunks: Column | str, failed: bool = True) -> Column:
    states = ["queued", "indexing", *["failed"] * failed]
    return _c(status).isin(states) | ((_c(status) == "ready") & (F.coalesce(_c(chunks), F.lit(0)) == 0))


def library_filter(styles: Column, types: Column, countries: Column, years: Column, *, style: str | None = None, kind: str | None = None, country: str | None = None, between: tuple[int, int] | None = None) -> Column:
    """The library's own filter: literal containment, and rows without a year pass."""
    tests = []
    if style:
        tests.append(told(F.contains(normal(styles), F.lit(style.lower().replace("_", " ")))))
    if kind:
        tests.append(told(F.contains(normal(types), F.lit(kind.lower().replace("_", " ")))))
    if country:
        tests.append(told(countries == country))
    if between:
        tests.append(years.isNull() | years.between(*between))
    return all_of(tests)


def highlighted(tags: Column, query: str) -> Column:
    """The tags that hold any word of the query."""
    tokens = [t for t in re.split(r"[\s,]+", query.lower()) if t]
    return F.filter(tags, lambda t: any_of(F.contains(F.lower(t), F.lit(x)) for x in tokens))


def top_of_each(rows: DataFrame, group: str, n: int, *order: Column | str) -> DataFrame:
    """The first n rows of each group in the given order, with ``place`` from 1; a task sends n rows of a group at most."""
    return rows.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("place") <= n)


def largest_regions(regions: DataFrame, area: Column | str, least: float = 0.02, n: int = 12, group: str = "image", order: str = "region") -> DataFrame:
    return top_of_each(regions.where(_c(area) >= least), group, n, _c(area).desc(), order)
