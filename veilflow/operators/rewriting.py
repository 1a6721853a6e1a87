"""Placeholders: stable numbers by first appearance, rewritten texts, maps and counts, all within the row."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..entities import Registry
from ..functions import scalar as S
from ..functions.spans import in_order, let, slicing
from . import search


def numbered(spans: Column, registry: Registry | None = None) -> Column:
    """Spans left to right, each with label, norm, number and placeholder. Within a label, equal normal
    forms share a number, and numbers follow first appearance."""
    registry = registry or Registry()
    fields = ("entity_type", "start", "end", "score", "surface")
    fields = ("entity_type", "start", "end", "score", "surface")
    rich = F.transform(in_order(spans), lambda x: F.struct(*[x[c].alias(c) for c in fields], registry.label_column(x["entity_type"]).alias("label"), S.entity_norm(x["surface"]).alias("norm")))
    return let(rich, _numbered)


def _first(xs: Column, *fields: str) -> Callable[[Column, Column], Column]:
    """Of a sorted array: does an element, given with its place, differ from the one before in one of the fields?"""

    def differs(x: Column, j: Column) -> Column:
        before = F.get(xs, j - 1)
        return functools.reduce(lambda a, b: a | b, [before[f] != x[f] for f in fields], j == 0)

    return differs


def _numbered(rich: Column) -> Column:
    """Entities are numbered by sorts, so many in one document cost little more each: spans by label, form and place bring
    an entity's together, its first ones by label and place give the numbers, and these are sorted back."""

    def entities(ordered: Column) -> Column:
        heads = F.transform(ordered, lambda x, j: F.struct(x["label"].alias("label"), x["i"].alias("i"), j.alias("j"), _first(ordered, "label", "norm")(x, j).alias("new")))
        return let(F.filter(heads, lambda x: x["new"]), lambda hs: members(ordered, hs))

    def members(ordered: Column, heads: Column) -> Column:
        """(i, number) of each span: those of entity g stand from its head to the next one's."""

        def of(own: Column) -> Column:
            last = lambda g: F.coalesce(F.get(heads, g + 1)["j"], F.size(ordered)) - 1
            return F.flatten(F.transform(own, lambda e: F.transform(F.sequence(F.get(heads, e["g"])["j"], last(e["g"])), lambda j: F.struct(F.get(ordered, j)["i"].alias("i"), e["number"].alias("number")))))

        return F.array_sort(let(let(F.array_sort(F.transform(heads, lambda x, g: F.struct(x["label"].alias("label"), x["i"].alias("i"), g.alias("g")))), counted), of))

    def counted(ranked: Column) -> Column:
        """(g, number) of each entity: its place among those of its label, which lie together."""
        starts = F.filter(F.transform(ranked, lambda x, j: F.struct(x["label"].alias("label"), j.alias("j"), _first(ranked, "label")(x, j).alias("new"))), lambda x: x["new"])
        return let(starts, lambda own: F.transform(ranked, lambda x, j: F.struct(x["g"].alias("g"), (j - F.get(F.filter(own, lambda h: h["label"] == x["label"]), 0)["j"] + 1).cast("int").alias("number"))))

    def named(numbers: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            number = F.get(numbers, i)["number"]
            name = F.concat(F.lit("["), x["label"], F.lit("_"), number.cast("string"), F.lit("]"))
            return F.struct(*[x[c].alias(c) for c in ("entity_type", "start", "end", "score", "surface", "label", "norm")], number.alias("number"), name.alias("placeholder"))

        return F.transform(rich, one)

    return let(let(F.array_sort(F.transform(rich, lambda x, i: F.struct(x["label"].alias("label"), x["norm"].alias("norm"), i.alias("i")))), entities), named)


def rewritten(text: Column, hits: Column, style: str = "placeholder") -> Column:
    """The text with placeholders for spans, or (``remove``) without them and the gaps they leave. Spans must not
    overlap and come in order; what lies between them is joined at once."""
    tag = (lambda h: F.lit("")) if style == "remove" else (lambda h: h["placeholder"])

    def whole(hits: Column, part: Callable[[Column, Column | int], Column]) -> Column:
        def piece(h: Column, i: Column) -> Column:
            last = F.when(i == 0, 0).otherwise(F.get(hits, i - 1)["end"])
            return F.concat(part(last, h["start"] - last), tag(h))

        return F.concat(F.array_join(F.transform(hits, piece), ""), part(F.element_at(hits, -1)["end"], F.length(text)))

    out = let(hits, lambda hs: F.when(F.size(hs) == 0, text).otherwise(slicing(text, lambda part: whole(hs, part))))
    return S.close_gaps(out) if style == "remove" else out


def mapping(hits: Column) -> Column:
    """Entries (placeholder, original): the surface seen first stands for its entity."""
    ordered = F.array_sort(F.transform(hits, lambda h, i: F.struct(h["placeholder"].alias("placeholder"), i.alias("i"))))
    first = let(ordered, lambda xs: F.array_sort(F.transform(F.filter(xs, _first(xs, "placeholder")), lambda x: x["i"])))
    return F.transform(first, lambda i: let(F.get(hits, i), lambda h: F.struct(h["placeholder"].alias("placeholder"), h["surface"].alias("original"))))


def entity_counts(docs: DataFrame, hits: str = "hits", *keys: str) -> DataFrame:
    """(keys, entity_type, n): distinct entities of each type; one row a type, so results compare in any order."""
    flat = docs.select(*keys, F.explode(hits).alias("h")).select(*keys, "h.entity_type", "h.norm").distinct()
    return flat.groupBy(*keys, "entity_type").agg(F.count("*").alias("n"))


def apply_mapping(text: Column, entries: Column, style: str = "placeholder") -> Column:
    """Literal replacement of originals by placeholders, longest first and in one pass; for texts without spans."""
    out = search.replaced(text, entries, style)
    return S.close_gaps(out) if style == "remove" else out


def unredact(text: Column, entries: Column, keep_clear: Column) -> Column:
    """Placeholders of ``keep_clear`` back to their originals."""
    own = F.filter(entries, lambda e: F.array_contains(keep_clear, e["placeholder"]))
    return F.aggregate(own, text, lambda acc, e: F.replace(acc, e["placeholder"], e["original"]))


def strip_placeholders(text: Column, entries: Column) -> Column:
    return S.close_gaps(F.aggregate(entries, text, lambda acc, e: F.replace(acc, e["placeholder"], F.lit(""))))
