"""Spans from outside models: answers are parsed and located; calling a model is a plugin's business, off by default."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.spans import matches, none, span

ITEM = "array<struct<text:string,type:string>>"
# fixed value: names that models give types by, and ours
TYPES = {"PERSON": "PERSON", "NAME": "PERSON", "ORG": "ORG", "ORGANIZATION": "ORG", "COMPANY": "ORG", "LOCATION": "LOCATION", "ADDRESS": "STREET", "STREET": "STREET", "CITY": "CITY", "EMAIL": "EMAIL_ADDRESS", "EMAIL_ADDRESS": "EMAIL_ADDRESS", "PHONE": "PHONE_NUMBER", "PHONE_NUMBER": "PHONE_NUMBER", "IBAN": "IBAN_CODE", "IBAN_CODE": "IBAN_CODE"}
LABELS = {"PERSON": "PERSON", "PER": "PERSON", "ORG": "ORG", "PRODUCT": "ORG", "LOC": "LOCATION", "GPE": "LOCATION", "FAC": "LOCATION", "NORP": "NRP"}


def parse_answer(raw: Column) -> Column:
    """The JSON array of (text, type) in an answer, with or without a code fence and words around; else an empty array."""
    bare = F.regexp_replace(F.coalesce(raw, F.lit("")), r"```(?:json)?", "")
    body = F.regexp_extract(bare, r"(?s)(\[.*\])", 1)
    return F.coalesce(F.filter(F.from_json(body, ITEM), lambda x: F.length(F.trim(x["text"])) > 0), F.array().cast(ITEM))


def _type(name: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in TYPES.items():
        out = F.when(F.upper(name) == k, v).otherwise(out)
    return out


def answer_spans(text: Column, raw: Column, wanted: list[str], score: float = 0.82) -> Column:
    """Every place of each surface of an answer: exact, or in any case where exact finds none. Types not wanted are left out."""

    def places(x: Column) -> Column:
        exact = F.concat(F.lit(r"\Q"), F.trim(x["text"]), F.lit(r"\E"))
        any_case = F.concat(F.lit("(?iu)"), exact)
        pattern = F.when(text.contains(F.trim(x["text"])), exact).otherwise(any_case)
        kind = _type(x["type"])
        return F.when(kind.isin(*wanted), F.transform(matches(text, pattern), lambda m: span(kind, m["start"], m["start"] + F.length(m["surface"]), score, m["surface"]))).otherwise(none())

    return F.array_distinct(F.flatten(F.transform(parse_answer(raw), places)))


def model_spans(entities: Column, text: Column, score: float = 0.75) -> Column:
    """Spans from a named-entity model's output, an array of (label, start, end): labels mapped, cut at the first line end."""
    label = F.lit(None).cast("string")

    def one(x: Column) -> Column:
        out = label
        for k, v in LABELS.items():
            out = F.when(x["label"] == k, v).otherwise(out)
        surface = F.regexp_extract(F.substring(text, x["start"] + 1, x["end"] - x["start"]), r"^[^\r\n]*", 0)
        return span(out, x["start"], x["start"] + F.length(surface), score, surface)

    return F.filter(F.transform(entities, one), lambda x: x["entity_type"].isNotNull() & (F.trim(x["surface"]) != ""))
