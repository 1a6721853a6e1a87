"""Filters of spans: labels, noise, false positives, allowed surfaces. Column expressions over one document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.spans import before, let, sliced_spans
from ..lexicon import FEE_TAIL, TITLE_TAILS, Lexicon
from .recognizers import LEGAL_WORD

#: A function (start, size) that gives a part of the text.
Part = Callable[[Column, "Column | int"], Column]
LABEL_TAIL = r"(?iu)(numero|tunniste|tunnus|osoite|koodi|kenttä|field|label|code)$"  # fixed value
LEASE_WORDS = r"(?iu)\b(leasingkohde|sopimusehdot|peruutusehdot|yleiset\s+ehdot|yleiset\s+sopimusehdot|vastuunrajoitus|salassapito)\b"  # fixed value
LONG_FEE = r"(?iu)(veloitus|maksu|palkkio|raja|kilometri|omavastuu|vakuutus)"  # fixed value


def field_label(part: Part, x: Column) -> Column:
    """A form label such as ``Rekisterinumero/tunniste:``; looks 24 characters ahead."""
    s = F.trim(x["surface"])
    rest = part(x["end"], 24)
    separated = rest.rlike(r"^\s*[/：:]") | s.endswith(":")
    tail = s.rlike(LABEL_TAIL)
    slash = s.contains("/") & F.trim(F.element_at(F.split(s, "/"), -1)).rlike(LABEL_TAIL)
    label = slash | (tail & (separated | rest.rlike(r"^\s*(\n|$)"))) | (separated & ~s.rlike(r"\s"))
    return x["entity_type"].isin("LOCATION", "STREET", "CITY", "ORG", "PERSON") & (s != "") & (F.length(s) <= 80) & ~s.rlike(LEGAL_WORD) & label


def drop_field_labels(text: Column, spans: Column) -> Column:
    return sliced_spans(text, spans, lambda xs, part: F.filter(xs, lambda x: ~field_label(part, x)))


def drop_noisy(text: Column, spans: Column) -> Column:
    """Without spans out of range, across lines or blank."""
    return F.filter(spans, lambda x: (x["end"] > x["start"]) & (x["start"] >= 0) & (x["end"] <= F.length(text)) & ~x["surface"].rlike(r"[\n\r]") & (F.trim(x["surface"]) != ""))


def _among(x: Column, words) -> Column:
    return x.isin(*sorted(words))


def tokens(surface: Column) -> Column:
    return F.filter(F.split(F.trim(surface), r"\s+"), lambda t: F.regexp_replace(t, r"[.,;:'\"]", "") != "")


def all_noise(toks: Column, lexicon: Lexicon = Lexicon()) -> Column:
    """Every token is a role, a legal or form word, a title tail or a joiner; so is an empty list."""
    return F.forall(toks, lambda t: (S.token_norm(t) == "") | _among(S.token_norm(t), lexicon.noise))


def near_boilerplate(part: Part, x: Column, lexicon: Lexicon = Lexicon(), size: int = 64) -> Column:
    """A section sign or a cue word within 64 characters on either side."""
    around = F.concat(before(part, x["start"], size), F.lit(" "), part(x["end"], size))
    words = F.transform(F.split(S.fold(around), r"[^\p{L}\p{N}_\-]+"), lambda t: F.regexp_replace(t, "^-+|-+$", ""))
    return around.contains("§") | F.arrays_overlap(words, F.array(*[F.lit(c) for c in sorted(lexicon.boilerplate_cues)]))


def caps_header(surface: Column) -> Column:
    s = F.trim(surface)
    toks = F.split(s, r"\s+")
    letters = F.length(F.regexp_replace(s, r"[^\p{L}]", ""))
    low = F.transform(toks, lambda t: S.fold(F.regexp_replace(t, r"^[.,;:\-]+|[.,;:\-]+$", "")))
    kind = (F.size(toks) >= 3) | F.exists(low, lambda t: _among(t, {"ja", "and", "of", "tai", "se", "the", "for", "to"} | TITLE_TAILS))
    return ~s.rlike(LEGAL_WORD) & (F.size(toks) >= 2) & (letters >= 6) & (F.length(F.regexp_replace(s, r"[^\p{Lu}]", "")) >= letters * 0.9) & kind


def false_location(surface: Column) -> Column:
    s = F.trim(surface)
    return (s == "") | s.rlike(FEE_TAIL) | ((F.length(s) > 18) & ~s.rlike("[ -]") & s.rlike(r"^\p{Lu}") & s.rlike(LONG_FEE))


def false_positive(part: Part, x: Column, lexicon: Lexicon = Lexicon()) -> Column:
    """Roles, legal phrases, headers and form words taken for an organisation, a person or a place."""
    s = x["surface"]
    return let(F.struct(S.surface_norm(s).alias("norm"), tokens(s).alias("toks")), lambda v: _false_positive(part, x, v["norm"], v["toks"], lexicon))


def _false_positive(part: Part, x: Column, norm: Column, toks: Column, lexicon: Lexicon) -> Column:
    s = x["surface"]
    listed = _among(norm, lexicon.roles | lexicon.legal_phrases)
    one, noise = F.size(toks) == 1, all_noise(toks, lexicon)
    only = F.coalesce(F.get(toks, 0), F.lit(""))
    weak = (F.length(S.surface_norm(only)) < 4) | _among(S.surface_norm(only), lexicon.weak)
    bare = (F.size(toks) >= 2) & noise | one & (only.rlike(FEE_TAIL) | weak & (F.length(only) <= 24)) | noise & near_boilerplate(part, x, lexicon) | s.rlike(LEASE_WORDS)
    org = listed | caps_header(s) | ~s.rlike(LEGAL_WORD) & bare
    label = one & _among(S.fold(only), lexicon.legalish_tokens | lexicon.formish_tokens | lexicon.doc_title_tails)
    person = listed | (F.size(toks) >= 2) & noise | (s == S.fold(s)) | label | (F.size(toks) <= 3) & noise & near_boilerplate(part, x, lexicon)
    return F.when(x["entity_type"] == "ORG", org).when(x["entity_type"] == "PERSON", person).when(x["entity_type"].isin("LOCATION", "CITY"), false_location(s)).otherwise(F.lit(False))


def drop_false_positives(text: Column, spans: Column, lexicon: Lexicon = Lexicon()) -> Column:
    return sliced_spans(text, spans, lambda xs, part: F.filter(xs, lambda x: ~false_positive(part, x, lexicon)))


def drop_allowed(spans: Column, allow: list[str]) -> Column:
    """Without spans whose normal form is on the list."""
    forms = sorted({" ".join(a.split()).casefold() for a in allow if a and a.strip()})
    return F.filter(spans, lambda x: ~_among(S.entity_norm(x["surface"]), forms)) if forms else spans
