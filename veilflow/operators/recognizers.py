"""Detectors: text column -> array of spans. All are column expressions; patterns are Java regular expressions."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType

from ..functions import scalar as S
from ..functions.spans import SPANS, before, let, longest, matches, merge, none, pattern_spans, sliced_spans, slicing, span
from ..lexicon import BRAND_JOINERS, COMPANY_ROLES, FORMISH, LEGALISH, TITLE_TAILS, Lexicon
from . import search

# --- fixed values: shapes of identifiers ----------------------------------------------------------
A = "A-Za-zÅÄÖåäö"
UP = "A-ZÅÄÖ"
HETU = r"(?i)\b[0-9]{6}[-+A-FU-Y][0-9]{3}[0-9A-Y]\b"
BUSINESS_ID = r"\b[0-9]{7}-[0-9]\b"
VAT = r"(?i)(?<![A-Za-z0-9])FI[\s\-]?[0-9]{8}(?![A-Za-z0-9])"
PLATE = r"(?i)(?<![A-Za-z0-9])[A-Z]{2,3}-[0-9]{1,3}(?![A-Za-z0-9])"
PLATE_CLOSED = r"(?i)(?<![A-Za-z0-9])[A-Z]{3}[0-9]{1,3}(?![A-Za-z0-9])"
POSTAL = r"(?m)(?:(?<=[\s ])|(?<=:)|^)[0-9]{5}(?=[\s, ]|\.(?![0-9])|$)"
NOT_POSTAL = r"(?iu)(kilometri|k\s*/\s*m|käyttöaika|mittari|raja|tunnit|km\b)"
SEP = r"[\s\-./ ]"
AREA = r"(?:4[0-9]|50|9|2|3|5|6|8|13|14|15|16|17|18|19)"
SERVICE = r"(?:10|20|29|30|39|60|70|75)"
PHONES = (
    r"(?<!\w)(?:\+358|00358)[\s\-./]*\(?\s*0?\s*\)?[\s\-./]*[0-9](?:[\s\-./()]*[0-9]){6,12}(?![0-9])",
    rf"(?<![0-9])\(\s*0{AREA}\s*\)(?:{SEP}+[0-9]{{2,4}}){{1,4}}(?![0-9])",
    rf"(?<![0-9])\(\s*0{AREA}\s*\)[0-9]{{6,8}}(?![0-9])",
    rf"(?<![0-9])\(\s*0{SERVICE}\s*\)(?:{SEP}+[0-9]{{2,4}}){{1,4}}(?![0-9])",
    rf"(?<![0-9])0{AREA}(?:[\s\-./]+[0-9]{{2,4}}){{1,4}}(?![0-9])",
    r"(?<![0-9])(?:040|041|042|043|044|045|046|049|050)[0-9]{6,7}(?![0-9])",
    r"(?<![0-9])09[0-9]{7,8}(?![0-9])",
    r"(?<![0-9])0(?:10|20|29|30|39|60|70|75|800|900)[0-9]{5,8}(?![0-9])",
    rf"(?<![0-9])0{SERVICE}(?:{SEP}+[0-9]{{2,4}}){{1,4}}(?![0-9])",
)
PHONE_LABEL = r"(?iu)(?:puhelinnumero|puhelin|phone|tel\.?|puh\.?)\s*[:：]?\s*"
PHONE_AFTER = r"(?:\+?358[\s\-./ ()]*[0-9](?:[\s\-./ ()]*[0-9]){6,12}|0?[0-9](?:[\s\-./ ()]*[0-9]){6,12})"
URL = r"(?iu)(?<![\p{L}\p{N}_@])(?:(?:https?|ftp)://[^\s<>\"')\]]+|www\.[^\s<>\"')\]]+|[a-z0-9][a-z0-9\-]*\.[a-z0-9][a-z0-9\-]*\.[a-z]{2,24}(?:/[^\s<>\"')\]]*)?)"
VIN = r"(?i)\b[A-HJ-NPR-Z0-9]{17}\b"
VIN_LABEL = r"(valmistenumer|vin|chassis|runkonumer)"
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+\-]*@[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,24}"
IPV4 = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])"
IPV6 = r"(?i)(?<![0-9a-f:])(?:(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}|(?:[0-9a-f]{1,4}:){1,6}(?::[0-9a-f]{1,4}){1,5})(?![0-9a-f:])"
#: Twelve to nineteen digits at a stretch, else in groups, none of them so long: a number beside a card is no part of it.
CARD = r"(?<![0-9])(?:[0-9]{12,19}|(?:(?![0-9]{12})[0-9][ \-]?){11,18}[0-9])(?![0-9])"
IBAN = r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"
INTL_PHONE = r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[\s\-.]?)?(?:\([0-9]{1,4}\)[\s\-.]?)?[0-9]{2,4}(?:[\s\-.][0-9]{2,4}){1,4}(?![0-9])|(?<![0-9A-Za-z])\+[0-9]{10,15}(?![0-9])"
LEGAL = r"(?iu:Oyj|Oy\s+Ab|Oy|Abp|Ab|Ky|Avoin\s+yhtiö|Ltd\.?|Limited|Inc\.?|Incorporated|Corp\.?|Corporation|LLC|LLP|plc|GmbH|AG|SA|SAS|BV|NV|Co\.|Company|Group|Holdings?)"
NAME = rf"[{UP}][{A}0-9&'’\-]*"
COMPANY = rf"(?<![{A}0-9]){NAME}(?:[ \t]+(?:&|{NAME})){{0,5}}[ \t]+{LEGAL}(?![{A}0-9])"
LEGAL_END = r"(?iu)\b(oyj|oy\s+ab|oy|abp|ab|ky|ltd\.?|limited|inc\.?|incorporated|corp\.?|corporation|llc|llp|plc|gmbh|ag|sa|sas|bv|nv|co\.|company|group|holdings?)\s*$"
LEGAL_WORD = r"(?iu)\b(oyj|oy|abp|ab|ky|ltd|limited|inc|corp|llc|llp|plc|gmbh)\b"
MULTI = rf"(?<![{A}0-9]){NAME}(?:[ \t]+{NAME}){{1,3}}(?![{A}0-9])"
CLOSING = r"(?i)^(?:(?:best|kind|warm)\s+regards|yours\s+(?:sincerely|faithfully))$"
LAST_FIRST = rf"(?<![{A}])[{UP}][a-zåäö{UP}\-']{{1,40}},\s*[{UP}][a-zåäö{UP}\-']{{1,40}}(?![{A}])"
NAME_LABEL = r"(?:^|[\n:])\s*(?iu:nimi|name|yhteyshenkilö|contact\s*person|business\s*contact)\s*:\s*"
NOT_LAST = ("intent", "understanding", "agreement", "section", "article", "schedule", "appendix", "force", "green")
NOT_FIRST = ("intent", "understanding", "majeure", "card")
FI_ENDINGS = "lle|lta|ltä|ssa|ssä|sta|stä|lla|llä|ksi|na|nä|tta|ttä|in|aan|ään|een|iin|oon|öön|uun|yyn|n|a|ä|t"
#: Characters between a street and its postcode at most, and streets and postcodes that lie within them: streets
#: take six characters or more, postcodes with a city nine, and neither overlap their own kind.
REACH, NEAR = 160, 160 // 6 + 160 // 9 + 4
SUFFIX = "(?:katu|tie|kuja|polku|väylä|raitti|tori|aukio|puistikko|ranta|mäki|rinne|bulevardi|esplanadi|puisto|kaari|penger|silta|laituri|kallio|niemi|saari|kylä|kierto)"
HOUSE = r"\s+[0-9]{1,4}(?:[A-Za-z]|-[0-9]{1,4})?(?:\s+[A-Za-z])?(?:\s+[0-9]{1,3})?"
CITY = rf"[{UP}][{A}\-]{{1,40}}"
WORD_CHARS = r"[\p{L}\p{N}_\-]*"
STREET = rf"[{UP}]{WORD_CHARS}{SUFFIX}(?:\s+[{UP}]{WORD_CHARS})?"
H = r"[ \t    ]"
GAP = rf"(?:{H}+|{H}*\n{H}*)"
POSTAL_CITY = rf"(?m)(?:(?<=[\s ])|(?<=:)|^)[0-9]{{5}}{GAP}{CITY}(?![{A}0-9])"
FI_FULL = rf"(?<![{A}0-9]){STREET}{HOUSE}\s*,\s*[0-9]{{5}}{GAP}{CITY}(?![{A}0-9])"
FI_LOOSE = rf"(?<![{A}0-9])[{UP}][{A}\-]{{2,40}}(?:[ \t]+[{UP}][{A}\-]{{2,40}}){{0,2}}{HOUSE}\s*,\s*[0-9]{{5}}{GAP}{CITY}(?![{A}0-9])"
EN_KIND = r"(?:Street|St\.?|Road|Rd\.?|Avenue|Ave\.?|Lane|Ln\.?|Boulevard|Blvd\.?|Drive|Dr\.?|Way|Court|Ct\.?|Place|Pl\.?)"
EN_NAME = r"[A-Z][a-z]+(?:[ \t]+[A-Z][a-z]+){0,3}[ \t]+" + EN_KIND
EN_FULL = rf"(?<![A-Za-z0-9])[0-9]{{1,5}}[A-Za-z]?[ \t]+{EN_NAME}[ \t]*,[ \t]*[A-Z][A-Za-z\-]+(?:[ \t]+[A-Z][A-Za-z\-]+){{0,2}}(?![A-Za-z0-9])"
STREETS_ALONE = (
    rf"(?<![\p{{L}}\p{{N}}_]){STREET}(?:{HOUSE})?(?![\p{{L}}\p{{N}}_])",
    rf"(?iu)(?<![\p{{L}}\p{{N}}_])[{UP}]{WORD_CHARS}(?:\s+[{UP}]{WORD_CHARS}){{0,2}}\s+(?:katu|tie|kuja|polku|väylä|raitti|tori|aukio|kierto)(?:{HOUSE})?(?![\p{{L}}\p{{N}}_])",
    rf"(?<![\p{{L}}\p{{N}}_])[A-Z][a-z]+(?:\s+[A-Z][a-z]+){{0,3}}\s+{EN_KIND}(?:\s+[0-9]{{1,5}}[A-Za-z]?)?(?![\p{{L}}\p{{N}}_])",
)
STREET_HOUSE = rf"(?<![{A}0-9]){STREET}{HOUSE}(?![{A}0-9])"
# ---------------------------------------------------------------------------------------------------


def hetu(text: Column) -> Column:
    return pattern_spans(text, HETU, "FI_HETU", 0.95, S.valid_hetu, guard=text.rlike("[0-9]{6}[-+A-Za-z]"))


def business_id(text: Column) -> Column:
    return pattern_spans(text, BUSINESS_ID, "FI_BUSINESS_ID", 0.90, lambda s: S.valid_business_id(F.substring(s, 1, 7), F.substring(s, 9, 1)), guard=text.rlike("[0-9]{7}-[0-9]"))


def vat(text: Column) -> Column:
    return pattern_spans(text, VAT, "FI_VAT", 0.95, lambda s: S.valid_vat(S.digits(s)), guard=text.rlike("[0-9]{8}"))


def plate(text: Column) -> Column:
    """Hyphenated plates, and closed ones that no hyphenated one holds."""
    ok = lambda s: S.plausible_plate(F.regexp_replace(s, "[^A-Za-z]", ""))
    open_ = pattern_spans(text, PLATE, "FI_LICENSE_PLATE", 0.95, ok)
    closed = pattern_spans(text, PLATE_CLOSED, "FI_LICENSE_PLATE", 0.95, ok)
    free = F.filter(closed, lambda c: ~F.exists(open_, lambda o: (o["start"] <= c["start"]) & (c["end"] <= o["end"])))
    return F.when(text.rlike("(?i)[A-Z]{2}-?[0-9]"), F.concat(open_, free)).otherwise(none())


def postal(text: Column) -> Column:
    found = pattern_spans(text, POSTAL, "FI_POSTAL_CODE", 0.90, S.plausible_postal, guard=text.rlike("[0-9]{5}"))
    return sliced_spans(text, found, lambda xs, part: F.filter(xs, lambda x: ~before(part, x["start"], 48).rlike(NOT_POSTAL)))


def phone(text: Column) -> Column:
    """Finnish numbers in nine shapes, and broader runs of digits after a label; the longer of overlapping ones."""
    plain = F.translate(text, "   ", "   ")
    guard = text.rlike("[0-9].*[0-9]|[0-9]\\s")
    shapes = F.filter(F.concat(*[matches(plain, p, guard) for p in PHONES]), lambda m: S.plausible_phone(m["surface"]))
    found = F.transform(shapes, lambda m: span("PHONE_NUMBER", m["start"], m["start"] + F.length(m["surface"]), 0.90, m["surface"]))
    labelled = pattern_spans(plain, PHONE_LABEL + PHONE_AFTER + "(?![0-9])", "PHONE_NUMBER", 0.90, lambda s: S.plausible_phone(s, True), part=f"^({PHONE_LABEL})({PHONE_AFTER})$", guard=guard)
    own = longest(F.concat(found, labelled))
    return sliced_spans(text, own, lambda xs, part: F.transform(xs, lambda x: span("PHONE_NUMBER", x["start"], x["end"], x["score"], part(x["start"], x["end"] - x["start"]))))


def url(text: Column) -> Column:
    trimmed = F.transform(matches(text, URL, text.rlike(r"(?i)://|[a-z0-9\-]\.[a-z0-9]")), lambda m: F.struct(m["start"].alias("start"), F.regexp_replace(m["surface"], r"[.,;:!?)\]}'\"]+$", "").alias("surface")))
    kept = F.filter(trimmed, lambda m: (F.length(m["surface"]) >= 5) & ~(m["surface"].contains("@") & ~m["surface"].contains("://") & ~F.lower(m["surface"]).startswith("www.")))
    return F.transform(kept, lambda m: span("URL", m["start"], m["start"] + F.length(m["surface"]), 0.90, m["surface"]))


def vin(text: Column) -> Column:
    found = pattern_spans(text, VIN, "VEHICLE_VIN", lambda s: F.when(S.vin_check(s), 0.95).otherwise(0.85), S.vin_like, guard=text.rlike("[A-Za-z0-9]{17}"))

    def near_label(x: Column, part) -> Column:
        label = F.lower(before(part, x["start"], 48)).rlike(VIN_LABEL)
        return span("VEHICLE_VIN", x["start"], x["end"], F.when(label, F.least(F.lit(0.98), x["score"] + 0.05)).otherwise(x["score"]), x["surface"])

    return sliced_spans(text, found, lambda xs, part: F.transform(xs, lambda x: near_label(x, part)))


def email(text: Column) -> Column:
    return pattern_spans(text, EMAIL, "EMAIL_ADDRESS", 1.0, guard=text.contains("@"))


def ip_address(text: Column) -> Column:
    four = pattern_spans(text, IPV4, "IP_ADDRESS", 0.6, guard=text.rlike(r"[0-9]\.[0-9]+\.[0-9]"))
    return F.concat(four, pattern_spans(text, IPV6, "IP_ADDRESS", 0.6, guard=text.rlike("(?i)[0-9a-f]:[0-9a-f:]")))


def credit_card(text: Column) -> Column:
    return pattern_spans(text, CARD, "CREDIT_CARD", 1.0, S.valid_card, guard=text.rlike("[0-9](?:[ \\-]?[0-9]){11}"))


def iban(text: Column) -> Column:
    return pattern_spans(text, IBAN, "IBAN_CODE", 1.0, S.valid_iban, guard=text.rlike("[A-Z]{2}[0-9]{2}"))


def intl_phone(text: Column) -> Column:
    return pattern_spans(text, INTL_PHONE, "PHONE_NUMBER", 0.4, S.plausible_intl_phone, guard=text.rlike("[0-9]{2}[\\s\\-.)]|\\+[0-9]"))


def company(text: Column) -> Column:
    """Names that end in a legal form; one role word before the name is no part of it."""
    role = "^(?iu:" + "|".join(sorted(COMPANY_ROLES, key=lambda r: (-len(r), r))) + r")\s+"

    def strip(x: Column) -> Column:
        cut = F.length(F.regexp_extract(x["surface"], role, 0))
        return span("ORG", x["start"] + cut, x["end"], 0.90, F.substring(x["surface"], cut + 1, F.length(x["surface"])))

    found = F.transform(pattern_spans(text, COMPANY, "ORG", 0.90, guard=text.rlike(LEGAL)), strip)
    return F.filter(found, lambda x: (F.length(F.trim(x["surface"])) >= 4) & F.trim(x["surface"]).rlike(r"\s"))


def _among(x: Column, words) -> Column:
    return x.isin(*sorted(words))


def valid_brand(phrase: Column) -> Column:
    """A brand by its shape: none of the closings, licence tags, headers, titles and collocations that look like one."""
    return let(F.regexp_replace(F.trim(phrase), r"[ \t]+", " "), lambda p: let(F.split(p, " "), lambda tokens: _valid_brand(p, tokens)))


def _valid_brand(p: Column, tokens: Column) -> Column:
    low = F.transform(tokens, lambda t: S.fold(F.regexp_replace(t, r"^[.,;:'\"]+|[.,;:'\"]+$", "")))
    letters = F.regexp_replace(p, r"[^\p{L}]", "")
    upper = F.regexp_replace(p, r"[^\p{Lu}]", "")
    is_upper = (p == F.upper(p)) & (F.length(letters) > 0)
    caps = (F.length(upper) >= F.length(letters) * 0.9) & (F.length(letters) > 0) & ~p.rlike(r"(?iu)\b(oyj|oy|ab|ltd|limited|inc|corp|llc|gmbh|plc)\b")
    legalish = LEGALISH | {"maine"}
    header = caps & ((F.size(tokens) >= 3) | F.exists(low, lambda t: _among(t, {"ja", "and", "of", "tai", "se", "the", "for", "to"} | legalish)))
    bad = (
        (F.length(p) < 4)
        | p.rlike(r"[\n\r«»<>{}\[\]|–—]")
        | p.rlike(CLOSING)
        | (F.size(tokens) < 2)
        | F.exists(low, lambda t: F.length(t) <= 1)
        | p.rlike(r"(?i)^CC(?:\s+BY(?:-[A-Z]+)*)+$")
        | (is_upper & F.forall(tokens, lambda t: F.length(t) <= 3))
        | header
        | S.fold(p).isin("force majeure", "green card", "green cardiin", "letter of intent", "memorandum of understanding")
        | F.forall(low, lambda t: _among(t, legalish | FORMISH | BRAND_JOINERS))
        | _among(F.element_at(low, -1), TITLE_TAILS)
    )
    return ~bad


def brand(text: Column, lexicon: Lexicon = Lexicon()) -> Column:
    """Two to four capitalised words that no rule of ``valid_brand`` excludes, role words before them left out."""
    prefixes = lexicon.org_role_prefixes
    shape = r"^\S+[ \t]+"

    def strip(x: Column) -> Column:
        def less(y: Column) -> Column:
            out = y["surface"]
            role = (F.size(F.split(out, r"[ \t]+")) >= 3) & _among(S.fold(F.regexp_extract(out, r"^\S+", 0)), prefixes)
            cut = F.when(role, F.length(F.regexp_extract(out, shape, 0))).otherwise(0)
            return let(cut, lambda c: F.struct((y["start"] + c).cast("int").alias("start"), F.substring(out, c + 1, F.length(out)).alias("surface")))

        # up to four words, two of which stay
        return let(less(let(x, less)), lambda y: span("ORG", y["start"], y["start"] + F.length(y["surface"]), F.when(y["surface"] == F.upper(y["surface"]), 0.78).otherwise(0.72), y["surface"]))

    found = F.transform(matches(text, MULTI), strip)
    return longest(F.filter(found, lambda x: valid_brand(x["surface"])))


def person(text: Column) -> Column:
    """``Last, First`` pairs, and what follows a name label on its line (a pair in it, else the whole)."""

    def pair_ok(s: Column) -> Column:
        last, first = F.regexp_extract(s, r"^([^,]*)", 1), F.regexp_extract(s, r",\s*(.*)$", 1)
        short = lambda w: (w == F.upper(w)) & (F.length(w) <= 4)
        return ~short(first) & ~short(last) & ~S.fold(last).isin(*NOT_LAST) & ~S.fold(first).isin(*NOT_FIRST) & ~s.rlike(r"(?iu)\b(oy|oyj|ab|ltd|inc)\b")

    pairs = pattern_spans(text, LAST_FIRST, "PERSON", 0.88, pair_ok, guard=text.contains(","))
    value = rf"(?iu:[{UP}])[^\n]{{2,60}}"  # a label's value may be in small letters
    lines = pattern_spans(text, "(?m)" + NAME_LABEL + value, "PERSON", 0.88, part=f"(?m)^({NAME_LABEL})({value})$", guard=text.rlike(r"(?iu)(nimi|name|yhteyshenkilö|contact)\s*(person)?\s*:"))

    def inside(x: Column) -> Column:
        s = F.regexp_replace(F.regexp_replace(x["surface"], r"(?U)\s+$", ""), r"[.,;]+$", "")
        inner = F.regexp_extract(s, LAST_FIRST, 0)
        at = x["start"] + F.instr(s, inner) - 1
        return F.when(inner != "", span("PERSON", at, at + F.length(inner), 0.88, inner)).otherwise(span("PERSON", x["start"], x["start"] + F.length(s), 0.88, s))

    labelled = F.filter(F.transform(lines, inside), lambda x: (F.length(x["surface"]) >= 3) & (x["surface"].rlike(LAST_FIRST) | ~x["surface"].rlike(r"(?iu)\b(oy|oyj|ab|ltd)\b")))
    return F.array_distinct(F.concat(pairs, labelled))


def _scored(found: Column, score: float) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["surface"].alias("surface"), F.lit(score).alias("score")))


def _place(m: Column, score: Column | float) -> Column:
    """Postcode and city spans of a match that ends in ``12345 City``; a city that is none leaves the postcode at nine tenths."""
    tail = F.regexp_extract(m["surface"], rf"[0-9]{{5}}{GAP}{CITY}$", 0)
    at = m["start"] + F.length(m["surface"]) - F.length(tail)
    city = F.regexp_extract(tail, rf"({CITY})$", 1)
    city_at = m["start"] + F.length(m["surface"]) - F.length(city)
    ok, score = S.plausible_city(city), F.lit(score)
    code = span("FI_POSTAL_CODE", at, at + 5, F.when(ok, score).otherwise(score * 0.9), F.substring(tail, 1, 5))
    return F.when(ok, F.array(code, span("CITY", city_at, city_at + F.length(city), score, city))).otherwise(F.array(code))


def address(text: Column) -> Column:
    """Streets, postcodes and cities: whole addresses on a line, a street and the postcode that follows
    within 160 characters, postcodes with a city, streets alone; overlaps resolved by score."""
    five, house, kind = text.rlike("[0-9]{5}"), text.rlike(SUFFIX + "|" + SUFFIX.replace("(?:", "(?i:", 1)), text.rlike(r"[a-z][ \t\n]+" + EN_KIND)
    head = rf"(?s)^(.*?{HOUSE})\s*,\s*[0-9]{{5}}{GAP}{CITY}$"

    def whole(m: Column) -> Column:
        street = F.regexp_extract(m["surface"], head, 1)
        return F.concat(F.array(span("STREET", m["start"], m["start"] + F.length(street), m["score"], street)), _place(m, m["score"]))

    scored = [_scored(matches(text, pattern, five), score) for pattern, score in ((FI_FULL, 0.96), (FI_LOOSE, 0.94))]
    out = [F.flatten(F.transform(F.concat(*scored), whole))]

    def english(m: Column) -> Column:
        street = F.regexp_extract(m["surface"], rf"^([0-9]{{1,5}}[A-Za-z]?[ \t]+{EN_NAME})[ \t]*,", 1)
        city = F.regexp_extract(m["surface"], r",[ \t]*([^,]*)$", 1)
        end = m["start"] + F.length(m["surface"])
        return F.array(span("STREET", m["start"], m["start"] + F.length(street), 0.93, street), span("CITY", end - F.length(city), end, 0.93, city))

    out.append(F.flatten(F.transform(matches(text, EN_FULL, kind), english)))
    cities = matches(text, POSTAL_CITY, five)
    streets = matches(text, STREET_HOUSE, house & five)

    def claims(p: Column, near: Column, part) -> Column:
        """The first street that this postcode is the next one of, among what ends or begins before it."""

        def open_gap(s: Column) -> Column:
            gap = part(s["at"], p["at"] - s["at"])
            return s["surface"].isNotNull() & (p["at"] > s["at"]) & (p["at"] - s["at"] <= REACH) & ~gap.rlike(r"(?<![0-9])[0-9]{5}(?![0-9])|@|://")

        def both(own: Column) -> Column:
            found = F.concat(F.array(span("STREET", own["at"] - F.length(own["surface"]), own["at"], 0.96, own["surface"])), _place(p["place"], 0.96))
            return F.when(own.isNotNull(), found).otherwise(none())

        return let(F.get(F.filter(near, open_gap), 0), both)

    def paired(events: Column, part) -> Column:
        """Ends of streets and starts of postcodes in one order: each postcode looks back over NEAR of them at most."""
        back = lambda j: F.slice(events, F.greatest(j - NEAR, F.lit(0)) + 1, F.least(j, F.lit(NEAR)))
        own = F.transform(events, lambda p, j: F.when(p["place"].isNotNull(), F.concat(claims(p, back(j), part), _place(p["place"], 0.91))).otherwise(none()))
        return F.flatten(own)

    place = "struct<start:int,surface:string>"
    ends = F.transform(streets, lambda m: F.struct((m["start"] + F.length(m["surface"])).alias("at"), m["surface"].alias("surface"), F.lit(None).cast(place).alias("place")))
    begins = F.transform(cities, lambda m: F.struct(m["start"].alias("at"), F.lit(None).cast("string").alias("surface"), m.cast(place).alias("place")))
    out.append(F.when(F.size(cities) > 0, let(F.array_sort(F.concat(ends, begins)), lambda events: slicing(text, lambda part: paired(events, part)))).otherwise(none()))
    alone = F.concat(*[matches(text, pattern, guard) for pattern, guard in zip(STREETS_ALONE, (house, house, kind))])
    alone = F.filter(alone, lambda m: (F.length(F.trim(m["surface"])) >= 5) & ~S.fold(F.trim(m["surface"])).isin("katu", "tie", "street", "road", "kierto"))
    out.append(F.transform(alone, lambda m: span("STREET", m["start"], m["start"] + F.length(m["surface"]), 0.85, m["surface"])))
    priority = lambda t: F.when(t == "LOCATION", 1).otherwise(3)
    return merge(F.concat(*out), priority, typed_only=True)


@dataclass(frozen=True)
class Recognizer:
    name: str
    types: tuple[str, ...]
    spans: Callable[[Column], Column]
    from_patterns: bool = False  # subject to the score threshold


BUILTIN = (
    Recognizer("hetu", ("FI_HETU",), hetu),
    Recognizer("business_id", ("FI_BUSINESS_ID",), business_id),
    Recognizer("vat", ("FI_VAT",), vat),
    Recognizer("plate", ("FI_LICENSE_PLATE",), plate),
    Recognizer("postal", ("FI_POSTAL_CODE",), postal),
    Recognizer("phone", ("PHONE_NUMBER",), phone),
    Recognizer("url", ("URL",), url),
    Recognizer("vin", ("VEHICLE_VIN",), vin),
    Recognizer("address", ("STREET", "CITY", "FI_POSTAL_CODE"), address),
    Recognizer("company", ("ORG",), company),
    Recognizer("brand", ("ORG",), brand),
    Recognizer("person", ("PERSON",), person),
    Recognizer("email", ("EMAIL_ADDRESS",), email, True),
    Recognizer("intl_phone", ("PHONE_NUMBER",), intl_phone, True),
    Recognizer("iban", ("IBAN_CODE",), iban, True),
    Recognizer("credit_card", ("CREDIT_CARD",), credit_card, True),
    Recognizer("ip_address", ("IP_ADDRESS",), ip_address, True),
)


def rule_recognizer(name: str, entity: str, patterns: list[tuple[str, float]]) -> Recognizer:
    """A recognizer from rules, (pattern, score) each; a score outside (0, 1] counts as 0.85. Groups must not capture."""
    own = [(p, s if 0 < s <= 1 else 0.85) for p, s in patterns]
    empty = lambda s: F.length(s) > 0
    return Recognizer(name, (entity,), lambda text: F.concat(*[pattern_spans(text, p, entity, s, empty) for p, s in own]))


def row_recognizer(name: str, entity: str, find: Callable) -> Recognizer:
    """A recognizer from a Python function of one text that returns (start, end, score) tuples, run over Arrow
    batches. Spans out of a text's range are left out; a null text has none."""
    from pyspark import cloudpickle

    code = cloudpickle.dumps(find)  # by value: executors need not have the module

    def run(texts: pa.Array) -> pa.Array:
        own = cloudpickle.loads(code)
        found = []
        for t in texts.to_pylist():
            spans = [(int(a), int(b), float(s)) for a, b, s in own(t)] if t is not None else []
            found.append([{"entity_type": entity, "start": a, "end": b, "score": s, "surface": t[a:b]} for a, b, s in spans if 0 <= a < b <= len(t)])
        kind = pa.struct([("entity_type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("surface", pa.string())])
        return pa.array(found, pa.list_(kind))

    return Recognizer(name, (entity,), F.arrow_udf(run, SPANS, ArrowUDFType.SCALAR))


def deny_spans(text: Column, deny: list[tuple[str, str]]) -> Column:
    """Every occurrence of listed surfaces, in any case, scored 1.0: (surface, type) each, all by one pass."""
    return search.listed(text, deny) if any(s.strip() for s, _ in deny) else none()


#: The case endings above, and letters and digits that part no word.
_ENDINGS, _WORD = frozenset(FI_ENDINGS.split("|")), frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyzÅÄÖåäö0123456789")


def _stem_places(text: str, stems: list[str]) -> list[tuple[int, int]]:
    """(start, end) of the places where a stem begins a word that ends with it or with a case ending, by stem. A
    hyphen may also be a space or left out; places of one stem don't overlap."""
    forms, owner = [], []
    for k, s in enumerate(stems):
        for form in functools.reduce(lambda heads, tail: [h + d + tail for h in heads for d in ("-", " ", "")], s.split("-")[1:], s.split("-")[:1]) if s.count("-") <= 4 else [s]:
            forms.append(form)
            owner.append(k)
    found = []
    for form, start, end in search.Automaton(forms).find(text):
        if not start or text[start - 1] not in _WORD:
            rest = end
            while rest < len(text) and text[rest] in _WORD and rest - end < 4:
                rest += 1
            if rest == end or rest - end < 4 and text[end:rest].lower() in _ENDINGS:
                found.append((owner[form], start, rest))
    out, last = [], {}
    for k, start, end in sorted(found):
        if start >= last.get(k, 0):
            last[k] = end
            out.append((start, end))
    return list(dict.fromkeys(out))


def _stem_spans(texts: pa.Array, lists: pa.Array) -> pa.Array:
    kind = pa.struct([("entity_type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("surface", pa.string())])
    return pa.array([[{"entity_type": "ORG", "start": a, "end": b, "score": 0.87, "surface": t[a:b]} for a, b in _stem_places(t, own)] if t and own else [] for t, own in zip(texts.to_pylist(), lists.to_pylist())], pa.list_(kind))


def stems(spans: Column, lexicon: Lexicon = Lexicon()) -> Column:
    """The names of a document's companies without their legal form, and the first words of those."""
    bare = F.transform(F.filter(spans, lambda x: (x["entity_type"] == "ORG") & x["surface"].rlike(LEGAL_END)), lambda x: F.regexp_replace(F.regexp_replace(x["surface"], LEGAL_END, ""), r"^[\s,.\-(\"«]+|[\s,.\-)\"»]+$", ""))
    bare = F.filter(bare, lambda s: F.length(s) >= 4)
    first = F.filter(F.transform(bare, lambda s: F.when(s.rlike(r"\s"), F.regexp_extract(s, r"^\S+", 0)).otherwise("")), lambda s: F.length(s) >= 4)
    return F.filter(F.array_distinct(F.concat(bare, first)), lambda s: ~(~s.contains(" ") & _weak(s, lexicon)) & ~_among(S.fold(s), lexicon.roles))


def _weak(s: Column, lexicon: Lexicon) -> Column:
    return (F.length(S.surface_norm(s)) < 4) | _among(S.surface_norm(s), lexicon.weak)


def with_mentions(docs: DataFrame, text_col: str, spans_col: str, into: str, lexicon: Lexicon = Lexicon()) -> DataFrame:
    """``docs`` with a column of other mentions of companies: the stems of the spans, with Finnish case endings, all by
    one pass over the text. Texts that name no company by its legal form don't go to Python."""
    named = docs.withColumn("__stems", stems(F.col(spans_col), lexicon))
    return named.withColumn(into, mentions(F.col(text_col), F.col("__stems"), lexicon)).drop("__stems")


def mentions(text: Column, stems: Column, lexicon: Lexicon = Lexicon()) -> Column:
    """Spans of given stems. Both must be columns of a table: Spark doesn't hand Python what lambdas make in passing."""
    some = F.size(stems) > 0
    own = search.arrow_column(_stem_spans, SPANS, F.when(some, text), F.when(some, stems))
    return F.filter(own, lambda x: ~_weak(x["surface"], lexicon) & ~_among(F.regexp_replace(S.fold(x["surface"]), "n+$", ""), lexicon.roles))
