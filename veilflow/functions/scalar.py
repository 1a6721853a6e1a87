"""Scalar functions on text columns: normal forms, checks of identifiers, placeholder names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spans import let


def fold(x: Column) -> Column:
    """Case folding as far as results need it: lower case, with sharp s as ss."""
    return F.replace(F.lower(x), F.lit("ß"), F.lit("ss"))


def collapse(x: Column) -> Column:
    """White space runs (of any script) to one space, none at the ends."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def entity_norm(x: Column) -> Column:
    """The form in which two surfaces are one entity."""
    return fold(collapse(x))


def surface_norm(x: Column) -> Column:
    """The form in which word lists hold surfaces."""
    return fold(F.regexp_replace(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""), r"^[\"'()«»]+|[\"'()«»]+$", ""))


def token_norm(x: Column) -> Column:
    return F.regexp_replace(surface_norm(x), r"^[.,;:'\"]+|[.,;:'\"]+$", "")


def digits(x: Column) -> Column:
    return F.regexp_replace(x, r"[^0-9]", "")


def _weighted(x: Column, weights: list[int]) -> Column:
    total = F.lit(0)
    for i, w in enumerate(weights, 1):
        total = total + F.substring(x, i, 1).try_cast("int") * w
    return total


def valid_business_id(number7: Column, check: Column) -> Column:
    """Finnish business id: weights 7 9 10 5 8 4 2 modulo 11; remainder 1 is never valid."""
    rem = _weighted(number7, [7, 9, 10, 5, 8, 4, 2]) % 11
    ok = F.when(rem == 0, check == "0").when(rem == 1, F.lit(False)).otherwise(check == (11 - rem).cast("string"))
    return F.coalesce(number7.rlike("^[0-9]{7}$") & ok, F.lit(False))


def valid_vat(digits8: Column) -> Column:
    return (F.length(digits8) == 8) & valid_business_id(F.substring(digits8, 1, 7), F.substring(digits8, 8, 1))


HETU_CHECK = "0123456789ABCDEFHJKLMNPRSTUVWXY"  # fixed value


def valid_hetu(x: Column) -> Column:
    """Finnish personal code ddmmyyCnnnX: day and month in range, and the check character modulo 31."""
    n = F.concat(F.substring(x, 1, 6), F.substring(x, 8, 3)).try_cast("bigint")
    shape = x.rlike("^(?i)[0-9]{6}[-+A-FU-Y][0-9]{3}[0-9A-Y]$")
    check = F.substring(F.lit(HETU_CHECK), (n % 31 + 1).cast("int"), F.lit(1)) == F.upper(F.substring(x, 11, 1))
    return F.coalesce(shape & F.substring(x, 1, 2).try_cast("int").between(1, 31) & F.substring(x, 3, 2).try_cast("int").between(1, 12) & check, F.lit(False))


def vin_check(x: Column) -> Column:
    """ISO 3779 check digit, in the ninth place."""
    v = F.upper(x)

    def holds(t: Column) -> Column:
        rem = _weighted(t, [8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2]) % 11
        return F.coalesce(F.when(rem == 10, "X").otherwise(rem.cast("string")) == F.substring(v, 9, 1), F.lit(False))

    return let(F.translate(v, "ABCDEFGHJKLMNPRSTUVWXYZ", "12345678123457923456789"), holds)  # fixed value: transliteration


def vin_like(x: Column) -> Column:
    letters = F.length(F.regexp_replace(x, "[^A-Za-z]", ""))
    return x.rlike("^(?i)[A-HJ-NPR-Z0-9]{17}$") & (letters >= 2) & (letters <= 15)


def plausible_plate(letters: Column) -> Column:
    return ~F.upper(letters).isin("ID", "OK", "NO", "YES", "PDF", "URL", "HTTP", "WWW")


def plausible_postal(code: Column) -> Column:
    return code.rlike("^[0-9]{5}$") & (code >= "00100")


def plausible_phone(raw: Column, labelled: bool = False) -> Column:
    """8 to 15 digits of which 7 to 10 are left after country code and trunk zero."""
    d = digits(raw)
    national = F.when(d.startswith("00358"), F.substring(d, 6, 99)).when(d.startswith("358"), F.substring(d, 4, 99)).when(d.startswith("0"), F.substring(d, 2, 99))
    national = national.otherwise(d) if labelled else national
    national = F.regexp_replace(national, "^0", "")
    return F.coalesce(F.length(d).between(8, 15) & F.length(national).between(7, 10) & ~F.trim(raw).rlike("^[0-9]{7}-[0-9]$"), F.lit(False))


def plausible_intl_phone(raw: Column) -> Column:
    s = F.trim(raw)
    return ~s.rlike("^[0-9]{7}-[0-9]$") & ~s.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}") & F.length(digits(s)).between(10, 15) & (s.startswith("+") | s.rlike(r"[\s\-()./]"))


def valid_iban(raw: Column) -> Column:
    """ISO 13616: the rearranged number leaves 1 when divided by 97; worked out 7 digits at a time."""
    s = F.upper(F.regexp_replace(raw, r"\s", ""))
    turned = F.concat(F.substring(s, 5, 99), F.substring(s, 1, 4))
    chars = F.filter(F.split(turned, ""), lambda c: c != "")
    rem = F.aggregate(chars, F.lit(0), lambda a, c: (F.when(c.rlike("[0-9]"), a * 10 + c.try_cast("int")).otherwise(a * 100 + F.ascii(c) - 55) % 97).cast("int"))
    return s.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & (rem == 1)


def valid_card(raw: Column) -> Column:
    d = digits(raw)
    return F.length(d).between(12, 19) & F.call_function("luhn_check", d)


def web_url(surface: Column) -> Column:
    """A real link: with a scheme, www., or a host of three labels."""
    s = F.lower(F.regexp_replace(F.trim(surface), r"[.,;:!?)\]}'\"]+$", ""))
    return F.coalesce(s.rlike(r"^(https?://|ftp://|www\.)") | s.rlike(r"^[a-z0-9][a-z0-9\-]*\.[a-z0-9][a-z0-9\-]*\.[a-z]{2,24}(/[^\s]*)?$"), F.lit(False))


FEE_CITY = r"(?iu)(?:veloitus|maksu|palkkio|vuokra|vuokrat|ehdot|palvelut|palvelu|yhteens[aä]|raja|kilometri|tunnit|er[aä]|osuu[s]?)$"  # fixed value


def plausible_city(city: Column) -> Column:
    c = F.trim(city)
    return F.length(c).between(2, 40) & ~c.rlike(FEE_CITY) & ~((F.length(c) > 18) & ~c.rlike("[- ]"))


def loopback_url(url: Column) -> Column:
    """A url on this machine. 0.0.0.0 is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@]*@)?(\[[^\]]*\]|[^/:?#]*)", 1))
    return host.isin("localhost", "[::1]") | host.rlike(r"^127\.[0-9]+\.[0-9]+\.[0-9]+$")


def alpha_tokens(x: Column) -> Column:
    """Runs of letters of any script."""
    return F.regexp_count(x, F.lit(r"\p{L}+"))


def slug(x: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", "template").otherwise(s)


def placeholder(x: Column) -> Column:
    """``org_1``, ``[ORG_1]`` and the like as ``[ORG_1]``; null if it is no placeholder."""
    m = F.regexp_extract(F.upper(F.trim(x)), r"^\[?([A-Z][A-Z0-9_]*_[0-9]+)\]?$", 1)
    return F.when(m != "", F.concat(F.lit("["), m, F.lit("]")))


def placeholder_label(x: Column) -> Column:
    return F.regexp_extract(x, r"^\[?([A-Z][A-Z0-9_]*)_[0-9]+\]?$", 1)


def shorten(x: Column, most: int) -> Column:
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most - 1), F.lit("…"))).otherwise(x)


def search_variants(x: Column) -> Column:
    """Forms under which a surface may stand in a file: as it is, with plain spaces, with hard spaces, collapsed."""
    plain = F.translate(x, "\u00a0\u202f\u2009", "   ")
    return F.array_distinct(F.filter(F.array(x, plain, F.replace(plain, F.lit(" "), F.lit("\u00a0")), collapse(x)), lambda v: F.trim(v) != ""))


def close_gaps(x: Column) -> Column:
    """Runs of two or more white space characters other than newlines as one space."""
    return F.regexp_replace(x, r"(?U)[^\S\n]{2,}", " ")
