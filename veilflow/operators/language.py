"""Language decision: sample, scores by ranked character grams, decision table."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.spans import let
from .language_texts import TEXTS
from .search import arrow_column

CODES = ("en", "fi", "sv")
MIN_TOKENS, MAX_CHARS = 40, 12_000  # fixed values


def sample(text: Column, most: int = MAX_CHARS) -> Column:
    """Long texts as head, middle and tail of a third of ``most`` each."""
    part, t = most // 3, F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    middle = F.floor((F.length(t) - part) / 2).cast("int")
    long = F.concat_ws("\n", F.substring(t, 1, part), F.substring(t, middle + 1, F.lit(part)), F.substring(t, F.length(t) - part + 1, F.lit(part)))
    return F.when(F.length(t) <= most, t).otherwise(long)


#: Grams of one to three letters, and how many of a profile count. SHARPNESS turns distances into scores: a text of
#: one language of a few sentences gives it over eight tenths, one of two languages in equal parts keeps both.
GRAMS, RANKS, SHARPNESS = (1, 2, 3), 300, 16.0


def _ranked(text: str) -> np.ndarray:
    """A text's most frequent grams of letters, the most frequent first; words begin and end with a gap. A gram is
    its code points, 21 bits each; equally frequent ones come in that order."""
    p = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = np.frombuffer("".join(c if c.isalpha() else " " for c in text.lower()).encode("utf-32-le", "surrogatepass"), np.uint32) if len(p) else p
    gap = letters == 32
    keep = ~(gap & np.r_[True, gap[:-1]]) if len(gap) else gap
    p = np.r_[32, letters[keep], 32].astype(np.uint64)
    grams = []
    for n in GRAMS:
        size = len(p) - n + 1
        if size > 0:
            code = np.zeros(size, np.uint64)
            for k in range(n):
                code = code << np.uint64(21) | p[k : k + size]
            inner = np.ones(size, bool)  # no gram is a gap alone or has one inside
            for k in range(n):
                inner &= (p[k : k + size] != 32) | ((k in (0, n - 1)) & (n > 1))
            grams.append(code[inner])
    found, count = np.unique(np.concatenate(grams), return_counts=True) if grams else (np.zeros(0, np.uint64), np.zeros(0, int))
    return found[np.argsort(-count, kind="stable")][:RANKS]


@lru_cache(1)
def _profiles() -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Of each language: its grams in order of codes, and their ranks."""
    out = {}
    for code in CODES:
        ranked = _ranked(TEXTS[code])
        order = np.argsort(ranked)
        out[code] = ranked[order], order
    return out


def distances(text: str) -> list[float]:
    """Out-of-place distance of a text's profile to each language's, 0 to 1: by how many ranks its grams differ on average,
    RANKS for a gram that a language's profile doesn't have."""
    own = _ranked(text)
    if not len(own):
        return [1.0] * len(CODES)
    out = []
    for grams, ranks in _profiles().values():
        at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
        apart = np.where(grams[at] == own, np.abs(ranks[at] - np.arange(len(own))), RANKS)
        out.append(float(apart.mean() / RANKS))
    return out


def _scores(texts: pa.Array) -> pa.Array:
    d = np.array([distances(t or "") for t in texts.to_pylist()]).reshape(-1, len(CODES))
    e = np.exp(-SHARPNESS * (d - d.min(axis=1, keepdims=True))) if len(d) else d
    e = e / e.sum(axis=1, keepdims=True) if len(d) else d
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(e[:, k])) for k in range(len(CODES))], list(CODES))


def scores(text: Column) -> Column:
    """Struct en, fi, sv of scores that sum to one, from ranked profiles of grams of one to three letters (Cavnar and
    Trenkle's method). Texts without letters score all languages alike."""
    return arrow_column(_scores, "struct<en:double,fi:double,sv:double>", text)


def decide(en: Column, fi: Column, sv: Column) -> Column:
    """Languages from three scores p >= s >= t: one if clear, two or three if mixed, one if it leads, else en and fi."""
    order = lambda a, b: F.when(a["s"] > b["s"], -1).when(a["s"] < b["s"], 1).when(a["i"] < b["i"], -1).otherwise(1)
    given = F.array(*[F.struct(x.cast("double").alias("s"), F.lit(i).alias("i"), F.lit(c).alias("c")) for i, (c, x) in enumerate(zip(CODES, (en, fi, sv)))])

    def table(ranked: Column) -> Column:
        p, s, t = (F.get(ranked, k)["s"] for k in range(3))
        first = F.array(F.get(ranked, 0)["c"])
        three = (t >= 0.22) & (F.size(F.filter(ranked, lambda r: r["s"] >= 0.25)) >= 3)
        all_ = F.transform(F.filter(ranked, lambda r: r["s"] >= 0.22), lambda r: r["c"])
        two = F.transform(F.array_sort(F.slice(ranked, 1, 2), lambda a, b: a["i"] - b["i"]), lambda r: r["c"])
        return F.when((p >= 0.75) & (p - s >= 0.20), first).when((p >= 0.35) & (s >= 0.25), F.when(three, all_).otherwise(two)).when(p >= 0.55, first).otherwise(F.array(F.lit("en"), F.lit("fi")))

    return let(F.array_sort(given, order), table)


def detect(text: Column) -> Column:
    """Struct (languages, reason) of a text."""
    part = F.coalesce(sample(text), F.lit(""))
    both = F.array(F.lit("en"), F.lit("fi"))
    short, empty = S.alpha_tokens(part) < MIN_TOKENS, part == ""
    # Python gets the texts that are long enough alone
    scored = let(scores(F.when(~short, part)), lambda s: decide(s["en"], s["fi"], s["sv"]))
    return F.when(empty, F.struct(both.alias("languages"), F.lit("empty_text").alias("reason"))).when(short, F.struct(both.alias("languages"), F.lit("short_text").alias("reason"))).otherwise(F.struct(scored.alias("languages"), F.lit("scored").alias("reason")))


def forced(flag: str) -> list[str] | None:
    """A list of languages from a flag; None for auto. Unknown parts are left out unless all are unknown."""
    parts = [p.strip().lower() for p in (flag or "auto").replace("+", ",").split(",") if p.strip()]
    if parts in (["auto"], []):
        return None
    known = [p for p in dict.fromkeys(parts) if p in CODES]
    if not known:
        raise ValueError(f"unsupported language {flag!r}")
    return known


def ocr_languages(flag: str, passes: list[str] | None = None) -> str:
    names = {"en": "eng", "fi": "fin", "sv": "swe"}
    return "+".join(names[c] for c in (forced(flag) or passes or ["en", "fi"]))
