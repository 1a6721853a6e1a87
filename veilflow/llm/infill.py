"""Fill-in-middle transformation: an Arrow-batched pandas UDF rearranges each text around two random cuts.

A text is cut into units by ``regex``'s finditer; only the units' end offsets are kept, four bytes each,
so two offset lookups give the slices. hashlib gives a document's random numbers and the digests. Rows
don't depend on one another: no shuffle, and a lost executor costs its own batches only."""

from __future__ import annotations

import hashlib
from array import array
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = regex.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Spark's description of the columns that ``transform`` adds.
ADDED = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string"


@dataclass(frozen=True)
class Rates:
    """Of 100 documents ``rearranged`` are not left plain; of 100 of those ``suffix_first`` are spm."""

    rearranged: int = 50
    suffix_first: int = 80


def ends(text: str) -> array:
    """End offset of each unit, in code points."""
    return array("I", (m.end() for m in UNIT.finditer(text)))


def numbers(seed: int, key: int | None) -> list[int]:
    """Four 32-bit numbers from the sha256 of ``seed:key`` (an empty key for null)."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def rearrange(text: str, key: int | None, seed: int = 42, rates: Rates = Rates()) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix, of the middle, output) of one text.

    A plain text is its own output, and has no prefix or middle."""
    h1, h2, h3, h4 = numbers(seed, key)
    stops = ends(text)
    n = len(stops)
    if not text or h3 % 100 >= rates.rearranged or any(x in text for x in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    a, b = (stops[i - 1] if i else 0 for i in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < rates.suffix_first:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(output: str, form: str) -> str:
    """The text that gave an output. Marks are found from the left; no text that holds one is rearranged,
    and a mark can't begin in a text's end, so the first of each is the one that was put there."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    if not output.startswith(first) or form not in ("spm", "psm"):
        raise ValueError(f"no output of form {form}")
    one, _, rest = output[len(first) :].partition(second)
    two, _, middle = rest.partition(MIDDLE)
    prefix, suffix = (two, one) if form == "spm" else (one, two)
    return prefix + middle + suffix


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _udf(seed: int, rates: Rates, texts: bool, digests: bool):
    def run(keys: pd.Series, own: pd.Series) -> pd.DataFrame:
        rows = []
        for key, text in zip(keys.tolist(), own.tolist()):
            text, key = (x if isinstance(x, str) else None for x in (text, key))  # nulls may come as NaN
            n, form, prefix, middle, out = rearrange(text or "", None if key is None else int(key), seed, rates)
            shas = (_sha256(out), _sha256(restore(out, form))) if digests else (None, None)
            rows.append((n, form, prefix, middle, out if texts else None, *shas))
        made = pd.DataFrame(rows, columns=[c.split()[0] for c in ADDED.split(", ")])
        return made.astype({"n": "Int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    return F.pandas_udf(run, ADDED)


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rates: Rates = Rates(), into: str = "fim", texts: bool = True, digests: bool = False) -> DataFrame:
    """``docs`` with a struct column ``into``: n, form (plain, psm or spm), prefix_chars, middle_chars, output and,
    if asked for, the sha256 of the output and of the text restored from it (``texts`` false: no output, for
    which nothing but digests then leaves the worker).

    Null texts count as empty ones: plain, no units. A null id draws the numbers of an empty one; rows with one id and
    one text come out alike, each of them. A text of white space is one unit. Texts of any length are
    taken whole, at four bytes a unit besides the text and its output; other columns, whatever their names, stay
    (a column named ``into`` is replaced). An empty table gives an empty table."""
    # as the plan's own columns, so that ids that aren't numbers fail early and no float stands in for a null
    key, text = F.col(f"`{id_col}`").cast("long").cast("string"), F.col(f"`{text_col}`").cast("string")
    return docs.withColumn(into, _udf(seed, rates, texts, digests)(key, text))


def restored(output, form):
    """Column: the text that ``transform`` made an output from."""
    output, form = (F.col(x) if isinstance(x, str) else x for x in (output, form))

    def run(outs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([restore(o, f) if isinstance(o, str) and isinstance(f, str) else None for o, f in zip(outs, forms)], dtype=object)

    return F.pandas_udf(run, "string")(output, form)
