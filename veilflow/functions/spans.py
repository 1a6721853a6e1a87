"""Spans as arrays of structs, made and combined by column expressions: one document stays one row.

A span is (entity_type, start, end, score, surface); offsets are code points, half open."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<entity_type:string,start:int,end:int,score:double,surface:string>"
SPANS = f"array<{SPAN}>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def scan(values: Column, kind: str = "int") -> Column:
    """Sums of all values before each of an array, and of all at the end. Arrays are worked through in pieces of
    about the root of their size, so that appending costs little however long they are."""
    size = F.ceil(F.sqrt(F.size(values) + F.lit(1))).cast("int")

    def append(acc: Column, x: Column) -> Column:
        return F.concat(acc, F.array((F.element_at(acc, -1) + x).cast(kind)))

    def pieces(k: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor(F.size(values) / k).cast("int")), lambda j: F.slice(values, j * k + 1, k))

    def totals(parts: Column) -> Column:
        sums = F.transform(parts, lambda p: F.aggregate(p, F.lit(0).cast(kind), lambda a, x: (a + x).cast(kind)))
        return F.aggregate(sums, F.array(F.lit(0).cast(kind)), append)

    def within(parts: Column, starts: Column) -> Column:
        return F.flatten(F.transform(parts, lambda p, j: F.slice(F.aggregate(p, F.array(F.get(starts, j)), append), F.lit(1), F.size(p))))

    def whole(parts: Column) -> Column:
        return let(totals(parts), lambda starts: F.concat(within(parts, starts), F.array(F.element_at(starts, -1))))

    return F.when(F.size(values) <= 64, F.aggregate(values, F.array(F.lit(0).cast(kind)), append)).otherwise(let(size, lambda k: let(pieces(k), whole)))


def slicing(text: Column, body: Callable[[Callable[[Column, Column | int], Column]], Column]) -> Column:
    """``body`` of a function (start, size) that gives a part of ``text`` in time that doesn't depend on where it lies:
    one byte a character for ASCII texts, four for others."""

    def whole(v: Column) -> Column:
        def part(start: Column, size: Column | int) -> Column:
            size = F.lit(size) if isinstance(size, int) else size
            first = F.greatest(start, F.lit(0))
            wide = F.decode(F.substring(v["bytes"], first * 4 + 1, F.greatest(size, F.lit(0)) * 4), "UTF-32")
            return F.when(v["ascii"], F.substring(v["bytes"], first + 1, size).cast("string")).otherwise(wide)

        return body(part)

    ascii_ = F.octet_length(text) == F.length(text)
    return let(F.struct(F.when(ascii_, text.cast("binary")).otherwise(F.encode(text, "UTF-32")).alias("bytes"), ascii_.alias("ascii")), whole)


def sliced_spans(text: Column, spans: Column, body: Callable[[Column, Callable[[Column, Column | int], Column]], Column]) -> Column:
    """``body`` of spans and a function as in ``slicing``, which texts without spans are spared."""
    return let(spans, lambda xs: F.when(F.size(xs) == 0, F.filter(xs, lambda x: F.lit(False))).otherwise(slicing(text, lambda part: body(xs, part))))


def none() -> Column:
    return F.array().cast(SPANS)


def span(entity: Column | str, start: Column, end: Column, score: Column | float, surface: Column) -> Column:
    entity = F.lit(entity) if isinstance(entity, str) else entity
    score = F.lit(float(score)) if isinstance(score, (int, float)) else score
    return F.struct(entity.alias("entity_type"), start.cast("int").alias("start"), end.cast("int").alias("end"), score.cast("double").alias("score"), surface.alias("surface"))


#: Characters for private use: one marks both ends of matches, the other stands for it where a text holds it.
MARK, STAND_IN = "\ue0a7", "\ue0a8"
_FINDER: ContextVar[Finder | None] = ContextVar("finder", default=None)
_FOUND = "array<struct<start:int,surface:string>>"


class Finder:
    """Searches that are worked out together as one column ``name``: what they have in common is planned once."""

    def __init__(self, name: str):
        self.name, self.entries = name, []

    def add(self, entry: Column) -> Column:
        self.entries.append(entry)
        return F.get(F.col(self.name), F.lit(len(self.entries) - 1))

    def column(self) -> Column:
        return _placed(self.entries) if self.entries else F.array().cast(f"array<{_FOUND}>")


@contextmanager
def collecting(name: str):
    """Within it ``matches`` of constant patterns refer to the column ``name``, which the finder then makes."""
    finder = Finder(name)
    token = _FINDER.set(finder)
    try:
        yield finder
    finally:
        _FINDER.reset(token)


def _placed(entries: list[Column]) -> Column:
    """For each (parts, text, marked): the matches among the parts, every second one, with their starts."""

    def one(e: Column) -> Column:
        parts, text = e["parts"], e["text"]
        odd = F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2))

        def found(starts: Column) -> Column:
            surface = lambda i: F.when(e["marked"], F.substring(text, F.get(starts, i) + 1, F.length(F.get(parts, i)))).otherwise(F.get(parts, i))
            return F.transform(odd, lambda i: F.struct(F.get(starts, i).alias("start"), surface(i).alias("surface")))

        some = let(scan(F.transform(parts, lambda x: F.length(x))), found)
        return F.when(F.size(parts) > 2, some).otherwise(F.array().cast(_FOUND))

    return F.transform(F.array(*entries), one)


def matches(text: Column, pattern: str | Column, guard: Column | None = None) -> Column:
    """(start, surface) of every match of a regular expression, by one search: matches are marked, the marked
    text is split, and a match starts where all parts before it end. ``guard``, a cheap test, spares texts that
    can't match."""
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    parts = F.split(F.regexp_replace(F.translate(text, MARK, STAND_IN), p, F.lit(f"{MARK}$0{MARK}")), MARK, -1)
    entry = F.struct((parts if guard is None else F.when(guard, parts)).alias("parts"), text.alias("text"), text.contains(MARK).alias("marked"))
    finder = _FINDER.get()
    if finder is not None and isinstance(pattern, str):
        return finder.add(entry)
    return F.element_at(_placed([entry]), 1)


def pattern_spans(text: Column, pattern: str, entity: str, score: float | Callable[[Column], Column], keep: Callable[[Column], Column] | None = None, part: str | None = None, guard: Column | None = None) -> Column:
    """Spans of a pattern. ``keep`` tests a surface. ``part`` is a pattern with groups 1 and 2 over a match:
    what stands before the span, and the span."""
    found = matches(text, pattern, guard)
    if part is not None:
        found = F.transform(found, lambda m: F.struct((m["start"] + F.length(F.regexp_extract(m["surface"], part, 1))).cast("int").alias("start"), F.regexp_extract(m["surface"], part, 2).alias("surface")))
    if keep is not None:
        found = F.filter(found, lambda m: keep(m["surface"]))
    value = score if callable(score) else (lambda _: F.lit(float(score)))
    return F.transform(found, lambda m: span(entity, m["start"], m["start"] + F.length(m["surface"]), value(m["surface"]), m["surface"]))


def before(part: Callable[[Column, Column | int], Column], start: Column, size: int) -> Column:
    """What stands before a place, ``size`` characters at most."""
    return part(start - size, F.least(start, F.lit(size)))


def _fold(spans: Column, order: Callable[[Column, Column], Column], better: Callable[[Column, Column], Column], kind: str) -> Column:
    """Go through sorted spans; one that overlaps the last kept replaces it if it is better, else goes.

    Kept spans never overlap and starts only grow, so none but the last can be in the way: pieces of the
    spans, of about the root of their number, take the last kept one over and hand theirs on."""

    def step(kept: Column, x: Column) -> Column:
        last = F.element_at(kept, -1)
        clash = (x["start"] < last["end"]) & (x["end"] > last["start"])
        swap = F.concat(F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))), F.array(x))
        return F.when(F.size(kept) == 0, F.array(x)).when(~clash, F.concat(kept, F.array(x))).when(better(x, last), swap).otherwise(kept)

    def piece(acc: Column, p: Column) -> Column:
        kept = F.aggregate(p, F.slice(acc["last"], F.lit(1), F.lit(1)), step)
        return let(kept, lambda k: F.struct(F.concat(acc["done"], F.array(F.slice(k, F.lit(1), F.greatest(F.size(k) - 1, F.lit(0))))).alias("done"), F.slice(k, F.greatest(F.size(k), F.lit(1)), F.lit(1)).alias("last")))

    def whole(xs: Column) -> Column:
        k = F.ceil(F.sqrt(F.size(xs) + F.lit(1))).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.floor(F.size(xs) / k).cast("int")), lambda j: F.slice(xs, j * k + 1, k))
        empty = F.struct(F.array().cast(f"array<{kind}>").alias("done"), F.array().cast(kind).alias("last"))
        return F.aggregate(parts, empty, piece, lambda acc: F.concat(F.flatten(acc["done"]), acc["last"]))

    return let(F.array_sort(spans, order), whole)


def _compare(*keys: tuple[Column, Column]) -> Column:
    """-1, 0 or 1 by pairs of keys, the first that differs deciding."""
    out = F.lit(0)
    for a, b in reversed(keys):
        out = F.when(a < b, -1).when(a > b, 1).otherwise(out)
    return out


def _size(x: Column) -> Column:
    return x["end"] - x["start"]


def merge(spans: Column, priority: Callable[[Column], Column], typed_only: bool = False) -> Column:
    """Resolve overlaps: higher score wins; at equal scores the higher priority, then the longer; a span of
    higher priority also wins over one that scores up to 0.15 more (not if ``typed_only``). Ties keep the
    order in which detectors gave them."""
    rich = F.transform(spans, lambda x, i: F.struct(x["entity_type"].alias("entity_type"), x["start"].alias("start"), x["end"].alias("end"), x["score"].alias("score"), x["surface"].alias("surface"), priority(x["entity_type"]).cast("int").alias("priority"), i.cast("int").alias("ord")))
    kind = SPANS.replace("surface:string>", "surface:string,priority:int,ord:int>")

    def order(a: Column, b: Column) -> Column:
        return _compare((a["start"], b["start"]), (_size(b), _size(a)), (b["score"], a["score"]), (b["priority"], a["priority"]), (a["ord"], b["ord"]))

    def better(x: Column, y: Column) -> Column:
        equal = (x["score"] == y["score"]) & ((x["priority"] > y["priority"]) | ((x["priority"] == y["priority"]) & (_size(x) > _size(y))))
        close = F.lit(False) if typed_only else (x["priority"] > y["priority"]) & (x["score"] >= y["score"] - 0.15)
        return (x["score"] > y["score"]) | equal | close

    return F.transform(_fold(rich, order, better, kind), lambda x: span(x["entity_type"], x["start"], x["end"], x["score"], x["surface"]))


def longest(spans: Column) -> Column:
    """Of overlapping spans the longer stays; of equally long ones the first."""
    return _fold(F.array_distinct(spans), lambda a, b: _compare((a["start"], b["start"]), (_size(b), _size(a))), lambda x, y: _size(x) > _size(y), SPANS)


def in_order(spans: Column) -> Column:
    return F.array_sort(spans, lambda a, b: _compare((a["start"], b["start"]), (a["end"], b["end"])))


def to_block(spans: Column, first: Column, last: Column, text: Column) -> Column:
    """What of document spans lies in a block [first, last), in the block's own offsets."""
    own = F.filter(spans, lambda x: (x["start"] < last) & (x["end"] > first) & (F.least(x["end"], last) > F.greatest(x["start"], first)))

    def clip(x: Column) -> Column:
        a, b = F.greatest(x["start"], first) - first, F.least(x["end"], last) - first
        return span(x["entity_type"], a, b, x["score"], F.substring(text, a + 1, b - a))

    return F.transform(own, clip)
