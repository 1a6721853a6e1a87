"""Many surfaces searched at once: an automaton with failure links reads each text once, however many there are.

Lists that are part of a job (deny lists) are one automaton a worker; lists of a document's own (company stems, answers
of models, maps) are one a document. Tables of surfaces that grow with the corpus are joined to documents by hashed
windows first (``search_table``), so that each document meets only what it may hold."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType

from ..functions.spans import SPANS

#: Code points of all surfaces of one automaton, at most: some 100 MB in a worker.
MOST_POINTS = 500_000
#: Code points beyond which no letter has two cases (as of Unicode 16), and those of a gram that can begin a surface.
_CASED, _GRAM = 0x1E944, 3
_SPAN = pa.struct([("entity_type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("surface", pa.string())])


@lru_cache(1)
def _folds() -> np.ndarray:
    """The small form of each code point, as case-insensitive patterns take it: one for one."""
    out = np.arange(_CASED, dtype=np.uint32)
    for i in range(_CASED):
        if not 0xD800 <= i < 0xE000:
            c = chr(i)
            up = c.upper()
            low = (up if len(up) == 1 else c).lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def points(text: str, fold: bool = True) -> np.ndarray:
    """The code points of a text, letters in small if ``fold``; as many as the text has."""
    p = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not fold or not len(p):
        return p
    if int(p.max()) < _CASED:
        return _folds()[p]
    return np.where(p < _CASED, _folds()[np.minimum(p, _CASED - 1)], p)


def _grams(p: np.ndarray, size: int) -> np.ndarray:
    """16-bit hashes of the runs of ``size`` code points."""
    n = max(len(p) - size + 1, 0)
    h = np.zeros(n, np.uint32)
    for k in range(size):
        h = (h ^ p[k : k + n]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return h & np.uint32(0xFFFF)


class Automaton:
    """Aho-Corasick automaton over code points. Where no surface is under way it goes on at the next place
    where one can begin, which a bitmap of the surfaces' first grams tells for the whole text at once."""

    def __init__(self, surfaces: list[str], fold: bool = True):
        self.fold, own = fold, [points(s, fold) for s in surfaces]
        self.sizes = [len(p) for p in own]
        if sum(self.sizes) > MOST_POINTS:
            raise ValueError(f"over {MOST_POINTS} characters of surfaces: search a table of them")
        self.step: dict[int, int] = {}  # state << 21 | code point -> state
        self.ends: dict[int, list[int]] = {}  # surfaces that end in a state itself
        children: list[list[tuple[int, int]]] = [[]]
        for number, p in enumerate(own):
            s = 0
            for c in p.tolist():
                t = self.step.get(s << 21 | c)
                if t is None:
                    t = self.step[s << 21 | c] = len(children)
                    children[s].append((c, t))
                    children.append([])
                s = t
            if s:
                self.ends.setdefault(s, []).append(number)
        self.back = [0] * len(children)  # the longest suffix of a state that is one too
        self.shorter = [0] * len(children)  # the next suffix in which surfaces end
        queue = deque(t for _, t in children[0])
        while queue:
            s = queue.popleft()
            for c, t in children[s]:
                f = self.back[s]
                while f and f << 21 | c not in self.step:
                    f = self.back[f]
                f = self.step.get(f << 21 | c, 0)
                self.back[t] = f
                self.shorter[t] = f if f in self.ends else self.shorter[f]
                queue.append(t)
        self.size = min([n for n in self.sizes if n], default=0)
        self.size = min(self.size, _GRAM)
        self.first = np.zeros(1 << 16, bool)
        for p in own:
            if len(p):
                self.first[_grams(p[: self.size], self.size)] = True

    def hits(self, text: str) -> Iterator[tuple[int, int]]:
        """(number of the surface, start) of every place where one stands, overlaps included, by ends."""
        if not self.size or len(text) < self.size:
            return
        p = points(text, self.fold)
        starts = np.flatnonzero(self.first[_grams(p, self.size)])
        view, step, back, n = memoryview(p), self.step, self.back, len(p)
        state, at, turn, order = 0, 0, 0, starts.tolist()
        while turn < len(order):
            at = order[turn]
            state = 0
            while at < n:
                c = view[at]
                t = step.get(state << 21 | c)
                while t is None and state:
                    state = back[state]
                    t = step.get(state << 21 | c)
                state = t or 0
                at += 1
                s = state if state in self.ends else self.shorter[state]
                while s:
                    for number in self.ends[s]:
                        yield number, at - self.sizes[number]
                    s = self.shorter[s]
                if not state:
                    break
            while turn < len(order) and order[turn] < at:
                turn += 1

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(number, start, end), by number and start; places of one surface that overlap an earlier one of it are left out."""
        last = [0] * len(self.sizes)
        found = []
        for number, start in self.hits(text):  # of one surface they come from left to right
            if start >= last[number]:
                last[number] = start + self.sizes[number]
                found.append((number, start, last[number]))
        return sorted(found)


@lru_cache(4)
def _automaton(surfaces: tuple[str, ...], fold: bool) -> Automaton:
    return Automaton(list(surfaces), fold)


def arrow_column(run: Callable, kind: str, *columns: Column) -> Column:
    """A column that Python works out over Arrow batches, once: Spark must not copy it into filters it infers."""
    return F.arrow_udf(run, kind, ArrowUDFType.SCALAR).asNondeterministic()(*columns)


def listed(text: Column, entries: list[tuple[str, str]], score: float = 1.0, fold: bool = True) -> Column:
    """Spans of every place of listed (surface, type) pairs, in any case if ``fold``: by entry, then from left to right;
    places of one entry don't overlap. White space around a surface doesn't count, blank ones are left out."""
    own = [(s.strip(), t.upper()) for s, t in entries if s.strip()]
    surfaces, types = tuple(s for s, _ in own), [t for _, t in own]

    def run(texts: pa.Array) -> pa.Array:
        machine = _automaton(surfaces, fold)
        return pa.array([[{"entity_type": types[k], "start": a, "end": b, "score": score, "surface": t[a:b]} for k, a, b in machine.find(t)] if t else [] for t in texts.to_pylist()], pa.list_(_SPAN))

    return arrow_column(run, SPANS, text)


_FOUND = "array<struct<number:int,start:int,surface:string>>"


def found(text: Column, surfaces: Column, fold: bool = True) -> Column:
    """(number, start, surface) of every place of a document's own surfaces (an array of strings); the number is the
    surface's place in the array. Texts without surfaces don't go to Python."""

    def run(texts: pa.Array, lists: pa.Array) -> pa.Array:
        kind = pa.struct([("number", pa.int32()), ("start", pa.int32()), ("surface", pa.string())])
        rows = []
        for t, own in zip(texts.to_pylist(), lists.to_pylist()):
            places = Automaton([s or "" for s in own], fold).find(t) if t and own else []
            rows.append([{"number": k, "start": a, "surface": t[a:b]} for k, a, b in places])
        return pa.array(rows, pa.list_(kind))

    some = F.size(surfaces) > 0
    return arrow_column(run, _FOUND, F.when(some, text), F.when(some, surfaces))


def replaced(text: Column, entries: Column, style: str = "placeholder") -> Column:
    """A text with every ``original`` of its entries (placeholder, original) replaced, in one pass: longer ones
    first, of equally long ones the first by letters, each from left to right; what was put in is not searched again.

    Both must be columns of a table: Spark doesn't hand Python what lambdas make in passing. Texts without entries
    don't go to Python."""

    def run(texts: pa.Array, lists: pa.Array) -> pa.Array:
        out = []
        for t, own in zip(texts.to_pylist(), lists.to_pylist()):
            own = sorted(((e["original"], e["placeholder"]) for e in own or () if e["original"]), key=lambda e: (-len(e[0]), e[0].casefold()))
            out.append(substitute(t, own, style) if t and own else t)
        return pa.array(out, pa.string())

    some = F.size(entries) > 0
    return F.when(some, arrow_column(run, "string", F.when(some, text), F.when(some, entries))).otherwise(text)


def substitute(text: str, entries: list[tuple[str, str]], style: str = "placeholder") -> str:
    """``text`` with (surface, placeholder) entries replaced, the first of the list first."""
    taken = np.zeros(len(text), bool)
    places = []
    for number, a, b in Automaton([s for s, _ in entries], fold=False).find(text):
        if not taken[a:b].any():
            taken[a:b] = True
            places.append((a, b, "" if style == "remove" else entries[number][1]))
    parts, last = [], 0
    for a, b, tag in sorted(places):
        parts += text[last:a], tag
        last = b
    return "".join([*parts, text[last:]])


# --- tables of surfaces ---------------------------------------------------------------------------

#: Code points of the least window by which surfaces of a table meet texts; shorter ones can't be searched so.
JOIN_GRAM = 4
#: Bits of a filter of hashes that the tasks get, at most: 4 MB. Beyond some millions of surfaces it lets more through.
_BITS = 1 << 25
#: Code points of texts that are hashed at once (a longer text is a step of its own).
_STEP = 1 << 18
_KEY = "struct<size:int,first:long,whole:long,small:string>"
#: Places of texts that go on to Spark at once, bits of a filter at least, and the base of the hashes of windows.
_ROWS, _LEAST_BITS, _BASE = 1 << 14, 1 << 20, 0x9E6C63D0876A9A47


def _small(text: str) -> str:
    """A text with its letters in small, code point by code point."""
    return points(text).tobytes().decode("utf-32-le", "surrogatepass")


def _both(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """Hashes of pairs, in that order."""
    h = (a ^ (a >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(b)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(31))


@lru_cache(1)
def _step_powers() -> tuple[np.ndarray, np.ndarray]:
    return _raised(2 * _STEP)


def _raised(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        run = np.full(n, base, np.uint64)
        run[:1] = 1
        out.append(np.cumprod(run, dtype=np.uint64))
    return out[0], out[1]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of _BASE modulo 2**64, and those of its inverse."""
    up, down = _step_powers() if n <= 2 * _STEP else _raised(n)
    return up[:n], down[:n]


def _surface_keys(surfaces: pa.Array) -> pa.Array:
    """Size, the hash of the largest window at the start, that of the whole surface, and the surface in small; null for those
    that are too short."""
    same: dict[int, list[int]] = {}
    texts = surfaces.to_pylist()
    for i, s in enumerate(texts):
        same.setdefault(len(s), []).append(i)
    size, first, whole = np.zeros(len(texts), np.int32), np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64)
    for m, at in same.items():  # all of one size at once
        if m >= JOIN_GRAM:
            p, w = points("".join(texts[i] for i in at)).reshape(len(at), m), 1 << (m.bit_length() - 1)
            terms = p * _powers(m)[0]
            size[at], first[at], whole[at] = m, terms[:, :w].sum(axis=1) >> np.uint64(32), _both(terms.sum(axis=1), m)
    numbers = [pa.array(size), pa.array(first.view(np.int64)), pa.array(whole.view(np.int64)), pa.array([_small(s) for s in texts], pa.string())]
    return pa.StructArray.from_arrays(numbers, ["size", "first", "whole", "small"], mask=pa.array(size == 0))


def _filters(keyed: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the hashes of first windows and of whole surfaces, a byte each eight."""
    at = lambda c: F.col(f"key.{c}").bitwiseAND(F.lit(bits - 1).cast("long"))
    both = keyed.select(F.explode(F.array(at("first"), at("whole") + F.lit(bits))).alias("bit")).distinct()
    cells = both.groupBy(F.shiftright("bit", 16).alias("cell")).agg(F.collect_list(F.col("bit").bitwiseAND(F.lit(0xFFFF).cast("long")).cast("int")).alias("bits"))
    out = np.zeros(bits // 4, np.uint8)
    for r in cells.toLocalIterator():  # a cell at a time: 65,536 bits at most
        mask = np.zeros(1 << 16, bool)
        mask[r["bits"]] = True
        out[r["cell"] << 13 : (r["cell"] + 1) << 13] = np.packbits(mask, bitorder="little")
    return out[: bits // 8], out[bits // 8 :]


def _steps(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """(number of the first, texts) of about _STEP code points together."""
    first, own, n = 0, [], 0
    for i, t in enumerate(texts):
        if own and n + len(t or "") > _STEP:
            yield first, own
            first, own, n = i, [], 0
        own.append(t or "")
        n += len(t or "")
    if own:
        yield first, own


def _places(texts: list[str], sizes: dict[int, list[int]], firsts: np.ndarray, wholes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(number of a text, start, size, hash) of every place where a surface may stand. ``sizes``: of surfaces, by their largest
    window. Windows are differences of one running sum, whatever their sizes are."""
    p, last = points("".join(texts)), np.cumsum([len(t) for t in texts])
    up, down = _powers(len(p))
    sums = np.zeros(len(p) + 1, np.uint64)
    np.cumsum(p * up, dtype=np.uint64, out=sums[1:])
    mask, begin, found = np.uint64(len(firsts) - 1), last - [len(t) for t in texts], []
    for w, own in sizes.items():
        if w > len(p):
            continue
        h = sums[w:] - sums[:-w]
        h *= down[: len(h)]
        h >>= np.uint64(32)
        h &= mask
        at = np.flatnonzero(firsts[h.view(np.int64)])
        if not len(at):
            continue
        row = np.searchsorted(last, at, "right")
        left = last[row] - at  # code points from here to the end of the text
        for size in own:
            ok = left >= size
            a, number = at[ok], row[ok]
            key = _both((sums[a + size] - sums[a]) * down[a], size)
            some = np.flatnonzero(wholes[(key & mask).view(np.int64)])
            if len(some):
                found.append((number[some], a[some] - begin[number[some]], np.full(len(some), size), key[some].view(np.int64)))
    return tuple(map(np.concatenate, zip(*found))) if found else (np.zeros(0, np.int64),) * 4


def _met(texts: list[str], sizes: dict[int, list[int]], firsts: np.ndarray, wholes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of a text, hash of a surface that may stand in it), each once."""
    row, _, _, key = _places(texts, sizes, firsts, wholes)
    found = np.unique(np.rec.fromarrays([row, key], names="row,key"))
    return found["row"], found["key"]


def _text_keys(shared):
    def run(batches):
        sizes, *packed = shared.value
        firsts, wholes = (np.unpackbits(x, bitorder="little").view(bool) for x in packed)
        for batch in batches:
            rest = [c for c in batch.schema.names if c != "text"]
            for first, texts in _steps(batch.column("text").to_pylist()) if sizes else ():
                found = _places(texts, sizes, firsts, wholes)
                for k in range(0, len(found[0]), _ROWS):
                    row, start, size, key = (x[k : k + _ROWS] for x in found)
                    pieces = [texts[r][a : a + m] for r, a, m in zip(row.tolist(), start.tolist(), size.tolist())]
                    own = [pa.array(key), pa.array(start.astype(np.int32)), pa.array(pieces, pa.string()), pa.array([_small(t) for t in pieces], pa.string())]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(row + first)) for c in rest), *own], [*rest, "whole", "start", "piece", "small"])

    return run


#: Surfaces up to which a text is searched for one after another: less work than an automaton of its own.
_SINGLY = 32


def _find(text: str, surfaces: list[str]) -> list[tuple[int, int, int]]:
    """As ``Automaton(surfaces).find(text)``, for surfaces of which most stand in the text."""
    if len(surfaces) > _SINGLY:
        return Automaton(surfaces).find(text)
    folded, found = _small(text), []
    for number, s in enumerate(map(_small, surfaces)):
        at = folded.find(s) if s else -1
        while at >= 0:
            found.append((number, at, at + len(s)))
            at = folded.find(s, at + len(s))
    return found


def search_table(docs: DataFrame, entries: DataFrame, text_col: str = "text", within: str | None = None, into: str = "spans", score: float = 1.0) -> DataFrame:
    """``docs`` with a column ``into``: spans of every place, in any case, of the surfaces of a table ``entries`` (surface,
    entity_type), of any size. With ``within``, a column of both tables, only entries of the same group count.

    A surface is told by the hash of the whole of it. Places of a text where a filter lets the largest window through that
    surfaces begin with (of a power of two code points) are hashed in all sizes that surfaces with such a window have (sizes
    are a list that goes to the tasks, as long as the longest surface at most); what a filter of whole surfaces lets through
    is joined with them, and counts if it is a surface letter by letter. So a text meets what stands in it, however much of
    it other surfaces begin with or have in common; it is read once, and what was found joins its row by two hashes of the
    text. Surfaces of fewer than JOIN_GRAM characters raise an error, blank ones don't count; null texts have no spans.
    Spans come by surface and start, places of a surface that overlap an earlier one of it are left out.
    Rows of ``docs`` stay what they are, repeated ones too."""
    spark = docs.sparkSession
    keyed = entries.where(F.trim("surface") != "").select(F.trim("surface").alias("surface"), F.upper("entity_type").alias("entity_type"), *([F.col(f"`{within}`").alias("__in")] if within else [])).distinct()
    keyed = keyed.withColumn("key", arrow_column(_surface_keys, _KEY, F.col("surface")))
    sizes, n = {}, 0
    for r in keyed.groupBy("key.size").count().orderBy("size").collect():
        if r["size"] is None:
            raise ValueError(f"surfaces of fewer than {JOIN_GRAM} characters can't be searched by table")
        sizes.setdefault(1 << (r["size"].bit_length() - 1), []).append(r["size"])
        n += r["count"]
    bits = min(_BITS, max(_LEAST_BITS, 1 << (32 * n).bit_length()))
    shared = spark.sparkContext.broadcast((sizes, *_filters(keyed, bits)))
    own_in = [F.col(f"`{within}`").alias("__in")] if within else []
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.withColumns({"__rid": F.xxhash64(f"`{text_col}`", *([F.col(f"`{within}`")] if within else [])), "__crc": F.crc32(text.cast("binary"))})
    texts = rows.where(text.isNotNull()).select(F.col("__rid").alias("rid"), F.col("__crc").alias("crc"), *own_in, text.alias("text"))
    kind = "rid long, crc long, " + (f"__in {docs.schema[within].dataType.simpleString()}, " if within else "")
    met = texts.mapInArrow(_text_keys(shared), kind + "whole long, start int, piece string, small string").distinct()
    surfaces = keyed.withColumns({"whole": F.col("key.whole"), "small": F.col("key.small")}).drop("key")
    pairs = met.join(surfaces, ["whole", "small", *(["__in"] if within else [])])
    own = pairs.groupBy("rid", "crc").agg(F.sort_array(F.collect_list(F.struct("surface", "entity_type", "start", "piece"))).alias("own"))

    def run(lists: pa.Array) -> pa.Array:
        out = []
        for found in lists.to_pylist():
            spans, entry, end = [], None, 0
            for x in found:
                if (x["surface"], x["entity_type"]) != entry:
                    entry, end = (x["surface"], x["entity_type"]), 0
                if x["start"] >= end:
                    end = x["start"] + len(x["piece"])
                    spans.append({"entity_type": x["entity_type"], "start": x["start"], "end": end, "score": score, "surface": x["piece"]})
            out.append(spans)
        return pa.array(out, pa.list_(_SPAN))

    spans = own.select(F.col("rid").alias("__rid"), F.col("crc").alias("__crc"), arrow_column(run, SPANS, F.col("own")).alias("__own"))
    joined = rows.join(spans, ["__rid", "__crc"], "left")
    return joined.withColumn(into, F.coalesce("__own", F.array().cast(SPANS))).drop("__rid", "__crc", "__own")
