"""Phrase collocations: vertical positional inverted lists, extended by merge-joins of positions.

Texts are dealt into blocks of one language. A block's inverted lists - word, and the places where it stands - are
written once. A list's length is the word's exact frequency in the block, the sum over blocks its frequency in the language. Phrases
grow word by word: the places of frequent phrases are merge-joined with the lists of adjacent words, a block at
a time, and the lengths of the lists that this gives are summed. Only parts that are frequent
themselves are extended: a filter of their hashes, a bitmap of bounded size, goes to the tasks. It lets all
frequent ones through and some others; these are counted exactly like the rest, so the filter only saves work."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import cut, drop_table, filled, lean, mix

#: Bytes of text of a block; a longer text goes in several, cut where a word ends.
BLOCK = 1 << 21
#: Bytes of lists that a task reads at once: a few blocks.
GROUP = 1 << 23
#: Bits of a filter at most: 32 MB. Past some 10^8 frequent phrases it lets more through, which costs shuffling only.
MOST_BITS = 1 << 28
#: A byte that no UTF-8 text has stands for what parts pieces.
_BREAK = b"\xff"
_PLAIN = bytes(0xFF if c in b".,;:!?\n\x0b\x0c\r" else 0x20 if c == 9 else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_LISTS = "lang string, words array<string>, lengths array<int>, fresh array<int>, places array<int>, again int"


def windows(data: bytes, most: int = BLOCK, repeat: int = 2):
    """(bytes before that belong to words already counted, window) of one text, A-Z in small, pieces parted by _BREAK.

    A window ends where a piece ends, if one does in its last tenth, else after a word; then the next one
    starts with the last ``repeat`` words once more, so that no phrase of one word more is lost."""
    data = data.translate(_PLAIN)
    at, seen = 0, 0
    while at < len(data) or not at:
        end = min(at + most, len(data))
        if end < len(data):
            stop = data.rfind(_BREAK, end - most // 10, end)
            if stop >= 0:
                end = stop + 1
            else:  # to the end of the word
                stops = [x for x in (data.find(b" ", end), data.find(_BREAK, end)) if x >= 0]
                end = min(stops, default=len(data))
        yield data[at - seen : at], data[at:end]
        if end >= len(data):
            return
        piece = data[max(data.rfind(_BREAK, at - seen, end) + 1, at - seen) : end]
        back = len(piece.rstrip(b" "))
        for _ in range(repeat):
            back = len(piece[:back].rstrip(b" "))
            back = piece.rfind(b" ", 0, back) + 1
        seen, at = len(piece) - back, end


def inverted(parts: list[tuple[bytes, bytes]]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, int]:
    """(words, lengths of their lists, lengths without words that an earlier block counts, places of one word after
    the other, how many words an earlier block counts) of texts' windows.

    Words of one piece have places that follow one another; place 0 and one between two pieces hold none. Only
    the first window may begin with words that an earlier block counts."""
    flat = [_BREAK, *_BREAK.join(a + b for a, b in parts).replace(_BREAK, b" \xff ").split()]
    again = len(parts[0][0].split())
    index = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    codes = np.fromiter(map(index.__getitem__, flat), np.int32, len(flat))
    order = np.argsort(codes, kind="stable").astype(np.int32)
    lengths = np.bincount(codes, minlength=len(index)).astype(np.int32)
    fresh = lengths - np.bincount(codes[: again + 1], minlength=len(index)).astype(np.int32)
    return list(index)[1:], lengths[1:], fresh[1:], order[lengths[0] :], again


def _lister(most: int, repeat: int):
    def row(lang: str, parts):
        words, *lists, again = inverted(parts)
        if words:
            held = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.array(words, pa.binary()).cast(pa.string()))
            numbers = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, pa.int32())) for x in lists]
            yield pa.RecordBatch.from_arrays([pa.array([lang]), held, *numbers, pa.array([again], pa.int32())], ["lang", "words", "lengths", "fresh", "places", "again"])

    def run(batches):
        held: dict[str, list] = {}
        size: dict[str, int] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lang, text in zip(langs, filled(batch.column("text")).cast(pa.binary())):
                data = text.as_buffer()
                for before, window in windows(data.to_pybytes() if data else b"", most, repeat):
                    if held.get(lang) and (before or size[lang] + len(window) > most):
                        size.pop(lang)
                        yield from row(lang, held.pop(lang))
                    held.setdefault(lang, []).append((before, window))
                    size[lang] = size.get(lang, 0) + len(window) + 1
                    if sum(size.values()) > 4 * most:  # many languages
                        size.pop(full := max(size, key=size.__getitem__))
                        yield from row(full, held.pop(full))
        for lang, parts in held.items():
            yield from row(lang, parts)

    return run


class Filter:
    """Bits of hashes; ``holds`` is true for every hash that was put in, and for some others."""

    def __init__(self, bits: int, bitmap: np.ndarray):
        self.bits, self.bitmap = bits, bitmap

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & np.uint64(self.bits - 1)
        return (self.bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode(), 42)


def _hashed(words: list[np.ndarray]) -> np.ndarray:
    """A phrase's hash from those of its words; that of one word is the word's own."""
    h = words[0]
    for w in words[1:]:
        h = mix(mix(h) + w * np.uint64(0x9E3779B97F4A7C15))
    return h


class Block:
    """One block's inverted lists, in which phrases grow."""

    def __init__(self, lang: str, words: pa.Array, lengths: np.ndarray, places: np.ndarray, again: int, filters: list[Filter]):
        """``filters``: of frequent words, pairs and so on, one for each size that is known."""
        self.words, self.again, self.filters = words, again, filters
        seed = _seed(lang)
        self.hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words.cast(pa.binary()).to_pylist()), np.uint64, len(words))
        keep = np.repeat(filters[0].holds(self.hashes), lengths)
        places, word = places[keep], np.repeat(np.arange(len(words), dtype=np.int32), lengths)[keep]
        order = np.argsort(places, kind="stable")
        self.place, self.word = places[order], word[order]

    def grown(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """(places, words) of each phrase of one word more than the filters know whose parts may all be frequent.

        Two lists of places in order are merged: phrases that stand at p, and those that stand at p + 1. Where
        they meet, the first is longer by the second's last word."""
        place, phrase = self.place, [self.word]
        for f in [None, *self.filters[1:]]:
            if f is not None:
                keep = f.holds(_hashed([self.hashes[w] for w in phrase]))
                place, phrase = place[keep], [w[keep] for w in phrase]
            at = np.flatnonzero(place[1:] == place[:-1] + 1)
            place, phrase = place[at], [*(w[at] for w in phrase), phrase[-1][at + 1]]
        return place, phrase

    def lengths(self) -> tuple[list[np.ndarray], np.ndarray]:
        """(words of each grown phrase, length of its list); one that ends in words of an earlier block counts there."""
        place, phrase = self.grown()
        fresh = place + len(phrase) - 1 > self.again
        phrase = [w[fresh].astype(np.int64) for w in phrase]
        n, key = len(self.words), phrase[0]
        for w in phrase[1:-1]:  # numbered anew, so that keys stay within 64 bits
            key = np.unique(key * n + w, return_inverse=True)[1]
        _, first, count = np.unique(key * n + phrase[-1], return_index=True, return_counts=True)
        return [w[first] for w in phrase], count


def _extender(filters_: list):
    def run(batches):
        filters = [f.value for f in filters_]
        for batch in batches:
            for i in range(batch.num_rows):
                words, lengths, places = (batch.column(k)[i].values for k in ("words", "lengths", "places"))
                lang = batch.column("lang")[i].as_py()
                phrase, count = Block(lang, words, lengths.to_numpy(), places.to_numpy(), batch.column("again")[i].as_py(), filters).lengths()
                for a in range(0, len(count), 1 << 16):
                    own = count[a : a + (1 << 16)]
                    joined = pc.binary_join_element_wise(*(words.take(pa.array(w[a : a + (1 << 16)])) for w in phrase), " ")
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), joined, pa.array(own, pa.int64())], ["lang", "phrase", "n"])

    return run


@F.pandas_udf(LongType())
def _phrase_hash(lang: pd.Series, phrase: pd.Series) -> pd.Series:
    seeds = {x: _seed(x) for x in lang.unique()}
    hashes = np.array([[xxhash.xxh64_intdigest(w.encode(), seeds[x]) for w in p.split(" ")] for x, p in zip(lang, phrase)], np.uint64)
    return pd.Series(_hashed(list(hashes.T)).view(np.int64) if len(hashes) else [], dtype="int64")


def _cell(table: pa.Table) -> pa.Table:
    mask = np.zeros(1 << 16, bool)
    mask[table["bit"].to_numpy()] = True
    return pa.table([table["cell"].combine_chunks().slice(0, 1), pa.array([np.packbits(mask, bitorder="little").tobytes()], pa.binary())], ["cell", "bits"])


def _filter(phrases: DataFrame) -> Filter:
    """The filter of a table's phrases: 16 bits for each, MOST_BITS at most. Its bits meet by cells of 8 KB."""
    bits = min(MOST_BITS, max(1 << 16, 1 << (16 * max(phrases.count(), 1) - 1).bit_length()))
    at = phrases.select(_phrase_hash("lang", "phrase").bitwiseAND(F.lit(bits - 1).cast("long")).alias("at"))
    cells = at.select(F.shiftright("at", 16).cast("int").alias("cell"), F.col("at").bitwiseAND(F.lit(0xFFFF).cast("long")).cast("int").alias("bit")).distinct()
    out = np.zeros(bits // 8, np.uint8)
    table = cells.groupBy("cell").applyInArrow(_cell, "cell int, bits binary").toArrow()
    for c, b in zip(table["cell"].to_pylist(), table["bits"].to_pylist()):
        out[c << 13 : (c + 1) << 13] = np.frombuffer(b, np.uint8)
    return Filter(bits, out)


def _blocks(rows: DataFrame, block: int, repeat: int) -> DataFrame:
    """The inverted lists of texts (lang, text), a row a block."""
    return cut(rows.mapInArrow(lean(_lister(block, repeat)), _LISTS), GROUP)


def frequent(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10, longest: int = 3, block: int = BLOCK) -> tuple[list[DataFrame], DataFrame]:
    """([words, pairs and so on up to ``longest`` words], totals): (lang, phrase, f) of all phrases that stand
    ``least`` times or more in a language, f exact; (lang, n), all words of a language."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    lists = _blocks(rows, block, longest - 1)
    total = cut(lists.select("lang", F.aggregate("fresh", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("lang").agg(F.sum("n").alias("n")))
    of_words = lists.select("lang", F.explode(F.arrays_zip("words", "fresh")).alias("x")).select("lang", F.col("x.words").alias("phrase"), F.col("x.fresh").cast("long").alias("n"))
    tables, filters = [], []
    for size in range(1, longest + 1):
        found = of_words if size == 1 else lists.mapInArrow(lean(_extender(filters)), "lang string, phrase string, n long")
        # a block gives a phrase once, so tasks have little to add up before they shuffle: phrases are dealt first
        dealt = found if size == 1 else found.repartition("lang", "phrase")
        tables.append(cut(dealt.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least)))
        if size < longest:
            filters = [*filters, spark.sparkContext.broadcast(_filter(tables[-1]))]
    drop_table(lists)
    return tables, total


def _first(k: int):
    return F.substring_index("phrase", " ", k)


def scored(tables: list[DataFrame]) -> list[DataFrame]:
    """(lang, phrase, a, l, r, score) of the phrases of two words, three and so on.

    Each cut into a first part of k words and the rest scores floor(10^6 a a / (l r)) in decimals of 38 digits, exact for counts
    under 10^15; the lowest score counts, of equal ones the smallest k."""
    made = []
    for size in range(2, len(tables) + 1):
        own = tables[size - 1].withColumnRenamed("f", "a")
        for k in range(1, size):
            left = tables[k - 1].select("lang", F.col("phrase").alias("__l"), F.col("f").alias(f"l{k}"))
            right = tables[size - k - 1].select("lang", F.col("phrase").alias("__r"), F.col("f").alias(f"r{k}"))
            own = own.withColumns({"__l": _first(k), "__r": _first(k - size)}).join(left, ["lang", "__l"]).join(right, ["lang", "__r"]).drop("__l", "__r")
        cuts = [F.struct(F.expr(f"(CAST(a AS DECIMAL(38,0)) * a * 1000000) div (CAST(l{k} AS DECIMAL(38,0)) * r{k})").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, size)]
        best = F.array_min(F.array(*cuts))
        made.append(own.select("lang", "phrase", "a", best.alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score"))
    return made


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10, longest: int = 3, contained: int = 50, keep: int = 2000, block: int = BLOCK) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``keep`` phrases of 2 to ``longest`` words by score, a (both
    falling) and phrase (by bytes).

    A-Z are taken as a-z; phrases don't cross ``[.,;:!?\x0A-\x0D]``; words are ``[^\x20\x09]+``. Candidates stand ``least`` times or more, l and r are the
    counts of the two parts of the cut with the lowest score, n all words of the language. Candidates inside a longer
    one go if that one stands ``contained`` percent as often or more, itself dropped or not. Null languages are ``und``,
    null texts empty; rows repeated count as often as they are there; other columns are not read. A table without
    frequent phrases gives no rows. Very long texts go in blocks of ``block`` bytes."""
    tables, total = frequent(docs, text_col, lang_col, least, longest, block)
    made = []
    for size, own in zip(range(2, longest + 1), scored(tables)):
        inside = None
        for more in range(size + 1, longest + 1):
            parts = [_first(i + size) if not i else F.substring_index(_first(i + size), " ", -size) for i in range(more - size + 1)]
            held = tables[more - 1].select("lang", F.explode(F.array(*parts)).alias("phrase"), F.col("f").alias("__most"))
            inside = held if inside is None else inside.unionByName(held)
        if inside is not None:
            own = own.join(inside.groupBy("lang", "phrase").agg(F.max("__most").alias("__most")), ["lang", "phrase"], "left")
            own = own.where(F.coalesce(100 * F.col("__most") < contained * F.col("a"), F.lit(True))).drop("__most")
        made.append(own)
    every = made[0]
    for own in made[1:]:
        every = every.unionByName(own)
    every = cut(every)
    # the first of each of many parts of a language, then the first of those: no task sorts a whole language
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = min(1024, every.count() // (4 * keep) + 1)
    some = every.withColumn("__part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    some = some.withColumn("__at", F.row_number().over(Window.partitionBy("lang", "__part").orderBy(*order))).where(F.col("__at") <= keep)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= keep)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
