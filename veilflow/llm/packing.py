"""Best-fit packing of tokenised documents into sequences, certified by dual-feasible bounds.

Documents become pieces of at most ``capacity`` tokens. Pieces are dealt to partitions and each packs its
own by best-fit decreasing. Dual-feasible functions bound how few bins a partition's pieces can take. A
partition that meets its bound is certified and closes; one with a gap gives bins up, the emptiest
first and GIVE pieces at most. Partitions exchange these in groups and pack them anew, round by round, until
one partition is left. Closed bins never move again, and a partition of a later round holds FAN_IN * GIVE
pieces at most, so what travels is bounded whatever the lengths are."""

from __future__ import annotations

import json
import math
import os
import re
import unicodedata
import zlib
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_table, filled, hashed, lean, mix, portions

#: Pieces that one partition packs at first, partitions that exchange in a round, and pieces that each gives.
PIECES, FAN_IN, GIVE = 1 << 14, 16, 1 << 10
#: Words that a task remembers the ids of, and characters of a text that are worked on at once.
REMEMBERED, WINDOW = 500_000, 1 << 20
_LETTER, _NUMBER, _MARK, _SPACE, _UNSURE = range(5)
#: Code points that most texts stay below; tables for all others are made when one is met.
_LOW = 0x2000
_GAP = re.compile(r"(?<=\S) (?=\S)")


def _kind(point: int) -> int:
    """What the split rule of byte-level tokenizers takes a character for: letter, number, white space or other.

    A character that the Unicode versions of 2002 and of today tell apart is unsure: a tokenizer's own
    tables may hold with either."""

    def of(category: str) -> int:
        return {"L": _LETTER, "N": _NUMBER, "Z": _SPACE}.get(category[0], _MARK)

    if 9 <= point <= 13 or point == 0x85:
        return _SPACE
    now, then = of(unicodedata.category(chr(point))), of(unicodedata.ucd_3_2_0.category(chr(point)))
    return now if now == then else _UNSURE


@cache
def _tables(most: int) -> tuple[np.ndarray, np.ndarray]:
    """Kind and random key of each code point below ``most``."""
    keys = mix(np.arange(most, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019))
    return np.fromiter(map(_kind, range(most)), np.uint8, most), keys


def word_starts(points: np.ndarray, kinds: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which characters begin a word, in texts that lie end to end (``places``: where each begins, and the end).

    The rule: a contraction ('s 't 'm 'd 're 've 'll), or a run of letters, of numbers or of others, with
    the one space before it, or white space up to the last before a word."""
    n = len(points)
    start = np.ones(n + 1, bool)
    start[1:n] = kinds[1:] != kinds[:-1]
    head = np.zeros(n + 1, bool)
    head[places] = True
    start |= head
    space = kinds == _SPACE
    before = np.zeros(n, bool)  # white space right before a word of the same text
    before[:-1] = space[:-1] & ~space[1:] & ~head[1:n]
    start[:n] |= before
    joined = np.flatnonzero(before & (points == 32))
    start[joined + 1] = False
    quote = np.flatnonzero((points == 39) & start[:n])
    if len(quote):
        inside = np.searchsorted(places, quote, "right")
        left = places[inside] - quote  # characters to the end of the text
        one, two = points[np.minimum(quote + 1, n - 1)], points[np.minimum(quote + 2, n - 1)]
        short = (left > 1) & np.isin(one, [115, 116, 109, 100])
        long = (left > 2) & (((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108))
        hit = short | long
        start[quote[hit] + 1] = False
        start[quote[hit] + np.where(short, 2, 3)[hit]] = True
    return start[:n]


class Encoder:
    """Token ids of texts. Tokenizers of the byte-level family work on each word by itself, so words are told
    by hashes in whole portions, compared, encoded once and remembered; other texts and tokenizers go as wholes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        spec = json.loads(self.tok.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.by_word = not spec.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.added = [t["content"] for t in spec.get("added_tokens", ())]
        self.keys, self.spelt, self.flat = np.zeros(0, np.uint64), np.zeros(0, object), np.zeros(0, np.uint32)
        self.at, self.size, self.used = (np.zeros(0, np.int64) for _ in range(3))
        self.time = 0

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, words: np.ndarray, keys: np.ndarray) -> None:
        """Remember more words (their hashes sorted); beyond REMEMBERED those that were not met for longest are forgotten."""
        if len(self.keys) > REMEMBERED:
            keep = self.used > np.partition(self.used, len(self.used) // 2)[len(self.used) // 2]
            keep |= self.used == self.time
            size, at = self.size[keep], self.at[keep]
            self.flat = self.flat[_ranges(at, size)]
            self.keys, self.spelt, self.used, self.size, self.at = self.keys[keep], self.spelt[keep], self.used[keep], size, np.cumsum(size) - size
        found = [e.ids for i in range(0, len(words), 10_000) for e in self.tok.encode_batch_fast(words[i : i + 10_000].tolist(), add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        at = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum()))])
        place = np.searchsorted(self.keys, keys)
        self.keys, self.spelt, self.at, self.size, self.used = (np.insert(x, place, y) for x, y in ((self.keys, keys), (self.spelt, words), (self.at, at), (self.size, size), (self.used, self.time)))

    def _words(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of texts of known characters, the places of each text's ids, and whether a text had others (its ids don't count)."""
        joined = "".join(chunks)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        places = np.r_[0, np.cumsum([len(c) for c in chunks])]
        kinds, keys = _tables(_LOW if not len(points) or int(points.max()) < _LOW else 0x110000)
        kinds = kinds[points]
        unsure = np.zeros(len(chunks), bool)
        if (kinds == _UNSURE).any():
            unsure[np.searchsorted(places, np.flatnonzero(kinds == _UNSURE), "right") - 1] = True
        first = np.flatnonzero(word_starts(points, kinds, places))
        last = np.r_[first[1:], len(points)] if len(first) else first
        own, example, which = np.unique(hashed(keys[points], first, last), return_index=True, return_inverse=True)
        spelt = np.array([joined[a:b] for a, b in zip(first[example].tolist(), last[example].tolist())], object)
        self.time += 1
        at = np.minimum(np.searchsorted(self.keys, own), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[at] != own) if len(self.keys) else np.arange(len(own))
        if len(new):
            if len(self.keys):
                self.used[at[self.keys[at] == own]] = self.time
            self._learn(spelt[new], own[new])
            at = np.searchsorted(self.keys, own)
        self.used[at] = self.time
        # equal hashes of different words: their texts go as wholes
        other = (self.spelt[at] != spelt)[which] | _differ(points, first, last - first, example[which])
        unsure[np.searchsorted(places, first[other], "right") - 1] = True
        place = at[which]
        size = self.size[place]
        ends = np.r_[0, np.cumsum(size)]
        return self.flat[_ranges(self.at[place], size)], ends[np.searchsorted(first, places)], unsure

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as the tokenizer gives them with add_special_tokens=False."""
        plain = [self.by_word and not any(a in t for a in self.added) for t in texts]
        out: list = [None] * len(texts)
        held, owner, size = [], [], 0

        def flush() -> None:
            if not held:
                return
            ids, places, unsure = self._words(held)
            for i, own in enumerate(owner):
                if unsure[i]:
                    plain[own] = False
                else:
                    out[own] = (out[own] or []) + [ids[places[i] : places[i + 1]]]
            held.clear()
            owner.clear()

        for i, text in enumerate(texts):
            for chunk in windows(text, WINDOW) if plain[i] else ():
                held.append(chunk)
                owner.append(i)
                size += len(chunk)
                if size > WINDOW:
                    flush()
                    size = 0
        flush()
        return [np.concatenate(got) if ok else self._whole(t) for t, got, ok in zip(texts, out, plain)]


def _differ(points: np.ndarray, first: np.ndarray, size: np.ndarray, example: np.ndarray) -> np.ndarray:
    """Which words (first place, size) aren't the same characters as the words that stand for them."""
    out = size != size[example]
    same = np.flatnonzero(~out)
    if len(same):
        unlike = points[_ranges(first[same], size[same])] != points[_ranges(first[example[same]], size[same])]
        out[same] = np.logical_or.reduceat(unlike, np.cumsum(size[same]) - size[same])
    return out


def _ranges(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indexes at, at + 1, ... of each range, one after another."""
    ends = np.cumsum(size)
    return np.repeat(at - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


def windows(text: str, most: int):
    """A text in parts of about ``most`` characters, cut before single spaces between words, where a word begins in any case."""
    at = 0
    while len(text) - at > most:
        gap = _GAP.search(text, at + most)
        if not gap:
            break
        yield text[at : gap.start()]
        at = gap.start()
    yield text[at:] if at else text


@cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def token_ids(texts: list[str], path: str) -> list[bytes]:
    """Little-endian 32-bit ids of each text."""
    return [ids.astype("<u4").tobytes() for ids in _encoder(path).encode(texts)]


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole ones but for the first, which takes the rest."""
    head = n % capacity or capacity
    return [(0, head)] + [(at, capacity) for at in range(head, n, capacity)] if n else []


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(path: str, capacity: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for at, texts in portions(filled(batch.column("text")), pa.string()):
                for row, ids in enumerate(token_ids(texts, path), at):
                    view = memoryview(ids + end)
                    for k, (a, n) in enumerate(cut_points(len(view) // 4, capacity)):
                        rows.append(row)
                        piece.append(k)
                        start.append(a)
                        length.append(n)
                        crc.append(zlib.crc32(view[4 * a : 4 * (a + n)]))
            ids = batch.column("doc_id").take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of each document: doc_id, piece, start, length, ids_crc32."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(_pieces(tokenizer, capacity, end_id)), _PIECE)


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item: longest first, each into the fullest bin that still has room."""
    where = np.empty(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fits = mask >> need
        if fits:
            r = need + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask ^= 1 << r
        else:
            r, b, bins = capacity, bins, bins + 1
        where[i] = b
        if r > need:
            room[r - need].append(b)
            mask |= 1 << (r - need)
    return where


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Fewest bins for ``lengths`` (1 to capacity), as far as two families of dual-feasible functions tell.

    Both map item sizes so that what fits a bin still sums to one at most: small items to nothing and
    large ones to whole bins, at each threshold; and sizes rounded down to k-ths, for small k."""
    if not len(lengths):
        return 0
    h = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    mass, count = np.cumsum(h * size), np.cumsum(h)
    best = -(-int(mass[-1]) // capacity)
    eps = np.arange(0, capacity // 2 + 1)
    middle = mass[capacity - eps] - np.where(eps > 0, mass[eps - 1], 0)
    large = count[-1] - count[capacity - eps]
    best = max(best, int((large - (-middle // capacity)).max()))
    for k in range(1, 33):
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, k * size, (scaled // capacity) * capacity)  # times k * capacity
        best = max(best, -(-int((h * value).sum()) // (k * capacity)))
    return best


def given_up(lengths: np.ndarray, where: np.ndarray, capacity: int, least: int) -> np.ndarray:
    """Which bins of a partition travel on, from the emptiest; GIVE pieces bound them.

    ``least`` is the smallest piece of the table: a bin with less room has nothing to gain. A partition with a
    gap to its bound gives bins that aren't full. One that meets its bound is certified and closes, but
    for bins under 63/64 full, which what others hold may fill."""
    fill = np.bincount(where, weights=lengths).astype(np.int64)
    gap = len(fill) > lower_bound(lengths, capacity)
    open_ = fill < (capacity if gap else capacity * 63 // 64)
    open_ &= capacity - fill >= least
    order = np.flatnonzero(open_)[np.argsort(fill[open_], kind="stable")]
    out = np.zeros(len(fill), bool)
    out[order[np.cumsum(np.bincount(where)[order]) <= GIVE]] = True
    return out


def _pack(capacity: int, last: bool, round_: int, least: int):
    def run(key, table):
        length = table["length"].to_numpy().astype(np.int64)
        where = best_fit(length, capacity)
        fill = np.bincount(where, weights=length).astype(np.int64)
        open_ = np.zeros(len(fill), bool) if last else given_up(length, where, capacity, least)
        order = np.argsort(where, kind="stable")
        ends = np.cumsum(length[order])
        offset = np.empty(len(length), np.int64)
        starts = np.r_[0, np.cumsum(fill)[:-1]]
        offset[order] = ends - length[order] - starts[where[order]]
        sequence = (round_ << 58) + (int(key[0].as_py()) << 24) + where
        out = table.drop_columns(["part"]).append_column("part", table["part"])
        return out.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset)).append_column("open", pa.array(open_[where]))

    return run


def pack(items: DataFrame, capacity: int = 2048) -> DataFrame:
    """``items`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    Pieces of one sequence fill it from 0 without gaps. Lengths must be 1 to ``capacity``. Rows are dealt by
    a hash of the row and its place in the written table, so rows alike in all columns spread as well."""
    items = cut(items)
    n, least = items.agg(F.count("*"), F.min("length")).first()
    parts = max(1, math.ceil(n / PIECES))
    keys = [c for c in items.columns]
    live = items.withColumn("part", F.pmod(F.xxhash64(*keys, F.monotonically_increasing_id()), F.lit(parts)))
    closed, round_ = [], 0
    schema = _PIECE + ", part long, sequence_id long, offset long, open boolean"
    while True:
        last = parts == 1
        packed = cut(live.groupBy("part").applyInArrow(_pack(capacity, last, round_, least), schema))
        if not round_:
            drop_table(items)
        closed.append(packed.where("not open"))
        if last:
            break
        parts = -(-parts // FAN_IN)
        live = packed.where("open").select(*keys, (F.col("part") % parts).alias("part"))
        round_ += 1
    out = closed[0]
    for more in closed[1:]:
        out = out.unionByName(more)
    return out.select(*keys, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise and pack: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Each document is its ids, as the tokenizer gives them with add_special_tokens=False (a special token's
    string in a text is that token), and then ``end_id``; null and empty texts have the end alone. Only documents
    longer than ``capacity`` are cut; all their pieces but the first are whole sequences. Rows with a null
    or repeated id are packed like any other. An empty table gives no rows. Other columns are not read."""
    return pack(pieces(docs, tokenizer, capacity, end_id, id_col, text_col), capacity)
