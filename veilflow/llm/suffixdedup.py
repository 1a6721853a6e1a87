"""Suffix-array dedup: remove every byte that a repeated string of ``min_bytes`` bytes covers, exactly.

One suffix array of a whole corpus would be one task's work, so strings meet in shards first. In each
window of ``min_bytes`` bytes the anchor is the place with the least hash of the ANCHOR bytes from there;
windows in a row with one anchor are a run. Equal windows have equal anchors at equal places, so only
runs whose anchor is found twice can hold repeats, and runs of one anchor go to one shard. A run's bytes
travel once for all places where the whole run is found, and anchors with too many different runs are
split by where the anchor lies in the window, with a longer common core as the new anchor.

A shard sorts its suffixes and finds which share ``min_bytes`` bytes by threshold-bounded interval expansion:
intervals of suffixes with a common prefix are extended backward over the Burrows-Wheeler transform,
eight symbols a level and all intervals of a level together, so common prefixes come by increasing
length, and it stops at the minimum length or when no interval holds two suffixes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_KEYS, cut, drop_table, filled, lean, mix, powers, steps, text_bytes

#: Bytes of an anchor; bytes of a shard's text; bytes of different runs that one anchor may bring to a shard.
ANCHOR, SHARD_BYTES, MOST_BYTES = 32, 1 << 19, 1 << 23
_HALF = np.uint64(32)


def runs_of(data: np.ndarray, places: np.ndarray, min_bytes: int):
    """Runs of texts laid end to end: text, first window, last window, anchor place (all in ``data``), anchor
    hash, hash of all bytes of the run's windows."""
    n, w = len(data), min_bytes - ANCHOR + 1
    none = tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),) * 2
    if n < min_bytes:
        return none
    up, down = powers(n)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(BYTE_KEYS[data] * up, dtype=np.uint64, out=sums[1:])

    def hash_of(a, b):
        return mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))

    m = n - ANCHOR + 1
    gram = mix((sums[ANCHOR:] - sums[:m]) * down[:m] + np.uint64(ANCHOR))
    # half of the hash decides and then the place, in a batch of any size: equal windows choose alike
    packed = (gram >> _HALF << _HALF) | np.arange(m, dtype=np.uint64)
    blocks = -(-m // w) + 1
    padded = np.full(blocks * w, np.iinfo(np.uint64).max)
    padded[:m] = packed
    grid = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - min_bytes + 1
    least = np.minimum(behind[:starts], ahead[w - 1 : w - 1 + starts])
    anchor = (least & np.uint64((1 << 32) - 1)).astype(np.int64)
    valid = np.zeros(starts + 1, np.int8)
    ok = np.diff(places) >= min_bytes
    np.add.at(valid, places[:-1][ok], 1)
    np.add.at(valid, np.minimum(places[1:][ok] - min_bytes + 1, starts), -1)
    at = np.flatnonzero(np.cumsum(valid[:-1]))
    if not len(at):
        return none
    own = anchor[at]
    new = np.r_[True, (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)]
    first, last = at[new], at[np.r_[np.flatnonzero(new)[1:] - 1, len(at) - 1]]
    a = own[new]
    text = np.searchsorted(places, first, "right") - 1
    return text, first, last, a, gram[a], hash_of(first, last + min_bytes)


_RUN = "doc_id long, th long, start int, size int, anchor_at int, a long, u long"


def _run_task(min_bytes: int):
    def run(batches):
        for batch in batches:
            texts = filled(batch.column("text"))
            for x, y in steps(texts):
                data, places = text_bytes(texts.slice(x, y - x))
                text, first, last, at, a, u = runs_of(data, places, min_bytes)
                if len(text):
                    rows = pa.array(text + x)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(rows), batch.column("th").take(rows), pa.array((first - places[text]).astype(np.int32)), pa.array((last - first + min_bytes).astype(np.int32)), pa.array((at - first).astype(np.int32)), pa.array(a.view(np.int64)), pa.array(u.view(np.int64))],
                        ["doc_id", "th", "start", "size", "anchor_at", "a", "u"],
                    )

    return run


_SEGMENT = "a long, u long, copies long, anchor_at int, low int, high int, p int, g long, data binary"


def _cut_segments(min_bytes: int):
    """Bytes of the runs that are to be taken from each text."""

    def run(batches):
        for batch in batches:
            rows = []
            for text, wanted in zip(filled(batch.column("text")).cast(pa.binary()).to_pylist(), batch.column("wanted").to_pylist()):
                rows += [(r["a"], r["u"], r["copies"], r["anchor_at"], 0, min_bytes - ANCHOR, 0, r["a"], text[r["start"] : r["start"] + r["size"]]) for r in wanted]
            yield _segments(rows)

    return run


def _segments(rows: list) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 9
    kinds = [pa.int64()] * 3 + [pa.int32()] * 4 + [pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["a", "u", "copies", "anchor_at", "low", "high", "p", "g", "data"])


def halves(row: dict, min_bytes: int) -> list[tuple]:
    """A segment's windows in two halves, by the place of the anchor in the window. All windows of a half
    share a core of bytes around the anchor, which is the half's new group."""
    out, middle = [], (row["low"] + row["high"]) // 2
    at = row["anchor_at"] - row["p"]  # in data, which starts at window p of the run
    for low, high in ((row["low"], middle), (middle + 1, row["high"])):
        first, last = max(at - high, 0), min(at - low, len(row["data"]) - min_bytes)
        if low > high or first > last:
            continue
        core = row["data"][at - low : at - high + min_bytes]
        group = hashlib.blake2b(core + b"%d:%d" % (low, high), digest_size=8).digest()
        out.append((row["a"], row["u"], row["copies"], row["anchor_at"], low, high, row["p"] + first, int.from_bytes(group, "little", signed=True), row["data"][first : last + min_bytes]))
    return out


def _halve(min_bytes: int):
    def run(batches):
        for batch in batches:
            yield _segments([x for row in batch.to_pylist() for x in halves(row, min_bytes)])

    return run


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of ``data`` sorted by their next bytes, to ``depth`` or more; their ranks; and the eight
    bytes from each place on as one number (zeros follow the end)."""
    n = len(data)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = data
    eight = np.zeros(n, np.uint64)
    for k in range(8):
        eight |= padded[k : n + k] << np.uint64(56 - 8 * k)
    order = np.argsort(eight)
    key, reach = eight, 8
    fold = 3 if n < 1 << 21 else 2  # ranks that fit one number: prefixes grow threefold or twofold
    bits = 63 // fold
    while True:
        own = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[False, own[1:] != own[:-1]])
        if reach >= depth or int(rank[order[-1]]) == n - 1:
            break
        key = rank.copy()
        for k in range(1, fold):
            key <<= bits
            key[: max(n - k * reach, 0)] |= rank[k * reach :] + 1
        order = np.argsort(key)
        reach *= fold
    rank[order] = np.arange(n)
    return order, rank, eight


def expand(order: np.ndarray, rank: np.ndarray, eight: np.ndarray, depth: int) -> np.ndarray:
    """Interval number of each suffix, in sorted order, once intervals share ``depth`` bytes.

    ``after[k]`` is where the suffix lies that starts eight places after the k-th: the k-th suffix belongs to
    the interval that extends ``after[k]``'s backward by the symbols eight[k]. Sorted suffixes stay sorted under
    extension, so an interval ends where either differs from the neighbour's."""
    n = len(order)

    def behind(step: int):
        place = order + step
        return np.where(place < n, rank[np.minimum(place, n - 1)], n)

    symbols, after = eight[order], behind(8)
    ids = np.zeros(n + 1, np.int32)  # the last for what lies behind the text: all share the empty prefix
    length = 0
    while length < depth:
        step = min(8, depth - length)
        if step < 8:
            symbols, after = symbols >> np.uint64(64 - 8 * step), behind(step)
        came = ids[after]
        new = (symbols[1:] != symbols[:-1]) | (came[1:] != came[:-1])
        if new.all():  # no interval holds two suffixes
            return np.arange(n)
        np.cumsum(new, dtype=np.int32, out=ids[1:n])
        ids[n] = -1
        length += step
    return ids[:n]


def repeated_windows(segments: list[tuple[bytes, int]], min_bytes: int) -> list[np.ndarray]:
    """For each (bytes, copies): which of its windows (their first bytes) are found elsewhere too. A suffix
    counts as often as its segment is there, so the text holds each segment once."""
    sizes = np.array([len(data) for data, _ in segments])
    first = np.r_[0, np.cumsum(sizes)]
    data = np.frombuffer(b"".join(data for data, _ in segments), np.uint8)
    order, rank, eight = suffix_array(data, min_bytes)
    ids = expand(order, rank, eight, min_bytes)
    by_place = np.empty(len(data), np.int32)
    by_place[order] = ids
    inside = np.ones(len(data), bool)  # windows that end within their segment
    for e in first[1:]:
        inside[e - min_bytes + 1 : e] = False
    weight = np.repeat(np.array([copies for _, copies in segments], np.float64), sizes) * inside
    count = np.bincount(by_place, weights=weight, minlength=len(data))
    again = inside & (count[by_place] > 1.5)
    return [np.flatnonzero(again[x:y]) for x, y in zip(first, first[1:])]


def spans(starts: np.ndarray, size: int) -> list[tuple[int, int]]:
    """What windows of one size cover, from their sorted first bytes: maximal (first, end)."""
    if not len(starts):
        return []
    new = np.flatnonzero(np.r_[True, starts[1:] > starts[:-1] + size])
    return list(zip(starts[new].tolist(), (starts[np.r_[new[1:] - 1, len(starts) - 1]] + size).tolist()))


def _shard(min_bytes: int):
    def run(key, table):
        rows = table.select(["a", "u", "copies", "p", "data"]).to_pylist()
        found = repeated_windows([(r["data"], r["copies"]) for r in rows], min_bytes)
        out = [(r["a"], r["u"], r["p"] + x, r["p"] + y) for r, f in zip(rows, found) for x, y in spans(f, min_bytes)]
        columns = list(zip(*out)) or [()] * 4
        return pa.table([pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.int64(), pa.int32(), pa.int32()])], ["a", "u", "x", "y"])

    return run


def merged(ranges: list) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching (first, end)."""
    out: list[list[int]] = []
    for x, y in sorted(ranges):
        if out and x <= out[-1][1]:
            out[-1][1] = max(out[-1][1], y)
        else:
            out.append([x, y])
    return [(x, y) for x, y in out]


def _apply(batches):
    for batch in batches:
        rows = []
        texts = filled(batch.column("text")).cast(pa.binary()).to_pylist()
        for text, ranges in zip(texts, batch.column("ranges").to_pylist()):
            gone = merged([(r["x"], r["y"]) for r in ranges or ()])
            kept, at = [], 0
            for x, y in gone:
                kept.append(text[at:x])
                at = y
            kept = b"".join([*kept, text[at:]])
            rows.append((len(text), len(text) - len(kept), len(gone), hashlib.sha256(kept).hexdigest()))
        columns = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 3 + [pa.string()]))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_ranges(rows: DataFrame, min_bytes: int = 200, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(doc_id, th, x, y): byte ranges to remove, from (doc_id, th, text), th a hash of the text."""
    runs = cut(rows.mapInArrow(lean(_run_task(min_bytes)), _RUN))
    # written out, so that the join reads plain tables on both sides and Spark can split a frequent anchor
    twice = cut(runs.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a"))
    live = cut(runs.join(twice, "a", "left_semi"))
    drop_table(runs)
    drop_table(twice)
    place = F.struct("doc_id", "th", "start", "size", "anchor_at")
    groups = live.groupBy("a", "u").agg(F.count("*").alias("copies"), F.min(place).alias("at"))
    taken = groups.select(F.col("at.doc_id").alias("_id"), F.col("at.th").alias("_th"), F.struct("a", "u", "copies", "at.start", "at.size", "at.anchor_at").alias("w"))
    wanted = taken.groupBy("_id", "_th").agg(F.collect_list("w").alias("wanted"))
    own = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))
    texts = rows.join(wanted, own).select("text", "wanted")
    segments = cut(texts.mapInArrow(lean(_cut_segments(min_bytes)), _SEGMENT))
    group, ready, repeats, used = ["g", "low", "high"], [], [], []
    while True:
        sums = segments.groupBy(*group).agg(F.sum(F.length("data")).alias("bytes"), F.sum("copies").alias("n"))
        # a group that is found once holds no repeat; the first groups, by anchor, all are found twice
        if used:
            segments = segments.join(sums.where("n > 1").select(*group), group)
            # all segments of a group that can't be halved are one window: it repeats, and nothing need be sorted
            repeats.append(segments.where("low = high").select("a", "u", F.col("p").alias("x"), (F.col("p") + min_bytes).alias("y")))
            segments = segments.where("low < high")
        large = cut(sums.where((F.col("bytes") > most_bytes) & (F.col("low") < F.col("high")) & (F.col("n") > 1)).select(*group))
        if not large.limit(1).count():
            ready.append(segments)
            break
        ready.append(segments.join(large, group, "left_anti"))
        used.append(segments)
        segments = cut(segments.join(large, group, "left_semi").mapInArrow(lean(_halve(min_bytes)), _SEGMENT))
    all_ = ready[0]
    for more in ready[1:]:
        all_ = all_.unionByName(more.select(*all_.columns))
    total = all_.agg(F.sum(F.length("data"))).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    sharded = all_.withColumn("shard", F.pmod(F.xxhash64(*group), F.lit(shards)))
    found = sharded.groupBy("shard").applyInArrow(_shard(min_bytes), "a long, u long, x int, y int")
    for more in repeats:
        found = found.unionByName(more.select("a", "u", F.col("x").cast("int"), F.col("y").cast("int")))
    found = cut(found)
    covered = cut(found.groupBy("a", "u").agg(F.collect_set(F.struct("x", "y")).alias("r")))
    for table in (segments, found, *used):
        drop_table(table)
    each = live.join(covered, ["a", "u"]).select("doc_id", "th", "start", F.explode("r").alias("r"))
    return each.select("doc_id", "th", (F.col("start") + F.col("r.x")).alias("x"), (F.col("start") + F.col("r.y")).alias("y"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = 200, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of ``docs``.

    A byte goes if a string of ``min_bytes`` bytes that covers it also starts anywhere else, in the same text or another;
    strings do not reach across texts and are judged on the input. Null texts are empty. Rows that repeat,
    with or without an id, are texts of their own, so long ones go as wholes. An empty table gives no rows. Other columns are
    not read. ``min_bytes`` is at least ANCHOR."""
    if min_bytes < ANCHOR:
        raise ValueError(f"min_bytes is {ANCHOR} at least")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("th", F.xxhash64("text"))
    ranges = repeated_ranges(rows, min_bytes, most_bytes).groupBy("doc_id", "th").agg(F.collect_set(F.struct("x", "y")).alias("ranges"))
    ranges = ranges.withColumnsRenamed({"doc_id": "_id", "th": "_th"})
    joined = rows.join(ranges, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left")
    return joined.select("doc_id", "text", "ranges").mapInArrow(lean(_apply), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
