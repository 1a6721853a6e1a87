"""Line dedup: two Bloom filters for once-seen and twice-seen line keys; only suspects are shuffled.

Pass 1 hashes each document's distinct line keys. Each task turns its keys into set bits of a blocked
Bloom filter, as (block, sorted bit places): once-seen and twice-seen. The filters of tasks add up by
block - a key that two tasks hold is in the intersection of their once-seen bits - so no filter of one
task is ever as large as the whole. Pass 2 asks the twice-seen filter for each line; lines it doesn't
know are unique and never move. Suspects are counted exactly by 128-bit digests of their keys."""

from __future__ import annotations

import hashlib
import math
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, filled, lean, portions

#: Bits of one block of the filter; all bits of a key lie in one block.
BLOCK_BITS = 1 << 16
#: Bits that a key sets.
PROBES = 4
#: The twice-seen filter, which is broadcast, has this many blocks at most: 32 MB. More keys only mean
#: more suspects, which the exact count then clears.
MOST_BLOCKS = 1 << 12
_STRIP = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    """The key of a line: stripped of ASCII white space, A-Z lower-cased."""
    return line.strip(_STRIP).lower()


def _hash(key: bytes) -> int:
    return xxhash.xxh3_64_intdigest(key)


def _is_key(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars)


def doc_hashes(text: bytes, min_chars: int) -> set[int]:
    return {_hash(k) for k in {line_key(x) for x in text.split(b"\n")} if _is_key(k, min_chars)}


def places(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each hash, and its PROBES bits there (n x PROBES)."""
    block = (hashes >> np.uint64(40)) % np.uint64(blocks)
    step = (hashes >> np.uint64(16)) | np.uint64(1)
    bits = (hashes[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) % np.uint64(BLOCK_BITS)
    return block.astype(np.int64), bits.astype(np.int64)


def _pack(bits: np.ndarray) -> bytes:
    """Distinct set bits of a block: as places while that is shorter, else as a bitmap."""
    if len(bits) * 2 < BLOCK_BITS // 8:
        return b"p" + bits.astype(np.uint16).tobytes()
    mask = np.zeros(BLOCK_BITS, bool)
    mask[bits] = True
    return b"m" + np.packbits(mask, bitorder="little").tobytes()


def _unpack(data: bytes) -> np.ndarray:
    mask = np.zeros(BLOCK_BITS, bool)
    if data[:1] == b"p":
        mask[np.frombuffer(data, np.uint16, offset=1)] = True
        return mask
    return np.unpackbits(np.frombuffer(data, np.uint8, offset=1), bitorder="little").astype(bool)


class _Sketch:
    """A task's two filters as bitmaps of fixed size, from hashes that come in portions.

    A key that is twice in a portion, or that all bits of the portions before it hold, is seen twice."""

    def __init__(self, blocks: int):
        self.blocks = blocks
        self.once, self.twice = (np.zeros(blocks * BLOCK_BITS // 8, np.uint8) for _ in range(2))

    def add(self, hashes: np.ndarray) -> None:
        own, count = np.unique(hashes, return_counts=True)
        block, bits = places(own, self.blocks)
        at, bit = block[:, None] * (BLOCK_BITS // 8) + (bits >> 3), np.uint8(1) << (bits & 7).astype(np.uint8)
        again = (self.once[at] & bit).astype(bool).all(axis=1) | (count > 1)
        np.bitwise_or.at(self.once, at.ravel(), bit.ravel())
        np.bitwise_or.at(self.twice, at[again].ravel(), bit[again].ravel())

    def rows(self):
        once, twice = (x.reshape(self.blocks, -1) for x in (self.once, self.twice))
        for b in np.flatnonzero(once.any(axis=1)).tolist():
            yield b, *(_pack(np.flatnonzero(np.unpackbits(x[b], bitorder="little"))) for x in (once, twice))


def _sketcher(blocks: int, min_chars: int):
    def run(batches):
        sketch = _Sketch(blocks)
        for batch in batches:
            for _, part in portions(filled(batch.column("text")), pa.binary()):
                found = [doc_hashes(text, min_chars) for text in part]
                sketch.add(np.fromiter(chain.from_iterable(found), np.uint64, sum(map(len, found))))
        rows = sketch.rows()
        while some := list(islice(rows, 256)):
            b, once, twice = zip(*some)
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array([0] * len(b), pa.int32()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], ["block", "part", "once", "twice"])

    return run


def _merge(table: pa.Table) -> pa.Table:
    """Add up filters of one block: what two of them hold once is held twice."""
    once, twice = np.zeros(BLOCK_BITS, bool), np.zeros(BLOCK_BITS, bool)
    for x, y in zip(table["once"].to_pylist(), table["twice"].to_pylist()):
        a, b = _unpack(x), _unpack(y)
        twice |= b | once & a
        once |= a
    bits = [pa.array([_pack(np.flatnonzero(m))], pa.binary()) for m in (once, twice)]
    return pa.table([table["block"].slice(0, 1), pa.array([0], pa.int32()), *bits], ["block", "part", "once", "twice"])


_SKETCH = "block long, part int, once binary, twice binary"


def twice_seen(sketches: DataFrame, blocks: int) -> np.ndarray:
    """The twice-seen filter of all sketches, as bytes; MOST_BLOCKS bound its size.

    Blocks are first added up in 16 parts each, by the task that made them, so a merge never holds more
    than a sixteenth of a block's sketches."""
    parts = sketches.withColumn("part", (F.spark_partition_id() % 16).cast("int"))
    merged = parts.groupBy("block", "part").applyInArrow(_merge, _SKETCH).groupBy("block").applyInArrow(_merge, _SKETCH)
    out = np.zeros((blocks, BLOCK_BITS // 8), np.uint8)
    table = merged.select("block", "twice").toArrow()
    for b, t in zip(table["block"].to_pylist(), table["twice"].to_pylist()):
        out[b] = np.packbits(_unpack(t), bitorder="little")
    return out.ravel()


def asked(bitmap: np.ndarray, hashes: np.ndarray, blocks: int) -> np.ndarray:
    """For each hash: does the filter (bytes of all blocks) hold it?"""
    block, bits = places(hashes, blocks)
    at = block[:, None] * (BLOCK_BITS // 8) + (bits >> 3)
    return ((bitmap[at] >> (bits & 7).astype(np.uint8)) & 1).all(axis=1)


def _suspects(filter_, blocks: int, min_chars: int):
    def run(batches):
        for batch in batches:
            for first, part in portions(filled(batch.column("text")), pa.binary()):
                rows, line_no, keys = [], [], []
                for row, text in enumerate(part, first):
                    for i, k in enumerate(map(line_key, text.split(b"\n"))):
                        if _is_key(k, min_chars):
                            rows.append(row)
                            line_no.append(i)
                            keys.append(k)
                if not keys:
                    continue
                hit = np.flatnonzero(asked(filter_.value, np.fromiter(map(_hash, keys), np.uint64, len(keys)), blocks))
                at = pa.array(np.array(rows, np.int64)[hit])
                digests = pa.array([hashlib.blake2b(keys[i], digest_size=16).digest() for i in hit.tolist()], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("th").take(at), pa.array(np.array(line_no, np.int32)[hit]), digests], ["doc_id", "th", "line_no", "key"])

    return run


def drop_frequent_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_documents: int = 10, min_chars: int = 1, expected_lines: int | None = None) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept): each text without the lines whose key is in ``min_documents`` documents or more.

    A key is the line stripped of ASCII white space and with A-Z lower-cased; keys shorter than
    ``min_chars`` code points never count. A document holds a key once, however often it repeats there.
    Null and empty texts have one empty line. A row with a null id, and each of several rows with one
    id and different texts, is a document of its own; rows repeated whole are one document that returns as often as it
    is there. Lines that stay are joined by a newline; if none stay, ``kept`` is empty. Other columns are not read."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("th", F.xxhash64("text"))
    gone = _gone(docs, id_col, text_col, min_documents, min_chars, expected_lines)
    joined = keyed.join(gone, F.col("doc_id").eqNullSafe(F.col("__line_id")) & (F.col("th") == F.col("__line_th")), "left")
    return joined.select("doc_id", *_outcome(F.col("text")))


def _gone(docs: DataFrame, id_col: str, text_col: str, min_documents: int, min_chars: int = 1, expected_lines: int | None = None) -> DataFrame:
    """(_id, _th, gone): the numbers of the lines to drop from the documents that lose any."""
    if min_documents < 2:
        raise ValueError("a line found in one document is no repeat")
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    if expected_lines is None:
        expected_lines = rows.agg(F.sum(F.length("text"))).first()[0] or 1
        expected_lines //= 64
    blocks = min(MOST_BLOCKS, 1 << max(0, math.ceil(math.log2(max(1, expected_lines * PROBES * 2 / BLOCK_BITS)))))
    found = twice_seen(rows.select("text").mapInArrow(lean(_sketcher(blocks, min_chars)), _SKETCH), blocks)
    filter_ = spark.sparkContext.broadcast(found)
    keyed = rows.withColumn("th", F.xxhash64("text"))
    suspects = cut(keyed.mapInArrow(lean(_suspects(filter_, blocks, min_chars)), "doc_id long, th long, line_no int, key binary"))
    # an exact count of documents, by key: once per document, then summed
    per_doc = suspects.groupBy("doc_id", "th", "key").agg(F.lit(1).alias("one"))
    # written out, so that the join reads plain tables on both sides and Spark can split a frequent key
    frequent = cut(per_doc.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= min_documents).select("key"))
    gone = suspects.join(frequent, "key").groupBy("doc_id", "th").agg(F.collect_set("line_no").alias("__gone"))
    return gone.select(F.col("doc_id").alias("__line_id"), F.col("th").alias("__line_th"), "__gone")


def _outcome(text):
    """n_lines, n_dropped and kept, from a text and its column ``__gone`` of line numbers."""
    left = F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(F.col("__gone"), i))
    kept = F.when(F.col("__gone").isNull(), text).otherwise(F.array_join(left, "\n"))
    n = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return n.cast("long").alias("n_lines"), F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept")


def rewrite(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_chars", **how) -> DataFrame:
    """``docs`` with every column, the text without frequent lines, and its code points counted anew
    where the table has a column for that. Null texts stay null if nothing is there to drop."""
    gone = _gone(docs, id_col, text_col, **how)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    match = F.col(id_col).cast("long").eqNullSafe(F.col("__line_id")) & (F.xxhash64(text) == F.col("__line_th"))
    new = docs.join(gone, match, "left").withColumn(text_col, F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(_outcome(text)[2]))
    if count_col in docs.columns:
        new = new.withColumn(count_col, F.when(F.col("__gone").isNull(), F.col(count_col)).otherwise(F.length(text_col)).cast(docs.schema[count_col].dataType))
    return new.select(*[F.col(f"`{c}`") for c in docs.columns])
