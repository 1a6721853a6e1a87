"""SimHash near-dedup: fingerprints of 3-word shingles, multi-index Hamming search, components."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType

from . import minhash
from .common import cut, few, filled, lean, portions
from .graph import components

#: Fingerprints that may have one value in a segment before it is split.
HOT = 1000


def fingerprint(text: bytes, width: int = 3) -> int:
    """64-bit SimHash of a text: shingles of ``width`` words, repeats included, hashed by XXH64 (seed 42)."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    n = max(1, len(tokens) - width + 1)
    joined = b" ".join(tokens)
    digest, ends = xxhash.xxh64_intdigest, list(accumulate([len(t) + 1 for t in tokens]))
    starts = [0, *ends]
    ends = [e - 1 for e in ends[min(width, len(tokens)) - 1 :]]
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)])], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(width: int):
    def run(batches):
        for batch in batches:
            found = [fingerprint(t, width) for _, part in portions(filled(batch.column("text")), pa.binary()) for t in part]
            prints = np.array(found, np.uint64).view(np.int64)
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(prints)], [*names, "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """One (doc_id, fp) per row; fp holds the 64 bits as a signed long."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(_fingerprints(width)), "doc_id long, fp long")


def _ball(value, bits: int):
    """The value and every value that sets one more of its bits. Of two values one bit apart, the one
    with the bit unset finds the other, so one direction is enough."""
    one = F.array(*[F.lit(1 << b).cast("long") for b in range(bits)])
    return F.concat(F.array(value), F.transform(F.filter(one, lambda m: value.bitwiseAND(m) == 0), lambda m: value.bitwiseOR(m)))


def _around(value, bits: int):
    """The value and every value one bit away."""
    return F.concat(F.array(value), F.transform(F.array(*[F.lit(1 << b).cast("long") for b in range(bits)]), lambda m: value.bitwiseXOR(m)))


def links(prints: DataFrame, max_distance: int = 3, hot: int = HOT) -> DataFrame:
    """Pairs (u > v) of different fingerprints that differ in at most ``max_distance`` (up to 3) bits.

    Multi-index hashing with two 32-bit segments: three differing bits leave one segment with at most
    one, so the table of a segment is asked for each fingerprint's Hamming ball of radius 1 there, and
    whole distances are verified. A value that more than ``hot`` fingerprints have in a segment is split by
    the other segment in the same way: of its two 16-bit halves one differs in one bit at most, so members
    and those who ask meet by a half and its ball. ``prints`` holds distinct fingerprints (fp)."""
    if not 0 <= max_distance <= 3:
        raise ValueError("two segments with balls of radius 1 find distances up to 3")
    half, quarter = F.lit((1 << 32) - 1).cast("long"), F.lit((1 << 16) - 1).cast("long")
    low, high = F.col("fp").bitwiseAND(half), F.shiftrightunsigned("fp", 32)
    found = []
    for seg, rest in ((low, high), (high, low)):
        table = prints.select(seg.alias("at"), F.col("fp").alias("v"), rest.alias("rest"))
        asks = prints.select(F.explode(_ball(seg, 32)).alias("key"), F.col("fp").alias("u"), rest.alias("other"))
        crowded = cut(table.groupBy("at").agg(F.count("*").alias("n")).where(F.col("n") > hot).select(F.col("at").alias("crowd")))
        if crowded.limit(1).count():
            crowd = few(crowded)
            halves = lambda x: ((0, x.bitwiseAND(quarter)), (1, F.shiftrightunsigned(x, 16)))
            tagged = lambda k, values: F.transform(values, lambda y: F.struct(F.lit(k).alias("k"), y.alias("h")))
            dense = table.join(crowd, F.col("at") == F.col("crowd")).drop("crowd")
            dense = dense.select("at", "v", F.explode(F.concat(*[tagged(k, F.array(h)) for k, h in halves(F.col("rest"))])).alias("at2"))
            ring = asks.join(crowd, F.col("key") == F.col("crowd")).drop("crowd")
            ring = ring.select("key", "u", F.explode(F.concat(*[tagged(k, _around(h, 16)) for k, h in halves(F.col("other"))])).alias("key2"))
            found.append(ring.hint("merge").join(dense.hint("merge"), (F.col("key") == F.col("at")) & (F.col("key2") == F.col("at2"))))
            table, asks = table.join(crowd, F.col("at") == F.col("crowd"), "left_anti"), asks.join(crowd, F.col("key") == F.col("crowd"), "left_anti")
        # a ball has 17 times the rows of the table that it is made of, which is all that Spark knows of its size
        found.append(asks.hint("merge").join(table.hint("merge"), F.col("key") == F.col("at")))
    near = None
    for pairs in found:
        pairs = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") != F.col("v"))
        pairs = pairs.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_distance)
        near = pairs if near is None else near.unionByName(pairs)
    return near.distinct()


def _groups(docs: DataFrame, id_col: str, text_col: str, max_distance: int, width: int, similarity: float | None = None) -> DataFrame:
    """(doc_id, fp, root, component_id) for each row: root is the smallest fingerprint reachable by links.

    With a ``similarity``, texts whose 5-word shingle sets are that similar (Jaccard) are linked too."""
    if similarity is None:
        rows = cut(fingerprints(docs, id_col, text_col, width))
        more = None
    else:
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
        rows = cut(texts.mapInArrow(lean(_fingerprints(width)), "doc_id long, th long, fp long"))
        of = rows.groupBy("th").agg(F.min("fp").alias("fp"))
        more = minhash.links(texts.select("th", "text"), similarity)
        more = more.join(of.withColumnsRenamed({"th": "u", "fp": "fu"}), "u").join(of.withColumnsRenamed({"th": "v", "fp": "fv"}), "v")
        more = more.select(F.col("fu").alias("u"), F.col("fv").alias("v")).where("u <> v")
    prints = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = links(prints.select("fp"), max_distance)
    roots = components(found if more is None else found.unionByName(more))
    node = prints.join(roots.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "least", F.coalesce("v", "fp").alias("root"))
    least = node.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(node.join(least, "root").select("fp", "root", "component_id"))
    # a result is written under the session's own threshold, by which Spark may build a table of all fingerprints in the driver
    return rows.hint("merge").join(named.hint("merge"), "fp").select("doc_id", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = 3, width: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``; component_id is the smallest id reachable by links.

    Null texts are empty texts, whose fingerprint is zero and links like any other. Rows with equal
    fingerprints are one node, however many there are, so groups of copies add no links. A null id is
    never a component's id unless no row of the component has one. Repeated rows each return. An empty
    table returns none. Other columns, whatever their names, are not read."""
    return _groups(docs, id_col, text_col, max_distance, width).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = 3, width: int = 3, similarity: float | None = None) -> DataFrame:
    """The rows of ``docs``, one of each group of near copies: the one with the smallest id.

    Near copies are linked by fingerprints, and with a ``similarity`` also by 5-word shingle sets.
    Rows that repeat an id within a group count as one; rows of a group without any id leave one. Groups
    are told apart by their links, not by that id, so rows without an id or with one id in two groups stay."""
    groups = _groups(docs, id_col, text_col, max_distance, width, similarity)
    kept = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.first("component_id").alias("doc_id"), F.min("fp").alias("fp")).select("doc_id", "fp").hint("merge")
    # only ids that a table holds more than once need their fingerprints compared again
    twice = docs.groupBy(id_col).agg(F.count("*").alias("n")).where(F.col("n") > 1).limit(1).count()
    if not twice:
        return docs.join(kept.select(F.col("doc_id").alias("__kept")), F.col(id_col).cast("long").eqNullSafe(F.col("__kept")), "left_semi")
    marked = docs.withColumn("__fp", F.arrow_udf(_print_array(width), "long", ArrowUDFType.SCALAR)(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    first = marked.join(kept.select(F.col("doc_id").alias("__kept"), F.col("fp").alias("__of")), F.col(id_col).cast("long").eqNullSafe(F.col("__kept")) & (F.col("__fp") == F.col("__of")), "left_semi")
    return first.dropDuplicates([id_col, "__fp"]).drop("__fp")


def _print_array(width: int):
    def run(texts: pa.Array) -> pa.Array:
        found = [fingerprint(t, width) for _, part in portions(filled(texts), pa.binary()) for t in part]
        return pa.array(np.array(found, np.uint64).view(np.int64))

    return run


def hex16(fp):
    """A fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
