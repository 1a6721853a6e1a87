"""Pieces that the operators share: cutting lineage, byte tokens, hashes."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on (a longer document is a step of its own).
STEP_BYTES = 1 << 19


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. ``spark.checkpoint.dir`` names it. Only on one machine
    (tests) a temporary folder stands in where it is unset; on a cluster that is an error."""
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not known:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        known = sc.getCheckpointDir()
    return known


#: Settings of a write: files of shuffles that nothing reads any more go, and batches that Python gets are bounded by bytes.
#: Spark guesses a table's size by its files, which explode and compression make far too small: what it broadcasts unasked
#: is built in the driver's heap, so this is kept to small files.
_WRITING = {"spark.sql.autoBroadcastJoinThreshold": "256k", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}


def cut(df: DataFrame, group_bytes: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends, lost executors lose nothing.

    Once the table is written nothing reads the shuffles that made it, so Spark is asked to remove their
    files at the end of the write. Parquet is read by groups of rows, 128 MB or 4,096 rows at once: tables of rows of
    some MB each are written in groups of about ``group_bytes``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in _WRITING}
    for k, v in _WRITING.items():
        spark.conf.set(k, v)
    try:
        options = {"parquet.block.size": group_bytes, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1} if group_bytes else {}
        df.write.options(**options).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Remove a table that ``cut`` wrote and that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        if "/tables/" in name:
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a table of keys that a join broadcasts at most: 16 MB of longs, some 100 MB in the driver while it is built.
FEW = 1 << 20


def few(keys: DataFrame) -> DataFrame:
    """A table of one or two long columns, marked for broadcast if a count shows FEW rows or fewer."""
    return F.broadcast(keys) if keys.limit(FEW + 1).count() <= FEW else keys


def train_rows(column: str = "doc_id", modulus: int = 10, held: int = 0):
    """Column: true for rows to hold out (crc32 of the id as text leaves ``held``)."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus == held, F.lit(False))


def lean(run):
    """A function of Arrow batches that gives memory back when its task ends: workers are kept for tasks to come."""

    def task(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # not this C library
            pass

    return task


def steps(texts: pa.Array, most: int = STEP_BYTES):
    """Slices (first, last) of a text array, each of about ``most`` bytes."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4)
    first, n = 0, len(texts)
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def portions(texts: pa.Array, kind: pa.DataType, most: int = 1 << 20):
    """(first row, values) of a text array in portions of about ``most`` bytes, so that few are Python objects at once."""
    for a, b in steps(texts, most):
        yield a, texts.slice(a, b - a).cast(kind).to_pylist()


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text array, one after another, and each text's place in them (n + 1 places)."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    data = texts.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8, int(offsets[-1] - offsets[0]), int(offsets[0])), offsets - offsets[0]


def filled(texts: pa.Array) -> pa.Array:
    """The array as strings, null as the empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.string())
    return texts.fill_null("") if texts.null_count else texts


_RNG = np.random.default_rng(20240229)
#: A random number for each byte value, upper-case ASCII as lower-case.
BYTE_KEYS = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + _RNG.integers(0, 2, 256, dtype=np.uint64)
LOWER_KEYS = BYTE_KEYS.copy()
LOWER_KEYS[65:91] = BYTE_KEYS[97:123]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
STEP = np.uint64(0x9E3779B97F4A7C13)  # leaves 3 when divided by 4
BACK = np.uint64(pow(int(STEP), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """STEP**i and BACK**i modulo 2**64 for i < n."""
    if len(_POWERS.get("up", ())) < n:
        m = max(n, 2 * STEP_BYTES)
        for key, base in (("up", STEP), ("down", BACK)):
            run = np.full(m, base, np.uint64)
            run[0] = 1
            _POWERS[key] = np.cumprod(run, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly (finaliser of public-domain splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Values that one sum takes in: sums modulo 2**64 of many more have collisions of strings that repeat a pattern.
PIECE = 32


def hashed(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [first, last) of keyed values. A span is hashed in pieces of PIECE values, each by
    a sum that is then spread; the pieces' hashes, each spread anew with its number, add up."""
    up, down = powers(len(values))
    sums = np.empty(len(values) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values * up, dtype=np.uint64, out=sums[1:])

    def of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((sums[b] - sums[a]) * down[np.minimum(a, len(down) - 1)] + (b - a).astype(np.uint64))

    out = of(first, np.minimum(last, first + PIECE))
    long = np.flatnonzero(last - first > PIECE)
    if len(long):
        pieces = -(-(last[long] - first[long]) // PIECE)
        at = np.cumsum(pieces) - pieces
        k = np.arange(int(pieces.sum())) - np.repeat(at, pieces)
        a = np.repeat(first[long], pieces) + k * PIECE
        own = of(a, np.minimum(a + PIECE, np.repeat(last[long], pieces)))
        out[long] = mix(np.add.reduceat(mix(own ^ mix(k.astype(np.uint64) + STEP)), at) + (last[long] - first[long]).astype(np.uint64))
    return out


#: Bytes that are hashed at once; longer texts go in windows cut at white space.
_WINDOW = 1 << 22


def words(data: np.ndarray, places: np.ndarray, lower: bool = True):
    """Words ``[^\\x20\\x09-\\x0D]+`` of texts laid end to end.

    Returns (hash, first byte, end byte, index of the text) of each word, in order. Equal words have
    equal 64-bit hashes; ``lower`` takes A-Z as a-z."""
    n, at, found = len(data), 0, []
    while at < n:
        end = min(at + _WINDOW, n)
        while end < n and not SPACE[data[end]]:
            more = np.flatnonzero(SPACE[data[end : end + 4096]])
            end = end + int(more[0]) if len(more) else min(end + 4096, n)
        inner = places[np.searchsorted(places, at) : np.searchsorted(places, end, "right")] - at
        found.append([x if i == 0 else x + at for i, x in enumerate(_words(data[at:end], inner, lower))])
        at = end
    if not found:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z
    h, first, last = found[0] if len(found) == 1 else (np.concatenate(x) for x in zip(*found))
    return h, first, last, np.searchsorted(places, first, "right") - 1


def _words(data: np.ndarray, places: np.ndarray, lower: bool):
    n = len(data)
    ink = ~SPACE[data]
    cut_at = np.zeros(n + 1, bool)
    cut_at[places] = True
    start = ink.copy()
    start[1:] &= ~ink[:-1] | cut_at[1:-1]
    end = ink.copy()
    end[:-1] &= ~ink[1:] | cut_at[1:-1]
    first, last = np.flatnonzero(start), np.flatnonzero(end) + 1
    return hashed((LOWER_KEYS if lower else BYTE_KEYS)[data], first, last), first, last
