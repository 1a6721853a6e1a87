"""Document fingerprints: MinHash over word shingles, bands joined in Spark, Jaccard verified.

A fingerprint holds, for each of PERMUTATIONS universal hash permutations, the least value over a text's
shingles of five words, cut to 8 bits. Likeness of two fingerprints estimates the Jaccard similarity of
their shingle sets from the share of equal bytes, less what chance makes equal."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType

from .common import cut, drop_table, few, filled, lean, mix, steps, text_bytes, words
from .graph import components

#: Permutations, words of a shingle, and bytes of a band (rows of a banded signature).
PERMUTATIONS, WIDTH, BAND = 128, 5, 5
#: Bands of a signature. Texts alike by 0.8 agree in none of them with a chance of 1 in 20,000.
BANDS = PERMUTATIONS // BAND
#: What a fingerprint's estimate may lie under the similarity asked for: over five standard deviations.
SLACK = 0.2
#: Members up to which those of a band meet each other.
SMALL = 32
#: Shared shingles whose counts go to the tasks at most (48 MB).
HELD = 1 << 22
_RNG = np.random.default_rng(8128)
_A = _RNG.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_ROLL = np.uint64(0x9E6C63D0876A9A47)
_SET_SALT = np.uint64(0xD6E8FEB86659FD93)


def shingles(data: np.ndarray, places: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of texts laid end to end, and each text's first shingle (n + 1 places).

    A text with fewer words is one shingle of all it has; without any it is the shingle of nothing."""
    h, _, _, text = words(data, places)
    n = len(places) - 1
    count = np.bincount(text, minlength=n)
    size = np.maximum(count - width + 1, 1)
    starts = np.r_[0, np.cumsum(size)]
    own = np.repeat(np.arange(n), size)
    at = np.arange(starts[-1]) - starts[own] + np.r_[0, np.cumsum(count)[:-1]][own]
    length = np.minimum(count, width)[own]
    out = np.zeros(len(own), np.uint64)
    for k in range(width):
        ok = k < length
        if ok.all():
            out = out * _ROLL + h[at + k]
        else:
            out[ok] = out[ok] * _ROLL + h[at[ok] + k]
    return mix(out + length.astype(np.uint64)), starts


def signatures(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The 32-bit minima of each text under each permutation: texts x PERMUTATIONS."""
    out = np.empty((len(starts) - 1, PERMUTATIONS), np.uint32)
    for j in range(PERMUTATIONS):
        value = ((hashes * _A[j] + _B[j]) >> np.uint64(32)).astype(np.uint32)
        out[:, j] = np.minimum.reduceat(value, starts[:-1])
    return out


def short(minima: np.ndarray) -> np.ndarray:
    """A fingerprint: 8 bits of each minimum."""
    return (minima >> np.uint32(3)).astype(np.uint8)


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of two rows of fingerprints each, 0 to 1; 1 for equal ones."""
    return np.maximum(((x == y).mean(axis=1) - 1 / 256) / (1 - 1 / 256), 0)


def _sign(texts: pa.Array) -> np.ndarray:
    found = [signatures(*shingles(*text_bytes(texts.slice(a, b - a)))) for a, b in steps(texts)]
    return np.concatenate(found) if found else np.zeros((0, PERMUTATIONS), np.uint32)


def edited(text: str, following: str) -> str:
    """``text`` with its last floor(n/2) code points replaced by the first as many (or all) of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _hex(prints: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes().hex() for row in prints], pa.string())


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, component_id long"
#: Bytes of text of a range of ids, ranges at most, and rows of one id from which its rows are dealt over ranges.
PART_BYTES, MOST_PARTS, CROWDED = 1 << 24, 1 << 16, 10_000


def _pairs(batches):
    """Rows of one task come in order (part, then falling id); each but a guest meets the one that follows."""
    from hashlib import sha256

    last = None  # the row before and its fingerprint
    for batch in batches:
        texts = filled(batch.column("text"))
        for x, y in steps(texts):
            prints = short(_sign(texts.slice(x, y - x)))
            rows = list(zip(*(batch.column(c).slice(x, y - x).to_pylist() for c in ("part", "guest", "doc_id", "component_id", "text"))))
            if last is not None:
                rows, prints = [last[0], *rows], np.concatenate([last[1], prints])
            last = (rows[-1], prints[-1:])
            own = [k for k in range(len(rows) - 1) if not rows[k][1] and rows[k + 1][0] == rows[k][0]]
            if not own:
                continue
            new = [edited(rows[k][4], rows[k + 1][4]) for k in own]
            p, q = prints[own], prints[np.array(own) + 1]
            e = short(_sign(pa.array(new, pa.string())))
            ids, groups = (pa.array([rows[k][j] for k in own], pa.int64()) for j in (2, 3))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([len(rows[k][4]) for k in own], pa.int64()), pa.array([sha256(t.encode()).hexdigest() for t in new]), _hex(p), _hex(e), pa.array(likeness(p, e)), pa.array(likeness(p, q)), groups],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "component_id"],
            )


def _placer(spark, keys: DataFrame, total: int):
    """(function of id and text hash that gives a row's part, number of parts). Parts are ranges of falling ids of
    about PART_BYTES; an id that many rows have, and rows without one, are ranges of the text's hash besides."""
    parts = min(max(1, -(-total // PART_BYTES)), MOST_PARTS)
    crowded = {r["doc_id"]: r["n"] for r in keys.groupBy("doc_id").agg(F.count("*").alias("n")).where((F.col("n") >= CROWDED) | F.col("doc_id").isNull()).orderBy(F.desc("n")).limit(MOST_PARTS).collect()}
    rows = max(keys.count(), 1)
    quantiles = keys.where("doc_id IS NOT NULL").stat.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else []
    alone = [i for i in crowded if i is not None]
    cuts = np.array(sorted({int(c) for c in quantiles} | set(alone) | {i + 1 for i in alone}), np.int64)
    share = np.ones(len(cuts) + 2, np.int64)  # parts of each range, from the largest ids to none
    for i, n in crowded.items():
        at = len(cuts) + 1 if i is None else len(cuts) - int(np.searchsorted(cuts, i, "right"))
        share[at] = max(1, -(-n * parts // rows))
    first = np.cumsum(share) - share
    shared = spark.sparkContext.broadcast((cuts, share, first))

    def place(ids: pa.Array, hashes: pa.Array, missing: pa.Array) -> pa.Array:
        cuts, share, first = shared.value
        index = len(cuts) - np.searchsorted(cuts, ids.to_numpy(), "right")
        index = np.where(missing.to_numpy(zero_copy_only=False), len(cuts) + 1, index)
        sub = np.floor((0.5 - hashes.to_numpy() / 2.0**64) * share[index]).astype(np.int64)
        return pa.array((first[index] + np.clip(sub, 0, share[index] - 1)).astype(np.int32))

    return F.arrow_udf(place, "int", ArrowUDFType.SCALAR)(F.coalesce("doc_id", F.lit(0)), F.col("th"), F.col("doc_id").isNull()), int(share.sum())


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness: one row for each of ``docs``.

    The edited text takes its last half from the next document, by falling id (after the last: the first).
    ``component_id`` is the smallest id among the documents that links of ``similarity`` or more (exact Jaccard of
    shingle sets, ``links``) reach. Null texts are empty. Rows that repeat an id follow one another by
    the hash of their text; rows with a null id come last, in that order too, and their component_id is null
    unless it has an id. A table of one row is its own next. An empty table gives none. Other columns are not read.

    Documents are dealt once, by ranges of ids, and each range is read in order; the first row of each
    range also visits the range before it as a guest, so nothing else moves and no task sees all."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("th", F.xxhash64("text"))
    groups = _named(rows, similarity)
    total = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0]
    if not total:
        return spark.createDataFrame([], _OUT)
    place, parts = _placer(spark, rows.select("doc_id", "th"), total)
    low = F.lit(-(1 << 63)).cast("long")
    heads = rows.select("doc_id", "th").withColumn("part", place).groupBy("part").agg(F.max(F.struct(F.coalesce("doc_id", low), "th")).alias("head"))
    heads = sorted((r["part"], r["head"][0], r["head"][1]) for r in heads.collect())  # a row a part
    table = spark.createDataFrame([(p, i, t, heads[k - 1][0]) for k, (p, i, t) in enumerate(heads)], "head_part int, head_id long, head_th long, visits int")
    placed = rows.withColumn("part", place).join(few(groups), "th", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    joined = placed.join(F.broadcast(table), (F.col("part") == F.col("head_part")) & (F.coalesce("doc_id", low) == F.col("head_id")) & (F.col("th") == F.col("head_th")), "left")
    stays = F.struct(F.col("part"), F.lit(0).alias("guest"))
    visit = F.struct(F.col("visits").alias("part"), F.lit(1).alias("guest"))
    both = joined.withColumn("at", F.explode(F.when(F.col("visits").isNull(), F.array(stays)).otherwise(F.array(stays, visit)))).select("at.part", "at.guest", "doc_id", "component_id", "th", "text")
    dealt = both.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "guest", F.desc_nulls_last("doc_id"), F.desc("th"))
    return dealt.mapInArrow(lean(_pairs), _OUT)


def _signed(batches):
    for batch in batches:
        texts = filled(batch.column("text"))
        prints, keys, sizes = [], [], []
        for a, b in steps(texts):
            h, starts = shingles(*text_bytes(texts.slice(a, b - a)))
            minima = signatures(h, starts)
            bands = minima[:, : BANDS * BAND].reshape(len(minima), BANDS, BAND).astype(np.uint64)
            key = np.zeros(bands.shape[:2], np.uint64)
            for k in range(BAND):
                key = mix(key * _ROLL + bands[:, :, k])
            keys.append(mix(key + np.arange(BANDS, dtype=np.uint64)))
            prints += [row.tobytes() for row in short(minima)]
            sizes.append(np.diff(starts))
        if not prints:
            continue
        flat = np.concatenate(keys).ravel().view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(prints) + 1) * BANDS, pa.int32()), pa.array(flat))
        yield pa.RecordBatch.from_arrays([batch.column("th"), pa.array(prints, pa.binary()), pa.array(np.concatenate(sizes)), lists], ["th", "print", "n", "bands"])


def _sets(batches):
    for batch in batches:
        texts = filled(batch.column("text"))
        sets = []
        for a, b in steps(texts):
            h, starts = shingles(*text_bytes(texts.slice(a, b - a)))
            h = (h >> np.uint64(32)).astype(np.uint32).view(np.int32)
            sets += [np.unique(h[x:y]) for x, y in zip(starts[:-1], starts[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("th"), pa.array(sets, pa.list_(pa.int32()))], ["th", "set"])


def _near(similarity: float):
    """The pairs whose fingerprints don't rule the similarity out."""

    def run(batches):
        for batch in batches:
            if len(batch):
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(len(batch), -1) for c in ("pu", "pv"))
                yield batch.select(["u", "v"]).filter(pa.array(likeness(x, y) >= similarity - SLACK))

    return run


def _grouped(keyed: DataFrame, key: str, roots: DataFrame) -> DataFrame:
    """(key, th, c, members): the rows of keys that still hold two groups or more, with the group of each."""
    own = keyed.join(few(roots), "th", "left").withColumn("c", F.coalesce("root", "th")).drop("root")
    split = own.groupBy(key).agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("members")).where("low < high").select(key, "members")
    return cut(own.join(split, key))


def _counter(batches):
    """(s, df): how many sets of a task hold each shingle."""
    held = (np.zeros(0, np.int32), np.zeros(0, np.int64))
    for batch in batches:
        own, n = np.unique(batch.column("set").flatten().to_numpy(), return_counts=True)
        both, at = np.unique(np.r_[held[0], own], return_inverse=True)
        held = both, np.bincount(at, weights=np.r_[held[1], n]).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(held[0], pa.int32()), pa.array(held[1])], ["s", "df"])


def _parts_asked(n, similarity: float):
    """How many of a set's n rarest shingles ask, and how many of them stand."""
    t = similarity - 1e-9
    return n - np.ceil(t * n) + 1, n - np.ceil(2 * t / (1 + t) * n) + 1


def _rarest(shared, similarity: float):
    def run(batches):
        known, count = shared.value
        for batch in batches:
            out = []
            for th, own in zip(batch.column("th").to_pylist(), batch.column("set")):
                s = own.values.to_numpy()
                df = np.ones(len(s), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    df = np.where(known[at] == s, count[at], 1)
                order = np.lexsort((s, mix(s.astype(np.int64).view(np.uint64)), df))
                asks, stands = _parts_asked(len(s), similarity)
                rank = np.flatnonzero(df[order[: int(asks)]] > 1)
                out.append((s[order[rank]], np.full(len(rank), th), np.full(len(rank), len(s)), rank + 1, rank + 1 <= stands))
            if out:
                s, th, n, rank, stands = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(th, pa.int64()), pa.array(n, pa.int32()), pa.array(rank, pa.int32()), pa.array(np.ones(len(s), bool)), pa.array(stands)], ["s", "th", "n", "rank", "asks", "stands"])

    return run


def _prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """(s, th, n, rank, asks, stands): the rare shingles of each set by which similar sets are sure to meet.

    With shingles in one order, the rarest first, the larger of two sets that are similar enough holds in its
    first n - ceil(t n) + 1 one of the first n - ceil(2t / (1 + t) n) + 1 of the smaller. How often the shared ones
    are found is sent to the tasks up to HELD of them; beyond, sets are taken apart and joined."""
    held = cut(sets.select("set").mapInArrow(lean(_counter), "s int, df long").groupBy("s").agg(F.sum("df").alias("df")).where("df > 1"))
    if held.limit(HELD + 1).count() <= HELD:
        table = held.toArrow()
        order = np.argsort(table["s"].to_numpy())
        shared = sets.sparkSession.sparkContext.broadcast((table["s"].to_numpy()[order], table["df"].to_numpy()[order]))
        return cut(sets.select("th", "set").mapInArrow(lean(_rarest(shared, similarity)), "s int, th long, n int, rank int, asks boolean, stands boolean"))
    flat = sets.select("th", F.size("set").alias("n"), F.explode("set").alias("s"))
    rank = F.row_number().over(Window.partitionBy("th").orderBy("df", F.xxhash64("s"), "s"))
    ranked = flat.join(held, "s", "left").withColumn("df", F.coalesce("df", F.lit(1))).withColumn("rank", rank).where("df > 1")
    t = F.lit(similarity - 1e-9)
    asks = F.col("rank") <= F.col("n") - F.ceil(t * F.col("n")) + 1
    stands = F.col("rank") <= F.col("n") - F.ceil(t * 2 / (t + 1) * F.col("n")) + 1
    return cut(ranked.select("s", "th", "n", "rank", asks.alias("asks"), stands.alias("stands")).where("asks"))


def _meetings(own: DataFrame, similarity: float) -> DataFrame:
    """(u, v): sets of different groups that one's first shared shingle doesn't rule out, from ``_grouped`` prefixes.

    A shingle's largest group doesn't meet itself, and whoever isn't in it meets all others. What two sets can
    share at most after a shingle that is the first one shared follows from its ranks."""
    counts = own.groupBy("s", "c").agg(F.count("*").alias("k"))
    major = counts.groupBy("s").agg(F.max_by("c", F.struct("k", "c")).alias("m"))
    minor = own.join(major, "s").where("c <> m").drop("m", "members")
    x = minor.select("s", *[F.col(k).alias(f"x_{k}") for k in ("th", "c", "n", "rank", "asks", "stands")])
    y = own.select("s", *[F.col(k).alias(f"y_{k}") for k in ("th", "c", "n", "rank", "asks", "stands")])
    t = similarity - 1e-9
    apart = F.col("x_c") != F.col("y_c")
    sizes = F.least("x_n", "y_n") >= F.greatest("x_n", "y_n") * t
    roles = F.when(F.col("x_n") > F.col("y_n"), F.col("y_stands")).when(F.col("x_n") < F.col("y_n"), F.col("x_stands")).otherwise(F.col("x_stands") | F.col("y_stands"))
    most = 1 + F.least(F.col("x_n") - F.col("x_rank"), F.col("y_n") - F.col("y_rank"))
    enough = most >= (F.col("x_n") + F.col("y_n")) * (t / (1 + t))
    return x.join(y, "s").where(apart & sizes & roles & enough).select(F.col("x_th").alias("u"), F.col("y_th").alias("v"))


def links(texts: DataFrame, similarity: float = 0.8, stars: int = 2) -> DataFrame:
    """(u, v), u > v: links between texts whose shingle sets have a Jaccard similarity of ``similarity`` or more.

    ``texts`` holds (th, text), th naming a text; rows may repeat. Texts that agree in a band of their
    signature are candidates. First, in ``stars`` rounds, each band's members are held against one of them - the one
    that meets most texts in its bands, as originals of many copies do, then the one that does outside its component:
    this links groups of near copies, however large, in step with their size. Where a
    band still holds several components, its members meet if they are few (SMALL). Texts of larger bands meet by their
    rarest shingles (``_prefixes``, ``_meetings``), which finds every similar pair among them, and templates that
    many unlike texts share make few meet. A link counts if the exact similarity reaches the threshold;
    fingerprints rule most others out before."""
    signed = cut(texts.select("th", "text").mapInArrow(lean(_signed), "th long, print binary, n long, bands array<long>").dropDuplicates(["th"]))
    flat = signed.select("th", F.explode("bands").alias("band"))
    shared = flat.groupBy("band").agg(F.min("th").alias("low"), F.max("th").alias("high")).where("low < high").select("band")
    bands = cut(flat.join(cut(shared), "band"))
    wanted = cut(bands.select("th").distinct())
    prints = cut(signed.join(wanted, "th").select("th", "print", "n"))
    drop_table(signed)
    sets = cut(texts.join(few(wanted), "th", "left_semi").select("th", "text").mapInArrow(lean(_sets), "th long, set array<int>").dropDuplicates(["th"]))

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (u, v), either way round, that are similar enough. Sizes and fingerprints rule most others out."""
        pairs = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        both = pairs.join(prints.withColumnsRenamed({"th": "u", "print": "pu", "n": "p"}), "u").join(prints.withColumnsRenamed({"th": "v", "print": "pv", "n": "q"}), "v")
        able = both.select("u", "v", "pu", "pv").mapInArrow(lean(_near(similarity)), "u long, v long")
        held = able.join(sets.withColumnsRenamed({"th": "u", "set": "x"}), "u").join(sets.withColumnsRenamed({"th": "v", "set": "y"}), "v")
        common = F.size(F.array_intersect("x", "y"))
        return cut(held.where(common / (F.size("x") + F.size("y") - common) >= similarity).select("u", "v"))

    size = bands.groupBy("band").agg(F.count("*").alias("k"))
    known = cut(bands.join(bands.join(size, "band").groupBy("th").agg(F.sum("k").alias("met")), "th"))
    edges = texts.sparkSession.createDataFrame([], "u long, v long")
    for k in range(stars):
        open_ = _grouped(known, "band", _roots(edges))
        chosen = open_.groupBy("band").agg(F.max_by(F.struct("th", "c"), F.struct("met", "th")).alias("s"))
        if k:  # the first one's component has its star; now the one that meets most of the others
            rest = open_.join(chosen, "band").where(F.col("c") != F.col("s.c"))
            chosen = rest.groupBy("band").agg(F.max_by(F.struct("th", "c"), F.struct("met", "th")).alias("s"))
        pairs = open_.join(chosen, "band").where(F.col("c") != F.col("s.c")).select(F.col("th").alias("u"), F.col("s.th").alias("v"))
        edges = edges.unionByName(verified(pairs))
        drop_table(open_)
    roots = cut(_roots(edges))
    open_ = _grouped(bands, "band", roots)
    small = open_.where(F.col("members") <= SMALL)
    near = small.select("band", F.col("th").alias("u"), F.col("c").alias("c1")).join(small.select("band", F.col("th").alias("v"), F.col("c").alias("c2")), "band").where("c1 < c2").select("u", "v")
    crowd = cut(open_.where(F.col("members") > SMALL).select("th").distinct())
    own = None
    if crowd.limit(1).count():
        own = _grouped(_prefixes(sets.join(few(crowd), "th", "left_semi"), similarity), "s", roots)
        near = near.unionByName(_meetings(own, similarity))
    found = cut(edges.unionByName(verified(near)))
    for table in (bands, known, prints, sets, open_, crowd, own, roots, wanted):
        if table is not None:
            drop_table(table)
    return found


def _roots(edges: DataFrame) -> DataFrame:
    return components(edges).select(F.col("u").alias("th"), F.col("v").alias("root"))


def _named(rows: DataFrame, similarity: float) -> DataFrame:
    """(th, component_id) of the texts that links join to others or that rows repeat, from (doc_id, th, text)."""
    nodes = cut(rows.groupBy("th").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    node = nodes.join(_roots(links(rows.select("th", "text"), similarity)), "th", "left").withColumn("root", F.coalesce("root", "th"))
    sums = node.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("members")).where("members > 1").select("root", "component_id")
    named = cut(node.join(sums, "root").select("th", "component_id"))
    drop_table(nodes)
    return named


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id): ids of documents linked by a shingle Jaccard similarity of ``similarity`` or more.

    Texts that are equal are one node; ``links`` says which pairs are compared. component_id is the smallest
    id reachable; null ids are never chosen unless a component has no other."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("th", F.xxhash64("text"))
    return rows.select("doc_id", "th").join(_named(rows, similarity), "th", "left").select("doc_id", F.coalesce("component_id", "doc_id").alias("component_id"))
