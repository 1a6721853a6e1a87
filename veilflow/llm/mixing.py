"""Mixing sources to target weights by entropy balancing, with DataFrame operations only.

Each document gets a rate: how often the mix takes it. Of all rates between 0 and ``most`` that meet each
source's token target, entropy balancing picks those nearest to 1 in relative entropy. These are
exponentially tilted, min(most, exp(lambda_source * size / mean_size_source)), and the dual in lambda is
convex with one coordinate a source. Newton steps, kept inside a bracket, solve it over a table of
(source, size, documents); rates are then rounded to copies by a hash of the row,
so that each source comes near its target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_table

#: Sources for which the solved multipliers may be broadcast; beyond it they are joined by shuffle.
SMALL = 100_000
#: Newton steps at most, and the relative miss at which a source counts as solved.
NEWTON, CLOSE = 24, 1e-9
#: Rounds that mend what rounding to whole copies leaves of a target.
MENDS = 3
#: Hashes of repeated rows that are broadcast at most (8 MB).
REPEATED = 1 << 20
#: Cells into which a source's documents fall by hash and fraction, for rounding.
CELLS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text):
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text column, null as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size): weights repeat over the sources by code
    point, null last; a target stops at ``most`` times its source's size and what is above is shared out
    again by weight until none is above.

    Water-filling: sources with the smallest size per weight reach their caps first, so with sources in
    that order the level is (rest of the total) / (rest of the weight) where it first stays under a
    cap. One row per source; windows over them are over source totals, not documents."""
    w = F.expr(f"element_at(array({', '.join(f'{float(x)}D' for x in weights)}), cast((n - 1) % {len(weights)} as int) + 1)")
    ordered = sizes.selectExpr("source", "source_size", "row_number() OVER (ORDER BY source IS NULL, source) AS n").withColumn("w", w)
    cap = ordered.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    run = cap.selectExpr(
        "*",
        "sum(source_size) OVER () AS total",
        "cap / w AS ratio",
        "sum(cap) OVER (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS capped",
        "sum(w) OVER (ORDER BY cap / w, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest",
    ).withColumn("level", (F.col("total") - F.coalesce("capped", F.lit(0.0))) / F.col("rest"))
    level = run.selectExpr("*", "min(CASE WHEN level <= ratio THEN struct(ratio, n, level) END) OVER () AS first")
    target = F.when(F.col("first").isNull() | (F.col("ratio") < F.col("first.ratio")), F.col("cap")).otherwise(F.least("cap", F.col("w") * F.col("first.level")))
    return level.select("source", "source_size", target.alias("target"))


def _lookup(left: DataFrame, right: DataFrame, small: bool) -> DataFrame:
    """Join ``right``, one row a source, to ``left``. Up to SMALL sources it is broadcast; beyond, both
    sides shuffle, rows of a source dealt over 64 salts."""
    if small:
        right = F.broadcast(right.withColumnRenamed("source", "_source"))
        return left.join(right, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    salted = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(63)))).withColumnRenamed("source", "_source")
    left = left.withColumn("_mine", F.pmod(F.xxhash64(*left.columns), F.lit(64)).cast("int"))
    return left.join(salted, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_mine") == F.col("_salt"))).drop("_source", "_salt", "_mine")


def _rate(lam: str, most: float):
    return F.least(F.lit(float(most)), F.exp(F.col(lam) * F.col("x")))


def solve(hist: DataFrame, goal: DataFrame, most: float, small: bool) -> DataFrame:
    """(source, lam) from (source, x, size, docs) and (source, target): x is size over its source's mean.

    Safeguarded Newton: a step that leaves the bracket is replaced by bisection. Targets of 0 and of
    ``most`` times the size have no finite multiplier; their brackets end at -60 and 60 / least x."""
    state = cut(goal.select("source", "target", F.lit(0.0).alias("lam"), F.lit(-60.0).alias("lo"), F.lit(float("inf")).alias("hi"), F.lit(1.0).alias("miss")))
    for step in range(NEWTON):
        r = _rate("lam", most)
        tokens = F.col("docs") * F.col("size")
        sums = _lookup(hist, state.select("source", "lam"), small).groupBy("source").agg(
            F.sum(tokens * r).alias("got"),
            F.sum(F.when(r < most, tokens * r * F.col("x")).otherwise(0.0)).alias("slope"),
        )
        both = _lookup(sums, state, small)
        over = F.col("got") > F.col("target")
        lo, hi = F.when(over, F.col("lo")).otherwise(F.col("lam")), F.when(over, F.col("lam")).otherwise(F.col("hi"))
        both = both.withColumn("lo", lo).withColumn("hi", hi).withColumn("miss", F.abs(F.col("got") - F.col("target")) / F.greatest(F.col("target"), F.lit(1.0)))
        newton = F.col("lam") - (F.col("got") - F.col("target")) / F.col("slope")
        halved = F.when(F.col("hi") == float("inf"), F.greatest(F.col("lam") * 2, F.col("lam") + 1)).otherwise((F.col("lo") + F.col("hi")) / 2)
        nxt = F.when(F.col("miss") <= CLOSE, F.col("lam")).when((F.col("slope") > 0) & (newton > F.col("lo")) & (newton < F.col("hi")), newton).otherwise(halved)
        new = cut(both.select("source", "target", nxt.alias("lam"), "lo", "hi", "miss").coalesce(1) if small else both.select("source", "target", nxt.alias("lam"), "lo", "hi", "miss"))
        drop_table(state)
        state = new
        if (state.agg(F.max("miss")).first()[0] or 0) <= CLOSE:
            break
    return state.select("source", "lam")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), most: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies): how often the mix takes each document.

    ``size`` is the number of words; null and empty texts have none and are taken once. A null source is a source of
    its own, ordered last. No document is taken more than ``most`` times. A row's share in the rounding is a
    hash of its id and text, so reruns agree; rows alike in both are told apart by their place in the table, and
    how many of them get a copy more agrees as long as the input's files are read alike. ``carry`` names further
    columns to return, which stand for a result column of the same name. An empty table gives none."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64(F.lit("copies"), F.col(id_col).cast("string"), text).alias("h"), *[F.col(f"`{c}`").alias(f"_carry_{i}") for i, c in enumerate(carry)])
    rows = cut(rows.withColumn("rid", F.monotonically_increasing_id()))
    rows = _told_apart(rows)
    counts = cut(rows.groupBy("source", "size").agg(F.count("*").alias("docs")))
    totals = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"), F.sum("docs").alias("n"))
    goal = cut(_with_mean(totals, targets(totals.select("source", "source_size"), weights, most)))
    small = goal.limit(SMALL + 1).count() <= SMALL
    hist = cut(_lookup(counts.where("size > 0"), goal.select("source", "mean"), small).select("source", "size", "docs", (F.col("size") / F.col("mean")).alias("x")))
    lam = solve(hist, goal.where("source_size > 0").select("source", "target"), most, small)
    lam = goal.join(lam.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "source_size", "target", "mean", F.coalesce("lam", F.lit(0.0)).alias("lam"))
    rate = F.when(F.col("target") >= most * F.col("source_size"), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), F.exp(F.col("lam") * F.col("size") / F.col("mean"))))
    rate = F.when(F.col("size") == 0, 1.0).otherwise(F.round(rate, 9))
    dealt = _lookup(rows, lam, small).withColumn("rate", rate).withColumn("base", F.floor("rate").cast("long"))
    chance = F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))
    # a document has one copy more than its rate's whole part if its hash lies under the fraction: moved by
    # as much, the same for all of a source, as brings the source's words to its target
    over = chance - (F.col("rate") - F.col("base"))
    dealt = cut(dealt.withColumn("cell", F.when(F.col("base") >= most, CELLS).otherwise(F.floor((over + 1) * (CELLS // 2)))).drop("mean", "lam", "rate"))
    dealt = cut(_lookup(dealt, _edges(dealt), small).withColumn("copies", F.col("base") + (F.col("cell") <= F.col("edge")).cast("long")).drop("base", "cell", "edge"))
    own = ("doc_id", "size", "source_size", "target", "taken", "copies")
    done = _mend(dealt, most, small).withColumn("taken", F.col("size") * F.col("copies"))
    return done.select(*[c for c in own if c not in carry], *[F.col(f"_carry_{i}").alias(c) for i, c in enumerate(carry)])


def _told_apart(rows: DataFrame) -> DataFrame:
    """``rows`` with a hash ``h`` of its own for each row. Only rows whose hash others share take their place
    ``rid`` in; what tells these is one number a repeated hash, broadcast up to REPEATED of them."""
    again = cut(rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select(F.col("h").alias("_again")))
    n = again.limit(REPEATED + 1).count()
    if not n:
        return rows.drop("rid")
    marked = rows.join(F.broadcast(again) if n <= REPEATED else again, F.col("h") == F.col("_again"), "left")
    own = F.when(F.col("_again").isNull(), F.col("h")).otherwise(F.xxhash64("h", "rid"))
    return cut(marked.withColumn("h", own).drop("rid", "_again"))


def _edges(dealt: DataFrame) -> DataFrame:
    """(source, edge): documents in cells up to the edge get a copy more. CELLS rows a source at most."""
    sums = dealt.groupBy("source", "cell").agg(F.sum("size").alias("w"), F.sum(F.col("size") * F.col("base")).alias("b"), F.first("target").alias("target"))
    run = sums.selectExpr("source", "cell", "target - sum(b) OVER (PARTITION BY source) AS rest", "sum(w) OVER (PARTITION BY source ORDER BY cell) AS run")
    fits = F.when((F.col("run") <= F.col("rest")) & (F.col("cell") < CELLS), F.col("cell"))
    return run.groupBy("source").agg(F.coalesce(F.max(fits), F.lit(-1)).alias("edge"))


def _with_mean(totals: DataFrame, goal: DataFrame) -> DataFrame:
    mean = totals.select(F.col("source").alias("_s"), (F.col("source_size") / F.col("n")).alias("mean"))
    return goal.join(mean, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


def _mend(dealt: DataFrame, most: int, small: bool) -> DataFrame:
    """Bring each source nearer to its target: per round, the document nearest in size to the miss
    gains or loses a copy. A round sends one row a source and task."""
    changes = None
    for _ in range(MENDS):
        now = dealt if changes is None else _changed(dealt, changes, small)
        miss = now.groupBy("source").agg((F.first("target") - F.sum(F.col("size") * F.col("copies"))).alias("miss"))
        open_ = _lookup(now.where("size > 0"), miss, small)
        fits = (F.abs(F.col("size") - F.abs("miss")) < F.abs("miss")) & F.when(F.col("miss") > 0, F.col("copies") < most).otherwise(F.col("copies") > 0)
        pick = open_.where(fits).groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.abs("miss")).alias("off"), "size", "h")).alias("pick"), F.first("miss").alias("miss"))
        new = pick.select("source", F.col("pick.h").alias("_h"), F.signum("miss").cast("long").alias("_by"))
        changes = cut(new if changes is None else changes.unionByName(new))
    return _changed(dealt, changes, small)


def _changed(dealt: DataFrame, changes: DataFrame, small: bool) -> DataFrame:
    """Copies after the changes, MENDS rows a source at most."""
    own = changes.groupBy(F.col("source"), "_h").agg(F.sum("_by").alias("_by")).select(F.col("source").alias("_source"), "_h", "_by")
    own = F.broadcast(own) if small else own
    joined = dealt.join(own, F.col("source").eqNullSafe(F.col("_source")) & (F.col("h") == F.col("_h")), "left")
    return joined.withColumn("copies", F.col("copies") + F.coalesce("_by", F.lit(0))).drop("_source", "_h", "_by")
