"""URL filters: rules first, then the ratio of two character language models, by DataFrame operations only.

Urls that a rule allows or blocks train one smoothed variable-order Markov model each: counts of
characters after contexts of up to ORDER characters, counted exactly. The verdicts use all of them: an order of
up to KEPT rows is broadcast, a larger one is joined by a shuffle of places. A url without a rule is
judged by the difference of its two log-likelihoods a character, against a threshold calibrated on labelled
urls kept from training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_table

#: Longest context; (context, character) rows of an order that are broadcast at most (some 10 MB each); prior
#: weight of the next shorter context; characters that there can be.
ORDER, KEPT, PRIOR, CHARACTERS = 4, 1 << 17, 4.0, 0x110000
#: One in so many labelled urls calibrates and doesn't train.
CALIBRATE = 5
_LOW, _UP = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: from there up to
    ``?``, ``#`` or the end. Null and urls without ``://`` have neither (empty)."""
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UP, _LOW), path


def best_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. Rules are (verdict, ``host/path start``); of
    rules that are equally long the first wins. A rule fits its host and all subdomains."""
    fits, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule in sorted(rules[::-1], key=lambda r: len(r[1])):
        name, slash, start = rule.partition("/")
        own = (host == name) | F.endswith(host, F.lit("." + name))
        ok = own & F.startswith(path, F.lit(slash + start))
        fits, verdict = F.when(ok, rule).otherwise(fits), F.when(ok, what).otherwise(verdict)
    return fits, verdict


def _padded(url: Column) -> Column:
    """The url's characters, after ORDER marks and before one: both can be in no url's place twice over."""
    return F.concat(F.lit("\x02" * ORDER), F.coalesce(url, F.lit("")), F.lit("\x03"))


def _places(rows: DataFrame) -> DataFrame:
    """Each row once for each character of its url and for the mark at its end, with that character's place ``_i``."""
    text = rows.withColumn("_t", _padded(F.col("url")))
    return text.withColumn("_i", F.explode(F.sequence(F.lit(ORDER + 1), F.length("_t"))))


def count_tables(labelled: DataFrame, whole: bool = False) -> DataFrame:
    """(o, g, x, a, b, ta, tb): how often character x follows the context g of length o in urls allowed (a) and
    blocked (b), and anything follows it (ta, tb), from (url, label, n).

    Counts are summed before they shuffle. All contexts return if ``whole``; else, of each order, those that are
    most frequent, by powers of two, with all their characters, KEPT rows at most."""
    places = _places(labelled.select("url", F.when(F.col("label") == "allow", F.col("n")).otherwise(0).alias("a"), F.when(F.col("label") == "block", F.col("n")).otherwise(0).alias("b")))
    grams = [F.struct(F.lit(o).alias("o"), F.substring("_t", F.col("_i") - o, F.lit(o)).alias("g"), F.substring("_t", F.col("_i"), F.lit(1)).alias("x")) for o in range(ORDER + 1)]
    flat = places.select(F.explode(F.array(*grams)).alias("g"), "a", "b")
    counts = cut(flat.groupBy("g.o", "g.g", "g.x").agg(F.sum("a").cast("double").alias("a"), F.sum("b").cast("double").alias("b")))
    totals = counts.groupBy("o", "g").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"), F.count("*").alias("k"))
    totals = cut(totals.withColumn("level", F.floor(F.log2(F.col("ta") + F.col("tb"))).cast("int")))
    if whole:
        kept = cut(counts.join(totals.select("o", "g", "ta", "tb"), ["o", "g"]))
        drop_table(counts)
        drop_table(totals)
        return kept
    sizes = totals.groupBy("o", "level").agg(F.sum("k").alias("k")).collect()
    keep = F.lit(False)
    for o in range(ORDER + 1):
        rows, least = 0, 64
        for level, k in sorted(((r["level"], r["k"]) for r in sizes if r["o"] == o), reverse=True):
            rows += k
            if rows > KEPT:
                break
            least = level
        keep = keep | ((F.col("o") == o) & (F.col("level") >= least))
    kept = cut(counts.join(totals.where(keep).select("o", "g", "ta", "tb"), ["o", "g"]))
    drop_table(counts)
    drop_table(totals)
    return kept


def differences(rows: DataFrame, tables: DataFrame) -> DataFrame:
    """``rows``, a table with a column url, and ``difference``: the log-likelihood of the url under the allowed
    model less that under the blocked one, a character. Rows return once each.

    Orders of KEPT rows at most are broadcast; for a larger one the places of all urls, a few characters each, are
    shuffled to its contexts."""
    keyed = cut(rows.withColumn("_rid", F.monotonically_increasing_id()))
    at = _places(keyed.select("_rid", "url")).select("_rid", F.substring("_t", F.col("_i") - ORDER, F.lit(ORDER + 1)).alias("_c"))
    sizes = {r["o"]: r["count"] for r in tables.groupBy("o").count().collect()}
    p = {"a": F.lit(1.0 / CHARACTERS), "b": F.lit(1.0 / CHARACTERS)}
    for o in range(ORDER + 1):
        own = tables.where(F.col("o") == o)
        one = own.select(F.concat("g", "x").alias(f"_g{o}"), F.col("a").alias(f"_a{o}"), F.col("b").alias(f"_b{o}"))
        all_ = own.groupBy(F.col("g").alias(f"_h{o}")).agg(F.first("ta").alias(f"_ta{o}"), F.first("tb").alias(f"_tb{o}"))
        shared = F.broadcast if sizes.get(o, 0) <= KEPT else (lambda t: t.hint("merge"))
        at = at.join(shared(one), F.substring("_c", ORDER + 1 - o, o + 1) == F.col(f"_g{o}"), "left")
        at = at.join(shared(all_), F.substring("_c", ORDER + 1 - o, o) == F.col(f"_h{o}"), "left")
        p = {x: (F.coalesce(f"_{x}{o}", F.lit(0.0)) + F.lit(PRIOR) * p[x]) / (F.coalesce(f"_t{x}{o}", F.lit(0.0)) + F.lit(PRIOR)) for x in p}
    found = at.groupBy("_rid").agg((F.sum(F.ln(p["a"]) - F.ln(p["b"])) / F.count("*")).alias("difference"))
    return keyed.join(found, "_rid").drop("_rid")


def fit(labelled: DataFrame) -> tuple[DataFrame, float]:
    """Count tables and threshold from (url, label), label allow or block. The threshold lies midway between
    the two classes' mean differences on the urls that calibrate, or at 0 where a class has none."""
    labelled = labelled.groupBy("url", "label").agg(F.count("*").alias("n"))
    kept = F.pmod(F.xxhash64("url", F.lit("calibrate")), F.lit(CALIBRATE)) == 0
    tables = count_tables(labelled.where(~kept), whole=True)
    scored = differences(labelled.where(kept), tables)
    means = {r["label"]: r["m"] for r in scored.groupBy("label").agg((F.sum(F.col("difference") * F.col("n")) / F.sum("n")).alias("m")).collect()}
    return tables, (means["allow"] + means["block"]) / 2 if means.keys() >= {"allow", "block"} else 0.0


def judge(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, difference) of every row of ``pages``.

    The verdict is the longest fitting rule's; without one, allow where the language models' difference is
    at the threshold or above, else block. Null and empty urls, which no rule fits, are judged by the models too.
    Where rules label urls of one class only, that class is the verdict of all; without any labelled url it is allow. Rows with a null or repeated id return like any other; other
    columns are not read."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")).withColumn("host", host).withColumn("path", path)
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("given", verdict)
    labelled = rows.where("given IS NOT NULL").select("url", F.col("given").alias("label"))
    classes = sorted(r[0] for r in labelled.select("label").distinct().collect())
    if len(classes) < 2:
        own = F.lit(classes[0] if classes else "allow")
        return rows.select("page_id", "host", "path", "rule", F.coalesce("given", own).alias("verdict"), F.lit(None).cast("double").alias("difference"))
    tables, threshold = fit(labelled)
    ruled = rows.where("given IS NOT NULL").withColumn("difference", F.lit(None).cast("double"))
    scored = differences(rows.where("given IS NULL"), tables)
    own = F.when(F.col("difference") >= threshold, "allow").otherwise("block")
    return ruled.unionByName(scored).select("page_id", "host", "path", "rule", F.coalesce("given", own).alias("verdict"), "difference")
