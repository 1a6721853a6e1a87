"""Quality classifier: a sparse ensemble of rules over text statistics.

Small boosted trees are grown on statistics of labelled documents; each path from a root is a
conjunction of thresholds, a rule. A lasso-penalised logistic regression picks few rules and weighs
them, and the model is compiled to one Spark column expression over the statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import filled, lean, steps, text_bytes, train_rows, words

#: Statistics of a text, all doubles; all are 0 for an empty text.
STATS = ("words", "word_bytes", "distinct", "top_word", "repeat", "upper", "digit", "symbol", "pipe", "wide", "breaks", "doubled", "ended", "capital")
#: Labelled rows that a fit uses at most: those with the smallest hash of their id.
MOST_LABELLED = 20_000
_CLASS = np.zeros((256, 6), bool)
_CLASS[65:91, 0] = True
_CLASS[48:58, 1] = True
_CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)], 2] = True
_CLASS[124, 3] = True
_CLASS[128:, 4] = True
_CLASS[10, 5] = True
_MARK = _CLASS[:, 2]


def statistics(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """STATS of texts that lie end to end in ``data``: one row a text."""
    n = len(places) - 1
    out = np.zeros((n, len(STATS)))
    if not len(data):
        return out
    size = np.maximum(np.diff(places), 1)

    def per_text(flags: np.ndarray) -> np.ndarray:
        run = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=run[1:])
        return run[places[1:]] - run[places[:-1]]

    for j, k in ((5, 0), (6, 1), (7, 2), (8, 3), (9, 4), (10, 5)):
        out[:, j] = per_text(_CLASS[data, k]) / size
    mark = _MARK[data]
    same = np.zeros(len(data), bool)
    same[1:] = mark[1:] & (data[1:] == data[:-1])
    out[:, 11] = per_text(same) / size
    h, first, last, text = words(data, places)
    count = np.bincount(text, minlength=n)
    most = np.maximum(count, 1)
    out[:, 0] = np.log1p(count)
    out[:, 1] = np.bincount(text, weights=last - first, minlength=n) / most
    out[:, 12] = np.bincount(text, weights=mark[last - 1], minlength=n) / most if len(h) else 0
    out[:, 13] = np.bincount(text, weights=_CLASS[data[first], 0], minlength=n) / most if len(h) else 0
    if len(h):
        again = np.r_[False, (h[1:] == h[:-1]) & (text[1:] == text[:-1])]
        out[:, 4] = np.bincount(text, weights=again, minlength=n) / most
        order = np.lexsort((h, text))
        new = np.r_[True, (h[order][1:] != h[order][:-1]) | (text[order][1:] != text[order][:-1])]
        at = np.flatnonzero(new)
        out[:, 2] = np.bincount(text[order][at], minlength=n) / most
        top = np.zeros(n)
        np.maximum.at(top, text[order][at], np.diff(np.r_[at, len(h)]))
        out[:, 3] = top / most
    return out


def _stats_of(texts: pa.Array) -> np.ndarray:
    found = [statistics(*text_bytes(texts.slice(a, b - a))) for a, b in steps(texts)]
    return np.concatenate(found) if found else np.zeros((0, len(STATS)))


def _with_stats(text_col: str):
    def run(batches):
        for batch in batches:
            stats = _stats_of(filled(batch.column(text_col)))
            column = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(stats[:, j])) for j in range(len(STATS))], names=list(STATS))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, NAME])

    return run


#: Column that holds the statistics; not a name that a table is likely to have.
NAME = "__quality_stats"


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct of STATS; null texts count as empty."""
    schema = T.StructType([*docs.schema.fields, T.StructField(NAME, T.StructType([T.StructField(s, T.DoubleType()) for s in STATS]))])
    return docs.mapInArrow(lean(_with_stats(text_col)), schema)


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above?, threshold), all of which must hold


@dataclass
class Model:
    bias: float
    rules: list[tuple[Rule, float]]

    def score(self, stats: Column | None = None) -> Column:
        """The probability of label 1 as a column expression over the struct of statistics."""
        stats = F.col(NAME) if stats is None else stats
        total = F.lit(float(self.bias))
        for rule, weight in self.rules:
            holds = F.lit(True)
            for j, above, at in rule:
                x = stats.getField(STATS[j])
                holds = holds & ((x > float(at)) if above else (x <= float(at)))
            total = total + F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _holds(x: np.ndarray, rule: Rule) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for j, above, at in rule:
        ok &= (x[:, j] > at) if above else (x[:, j] <= at)
    return ok


def _grow(x: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, path: Rule, depth: int, out: list, step: np.ndarray, least: int) -> None:
    """Split ``rows`` where the second-order gain is largest; collect each node's path."""
    best = (1e-6, None)
    base = g[rows].sum() ** 2 / (h[rows].sum() + 1)
    if depth and len(rows) >= 2 * least:
        for j, at in enumerate(cuts):
            if not len(at):
                continue
            bin_ = np.searchsorted(at, x[rows, j], "left")
            gs, hs, ns = (np.cumsum(np.bincount(bin_, weights=w, minlength=len(at) + 1))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
            gain = gs**2 / (hs + 1) + (g[rows].sum() - gs) ** 2 / (h[rows].sum() - hs + 1) - base
            gain[(ns < least) | (len(rows) - ns < least)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (j, float(at[k])))
    if best[1] is None:
        step[rows] = -g[rows].sum() / (h[rows].sum() + 1)
        return
    j, at = best[1]
    for above in (False, True):
        own = rows[(x[rows, j] > at) == above]
        out.append((*path, (j, above, at)))
        _grow(x, cuts, g, h, own, (*path, (j, above, at)), depth - 1, out, step, least)


def _lasso(r: np.ndarray, y: np.ndarray, lam: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty, by accelerated proximal gradient steps."""
    n, m = r.shape
    w, bias = np.zeros(m), float(np.log(y.mean() / (1 - y.mean())))
    v, vb, t = w.copy(), bias, 1.0
    norm = np.ones(m) / np.sqrt(m)
    for _ in range(20):
        norm = r.T @ (r @ norm)
        norm /= np.linalg.norm(norm) or 1
    rate = 4 * n / (np.linalg.norm(r @ norm) ** 2 + n)
    for _ in range(rounds):
        d = (1 / (1 + np.exp(-(r @ v + vb))) - y) / n
        new = v - rate * (r.T @ d)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * lam, 0)
        nb = vb - rate * d.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - bias)
        w, bias, t = new, nb, t2
    return bias, w


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 16, depth: int = 3, lam: float = 5e-4, seed: int = 7) -> Model:
    """A rule ensemble from statistics (rows x STATS) and labels 0 or 1. With one label only, or no rows,
    the score is the smoothed share of label 1 everywhere."""
    y = y.astype(float)
    if len(y) < 20 or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 1)
        return Model(float(np.log(p / (1 - p))), [])
    rng = np.random.default_rng(seed)
    cuts = []
    for j in range(x.shape[1]):
        q = np.unique(np.quantile(x[:, j], np.linspace(0, 1, 65)[1:-1], method="lower"))
        values = np.unique(x[:, j])
        up = values[np.minimum(np.searchsorted(values, q, "right"), len(values) - 1)]
        cuts.append(np.unique((q + up) / 2)[(np.unique((q + up) / 2) < values[-1])])
    f, paths = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        rows = rng.permutation(len(y))[: max(20, int(0.7 * len(y)))]
        step = np.zeros(len(y))
        own: list[Rule] = []
        _grow(x, cuts, p - y, p * (1 - p), np.sort(rows), (), depth, own, step, max(5, len(y) // 500))
        paths += own
        f += 0.3 * step
    rules = list(dict.fromkeys(paths))
    if not rules:
        return Model(float(np.log(y.mean() / (1 - y.mean()))), [])
    r = np.stack([_holds(x, rule) for rule in rules], 1).astype(float)
    bias, w = _lasso(r, y, lam)
    return Model(bias, [(rule, float(wi)) for rule, wi in zip(rules, w) if abs(wi) > 1e-6])


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", most: int = MOST_LABELLED) -> Model:
    """Learn from the labelled rows of ``stats`` (id and statistics); at most about ``most`` of them, told
    by the hash of their id, go to the driver. Null labels and ids don't count."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where(F.col("_y").isin(0, 1))
    rows = stats.join(known, F.col(id_col) == F.col("_id")).select(F.xxhash64("_id").alias("h"), "_id", "_y", *[F.col(NAME).getField(s).alias(s) for s in STATS])
    # a threshold on the hash, not a sort, picks them: tasks send the driver no more than it keeps
    share = most / max(known.count(), 1)
    if share < 1:
        rows = rows.where(F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53)) < share)
    table = rows.toPandas().sort_values(["h", "_id", "_y", *STATS]).head(most)
    return fit_rules(table[list(STATS)].to_numpy(float), table["_y"].to_numpy())


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", modulus: int = 3, held: int = 1, most: int = MOST_LABELLED) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` (0 to 1, higher where label 1 is likelier) and ``predicted``.

    Labels are learned only from rows that aren't held out: crc32 of the id as text leaves ``held`` when
    divided by ``modulus``. Scores see the text alone. Null texts are empty texts; rows with a null id are
    scored and not held out; an empty table gives no rows. Columns of ``docs`` named like the three new
    ones are replaced."""
    held_out = train_rows(id_col, modulus, held)
    model = fit(with_statistics(docs.where(~held_out).select(id_col, text_col), text_col).select(id_col, NAME), labels, id_col, label_col, most)
    scored = with_statistics(docs, text_col).withColumn("held_out", held_out).withColumn("score", model.score())
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).drop(NAME)
