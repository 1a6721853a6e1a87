"""Exact top-k search by integer inner product: columnar branch and bound.

Candidates lie in vertical layout, one row a dimension. Scores accumulate block of dimensions by block of
dimensions; what the dimensions still to come can add is bounded by the product of the remaining norms
of query and candidate (Cauchy-Schwarz). Pairs whose bound stays below the query's k-th best so far
are dropped, and the survivors are compacted before the next block. Queries are dealt to blocks by their
bytes, one scan and broadcast each, so what a task holds doesn't grow with the table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, lean

#: Bytes of the queries of one block, which is broadcast; dimensions of one step.
QUERY_BYTES, STEP = 1 << 25, 16
#: Queries and candidates that are scored together.
QUERIES, CHUNK = 2048, 2048
_SAFE = 1 << 52


def quantised(vector, scale: int = 256):
    """floor(scale * x) of each component as a double, as longs; null if the vector is null or empty or
    holds a null or a component that isn't finite."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    return F.when(F.coalesce(ok, F.lit(False)) & (F.size(vector) > 0), whole)


class Search:
    """The best k of a stream of candidates for each query of a block of one dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.k, self.q = ids, k, vectors.astype(np.float64)
        self.score = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        d = vectors.shape[1]
        self.cuts = list(range(0, d, STEP)) + [d]
        self.left = self._left(self.q)

    def _left(self, v: np.ndarray) -> np.ndarray:
        """Norm of what is left of each vector from each cut on."""
        mass = np.stack([(v[:, a:b] ** 2).sum(axis=1) for a, b in zip(self.cuts, self.cuts[1:])] + [np.zeros(len(v))])
        return np.sqrt(mass[::-1].cumsum(axis=0)[::-1]) * (1 + 1e-9) + 1e-9

    def show(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        for a in range(0, len(ids), CHUNK):
            self._chunk(ids[a : a + CHUNK], vectors[a : a + CHUNK])

    def _chunk(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        vertical = np.ascontiguousarray(vectors.T, np.float64)
        left = self._left(np.ascontiguousarray(vertical.T))
        worst = self.score[:, -1]
        part = self.q[:, : self.cuts[1]] @ vertical[: self.cuts[1]]
        live = part + self.left[1][:, None] * left[1] >= worst[:, None]
        live &= self.ids[:, None] != ids
        row, col = np.nonzero(live)
        score = part[row, col]
        for s in range(1, len(self.cuts) - 1):
            a, b = self.cuts[s], self.cuts[s + 1]
            if len(row) * 8 > part.size:  # most survive: a whole block product is cheaper than gathering
                score = score + (self.q[:, a:b] @ vertical[a:b])[row, col]
            else:
                for j in range(a, b):
                    score = score + self.q[row, j] * vertical[j, col]
            keep = score + self.left[s + 1][row] * left[s + 1][col] >= worst[row]
            row, col, score = row[keep], col[keep], score[keep]
        self._merge(row, score, ids[col])

    def _merge(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(row):
            return
        own = np.unique(row)
        row = np.r_[row, np.repeat(own, self.k)]
        score, ids = np.r_[score, self.score[own].ravel()], np.r_[ids, self.found[own].ravel()]
        order = np.lexsort((ids, -score, row))
        row, score, ids = row[order], score[order], ids[order]
        first = np.searchsorted(row, own)
        at = first[:, None] + np.arange(self.k)
        self.score[own], self.found[own] = score[at], ids[at]

    def results(self):
        q, r = np.nonzero(np.isfinite(self.score))
        return self.ids[q], self.found[q, r], self.score[q, r].astype(np.int64)


def _exact(ids, vectors, found: dict, queries, k: int) -> None:
    """For components too large for exact doubles: whole numbers of any size, saturated at 64 bits."""
    top = (1 << 63) - 1
    for q, v in queries:
        best = found.setdefault(q, [])
        best += [(-max(-top - 1, min(top, sum(x * y for x, y in zip(v, w)))), i) for i, w in zip(ids, vectors) if i != q]
        best.sort()
        del best[k:]


def _by_length(vectors: pa.Array):
    """(row numbers, matrix) of the vectors of each length."""
    sizes = np.diff(vectors.offsets.to_numpy())
    values, starts = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()[:-1]
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        yield d, rows, values[starts[rows][:, None] + np.arange(d)]


def _task(queries_, k: int):
    def run(batches):
        searches = {d: [Search(ids[a : a + QUERIES], m[a : a + QUERIES], k) for a in range(0, len(ids), QUERIES)] for d, ids, m in queries_.value}
        most = {d: int(np.abs(m).max(initial=0)) for d, _, m in queries_.value}
        slow: dict = {}
        for batch in batches:
            ids = batch.column("vec_id").to_numpy()
            for d, rows, m in _by_length(batch.column("v")):
                if d not in searches:
                    continue
                if most[d] * int(np.abs(m).max(initial=0)) * d < _SAFE:
                    for one in searches[d]:
                        one.show(ids[rows], m)
                else:
                    own = next(x for x in queries_.value if x[0] == d)
                    _exact(ids[rows].tolist(), m.tolist(), slow, list(zip(own[1].tolist(), own[2].tolist())), k)
        out = [s.results() for own in searches.values() for s in own]
        out += [(np.array([q] * len(b)), np.array([i for _, i in b]), np.array([-s for s, _ in b])) for q, b in slow.items() if b]
        for q, v, s in out:
            if len(q):
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (q, v, s)], ["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each query, ties to the smaller id.

    Scores are inner products of floor(scale * x). A query is no candidate for itself; only vectors of its
    own length are candidates for it. Vectors that are null or empty, or hold a null or a component that isn't
    finite, and rows with a null id take no part. Of queries that repeat an id one is asked, the one with the least
    vector; rows that repeat a query's id count as its own and are no candidates for it; other candidates
    that repeat an id are candidates each. Scores beyond 64 bits stop at their ends.

    Queries are read to the driver in blocks of about QUERY_BYTES, one scan of the candidates each; a task returns
    k rows a query at most. With several blocks each one's result is written before the next begins, and its
    broadcast is given back."""
    sc = vectors.sparkSession.sparkContext
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col), scale).alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    asked = queries.select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col), scale).alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    asked = asked.groupBy("vec_id").agg(F.min("v").alias("v"))
    size = asked.agg(F.sum(F.size("v") + 1)).first()[0] or 0
    blocks = max(1, -(-size * 8 // QUERY_BYTES))
    asked = cut(asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).repartition(min(blocks, 64), "block"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = None
    for b in range(blocks):
        table = asked.where(F.col("block") == b).select("vec_id", "v").toArrow().combine_chunks()
        ids, lists = table["vec_id"].to_numpy(), table["v"].combine_chunks()
        lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.int64()))
        block = sc.broadcast([(d, ids[r], m) for d, r, m in _by_length(lists)])
        part = rows.mapInArrow(lean(_task(block, k)), "query_id long, vec_id long, score long")
        part = part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        if blocks > 1:
            part = cut(part)
            block.destroy()
        found = part if found is None else found.unionByName(part)
    return found
