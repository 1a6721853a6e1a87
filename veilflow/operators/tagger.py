"""Named entities by a tagger that is learnt here: an averaged perceptron over hashed features, the best sequence by Viterbi.

It learns from texts with spans - reviewed ones, or what the detectors find - in distributed rounds: each task goes
once over its texts from common weights, and the averages that tasks come to are averaged again (iterative parameter
mixing). Tagging is a column: the weights are broadcast, ROWS and the types bound their size."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import SPANS
from .search import _SPAN, arrow_column

#: Hashed features; words that are decoded at once, and the words that two windows share. Weights take 4 bytes a
#: feature and tag: 15 MB for three types.
ROWS, WINDOW, SHARED = 1 << 18, 240, 40
SCORE = 0.75
_TOKEN = re.compile(r"\w+|[^\w\s]")


def tags(types: tuple[str, ...]) -> list[str]:
    return ["O", *(f"{k}-{t}" for t in types for k in "BI")]


def tokens(line: str) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(line)]


def _shape(word: str) -> str:
    kinds = ["X" if c.isupper() else "x" if c.islower() else "9" if c.isdigit() else c for c in word[:12]]
    return "".join(c for i, c in enumerate(kinds) if i < 1 or kinds[i - 1] != c)


@lru_cache(1 << 16)
def _of_word(word: str, what: str) -> tuple[int, ...]:
    low = word.lower()
    own = (f"{what}w{low}", f"{what}s{_shape(word)}") if what != "0" else (f"0w{low}", f"0s{_shape(word)}", f"0p{low[:3]}", f"0e{low[-3:]}", f"0l{low[-1:]}{len(low) > 3}")
    return tuple(zlib.crc32(x.encode()) % ROWS for x in own)


def features(words: list[str]) -> np.ndarray:
    """Feature rows of each word (words x 10): its form, shape and ends, and forms and shapes around it."""
    around = ["<", *words, ">"]
    rows = [(zlib.crc32(b"bias") % ROWS, *_of_word(w, "0"), *_of_word(around[i], "-"), *_of_word(around[i + 2], "+")) for i, w in enumerate(words)]
    return np.array(rows, np.int64).reshape(len(words), 10)


@dataclass
class Tagger:
    types: tuple[str, ...]
    weights: np.ndarray  # ROWS x tags
    moves: np.ndarray  # tags x tags, from and to

    @classmethod
    def blank(cls, types: tuple[str, ...]) -> Tagger:
        n = 2 * len(types) + 1
        return cls(tuple(types), np.zeros((ROWS, n), np.float32), np.zeros((n, n), np.float32))

    def forbidden(self) -> tuple[np.ndarray, np.ndarray]:
        """Moves that aren't allowed, and tags that none begins with: an I goes on with a B or I of its own type."""
        n = len(self.moves)
        inside = np.arange(2, n, 2)
        out = np.zeros((n, n), bool)
        out[:, inside] = True
        out[inside, inside] = out[inside - 1, inside] = False
        start = np.zeros(n, bool)
        start[inside] = True
        return out, start

    def decode(self, scores: np.ndarray) -> np.ndarray:
        """The best allowed sequence of tags for scores (words x tags); of equally good ones that of the smallest tags, the last first."""
        out, start = self.forbidden()
        moves = np.where(out, -np.inf, self.moves)
        best = np.where(start, -np.inf, scores[0])
        back = np.zeros(scores.shape, np.int64)
        for i in range(1, len(scores)):
            ways = best[:, None] + moves
            back[i] = ways.argmax(axis=0)
            best = ways[back[i], np.arange(len(best))] + scores[i]
        path = np.zeros(len(scores), np.int64)
        path[-1] = int(best.argmax())
        for i in range(len(scores) - 1, 0, -1):
            path[i - 1] = back[i, path[i]]
        return path

    def tag(self, words: list[str]) -> np.ndarray:
        """Tags of any number of words; beyond WINDOW in windows that share SHARED words, of which each gives half."""
        if not words:
            return np.zeros(0, np.int64)
        path = np.zeros(len(words), np.int64)
        at = 0
        while True:
            end = min(at + WINDOW, len(words))
            first = at + SHARED // 2 if at else 0
            own = self.decode(self.weights[features(words[at:end])].sum(axis=1))
            path[first:end] = own[first - at :]
            if end == len(words):
                return path
            at = end - SHARED

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """(type, start, end) in a text, line by line: no name goes over the end of a line."""
        found, at = [], 0
        for line in text.split("\n"):
            places = tokens(line)
            path = self.tag([line[a:b] for a, b in places]).tolist()
            for k, t in enumerate(path):
                if t % 2:  # begins
                    last = k
                    while last + 1 < len(path) and path[last + 1] == t + 1:
                        last += 1
                    found.append((self.types[t // 2], at + places[k][0], at + places[last][1]))
            at += len(line) + 1
        return found


def gold(line: str, places: list[tuple[int, int]], spans: list[tuple[str, int, int]], types: tuple[str, ...]) -> np.ndarray:
    """Tags of a line's words from spans (type, start, end) in the line's offsets: words that a span touches, the first as B."""
    out = np.zeros(len(places), np.int64)
    for kind, a, b in spans:
        if kind in types:
            inside = [k for k, (x, y) in enumerate(places) if x < b and y > a]
            out[inside] = 2 * types.index(kind) + 2
            out[inside[:1]] = 2 * types.index(kind) + 1
    return out


class _Pass:
    """One pass of the averaged perceptron from given weights."""

    def __init__(self, start: Tagger):
        self.model = Tagger(start.types, start.weights.copy(), start.moves.copy())
        self.late_w, self.late_m, self.steps = np.zeros_like(start.weights, np.float64), np.zeros_like(start.moves, np.float64), 1

    def show(self, words: list[str], want: np.ndarray) -> None:
        rows = features(words)
        got = self.model.decode(self.model.weights[rows].sum(axis=1))
        for sign, path in ((1, want), (-1, got)) if (got != want).any() else ():
            at = rows.ravel(), np.repeat(path, rows.shape[1])
            np.add.at(self.model.weights, at, sign)
            np.add.at(self.late_w, at, sign * self.steps)
            np.add.at(self.model.moves, (path[:-1], path[1:]), sign)
            np.add.at(self.late_m, (path[:-1], path[1:]), sign * self.steps)
        self.steps += 1

    def average(self) -> Tagger:
        return Tagger(self.model.types, self.model.weights - self.late_w / self.steps, self.model.moves - self.late_m / self.steps)


def _learner(model_):
    def run(batches):
        start, one = model_.value, None
        for batch in batches:
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                own, at = [(x["entity_type"], x["start"], x["end"]) for x in spans or ()], 0
                for line in (text or "").split("\n"):
                    places = tokens(line)
                    here = [(k, a - at, b - at) for k, a, b in own if a < at + len(line) and b > at]
                    at += len(line) + 1
                    if places:
                        one = one or _Pass(start)
                        want, words = gold(line, places, here, start.types), [line[a:b] for a, b in places]
                        for i in range(0, len(words), WINDOW):
                            part = want[i : i + WINDOW].copy()
                            if part[0] and part[0] % 2 == 0:
                                part[0] -= 1  # a name that began in the window before
                            one.show(words[i : i + WINDOW], part)
        if one is None:
            return
        new, n = one.average(), len(start.moves)
        change = np.concatenate([new.weights - start.weights, new.moves - start.moves]).astype(np.float64)
        rows = np.r_[np.flatnonzero(change.any(axis=1)), len(change)]  # the last one counts tasks
        values = np.concatenate([change, np.r_[1.0, np.zeros(n - 1)][None]])[rows]
        for a in range(0, len(rows), 1 << 14):
            yield pa.RecordBatch.from_arrays([pa.array(rows[a : a + (1 << 14)].astype(np.int32)), *(pa.array(np.ascontiguousarray(values[a : a + (1 << 14), j])) for j in range(n))], ["row", *(f"w{j}" for j in range(n))])

    return run


def learn(examples: DataFrame, types: tuple[str, ...], rounds: int = 5) -> Tagger:
    """A tagger of ``types`` from a table (text, spans). Words outside the spans are examples, too.

    Rows count as often as they are there; null texts and empty tables teach nothing. Weights depend on how the
    rows lie in partitions, not on which task is done first."""
    spark, model = examples.sparkSession, Tagger.blank(tuple(types))
    n = len(model.moves)
    schema = "row int, " + ", ".join(f"w{j} double" for j in range(n))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)
        sums = examples.select("text", "spans").mapInArrow(_learner(shared), schema).groupBy("row").agg(*[F.sum(f"w{j}").alias(f"w{j}") for j in range(n)]).toArrow()
        row, value = sums["row"].to_numpy(), np.stack([sums[f"w{j}"].to_numpy() for j in range(n)], axis=1) if len(sums) else np.zeros((0, n))
        tasks = float(value[row == ROWS + n, 0].sum())
        shared.unpersist()
        if not tasks:
            break
        weights, moves = model.weights.copy(), model.moves.copy()
        weights[row[row < ROWS]] += (value[row < ROWS] / tasks).astype(np.float32)
        inner = (row >= ROWS) & (row < ROWS + n)
        moves[row[inner] - ROWS] += (value[inner] / tasks).astype(np.float32)
        model = Tagger(model.types, weights, moves)
    return model


def tagged(text: Column, model, score: float = SCORE) -> Column:
    """Spans that a tagger (or a broadcast of one, which a job's plans can share) finds; null texts have none."""

    def run(texts: pa.Array) -> pa.Array:
        own = model if isinstance(model, Tagger) else model.value
        return pa.array([[{"entity_type": k, "start": a, "end": b, "score": score, "surface": t[a:b]} for k, a, b in own.spans(t)] if t else [] for t in texts.to_pylist()], pa.list_(_SPAN))

    return arrow_column(run, SPANS, text)


def recognizer(spark, model: Tagger, name: str = "tagger"):
    """A recognizer for a configuration's plugins: what it finds goes through the same overlaps and filters as all else."""
    from .recognizers import Recognizer

    shared = spark.sparkContext.broadcast(model)
    return Recognizer(name, model.types, lambda text: tagged(text, shared))
