"""Language-model scoring by a hashed maximum-entropy model.

The next token depends on hashed features of the words before it: the last word, the last two, a skip to the
second last, and the classes of the last three by their last letters. The softmax is factored by class: a class of
32, and in the first HEADS classes, of frequent words, a group of 16 and a word of 16 in the group. All
other words belong to classes told by their last letters, and share their class by smoothed counts - so
every word, known or not, has a probability, and all of them sum to one. (Places of rare words told by
hashes, learnt like those of frequent ones, made held-out texts likelier by less.) Weights are learnt by rounds of distributed gradient updates: a task follows the gradient over its own
documents of the round from the common weights, and the changes are averaged by token. Every training
document is in one round. The weight table grows with the square root of the training tokens, and the
tasks that learn do as well, so that what they exchange grows in step with the input.

Counts of words cover all training documents. The most frequent words, a bounded number, travel to the
tasks; the others are looked up by a join, and no text moves."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_KEYS, LOWER_KEYS, cut, drop_table, filled, lean, mix, steps, text_bytes, train_rows, words

#: Members of a softmax within a class. Classes of frequent words (END is one of them), and of all other words.
SLOTS, HEADS, TAILS = 16, 8, 24
CLASSES = HEADS + TAILS
GROUP = SLOTS * SLOTS
#: Words that a softmax of their own class tells apart; the places of all other words follow, one a class.
HEAD_WORDS = HEADS * GROUP
#: Classes of words by their last two letters, for the history.
ENDINGS = 30
#: Features of a token, and columns of the weight table: one softmax of each level.
FEATURES, WIDTH = 4, CLASSES + 2 * SLOTS
#: Rows of the hashed weight table that features share: least and most (67 MB).
LEAST_ROWS, MOST_ROWS = 1 << 13, 1 << 18
#: Training tokens for each row and task that a task sees in a round at least.
TOKENS_PER_ROW = 32
#: Words that are sent to every task at most.
FREQUENT = 1 << 17
ROUNDS, STEP_TOKENS, RATE = 4, 16384, 0.5
#: Rows of a gradient that one pass adds up.
PART = 8
END = np.uint64(0x5851F42D4C957F2D)
_SALTS = mix(np.arange(1, 40, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def table_rows(tokens: int) -> int:
    """Rows of the weight table for so many training tokens: a power of two near the root of 32 times as many."""
    return int(min(max(1 << int(np.log2(max(32 * tokens, 1)) / 2), LEAST_ROWS), MOST_ROWS))


@dataclass
class Tokens:
    """Tokens of some texts, each text closed by END: hash, tail class and class for the history by the last letters, text, place in it."""

    h: np.ndarray
    tail: np.ndarray
    ending: np.ndarray
    text: np.ndarray
    first: np.ndarray  # index of the first token of each token's text


def tokenize(data: np.ndarray, places: np.ndarray) -> Tokens:
    h, a, b, text = words(data, places)
    n = len(places) - 1
    count = np.bincount(text, minlength=n)
    starts = np.r_[0, np.cumsum(count + 1)[:-1]]
    total = int(count.sum()) + n
    at = np.arange(len(h)) + text
    hash_, tail, ending = np.full(total, END), np.zeros(total, np.int8), np.full(total, ENDINGS, np.int8)
    hash_[at] = h
    if len(h):
        last, before = data[b - 1], np.where(b - a > 1, data[np.maximum(b - 2, 0)], 0)
        letters = mix(LOWER_KEYS[last] ^ (LOWER_KEYS[before] << np.uint64(1)))
        ending[at] = (letters >> np.uint64(8)) % np.uint64(ENDINGS)
        tail[at] = letters % np.uint64(TAILS)
    texts = np.repeat(np.arange(n), count + 1)
    return Tokens(hash_, tail, ending, texts, starts[texts])


class Lookup:
    """Indexes of up to FREQUENT hashes, by direct addressing in a few tables."""

    def __init__(self, keys: np.ndarray):
        self.tables, self.bits = [], 19
        left = np.arange(len(keys))
        for shift in (0, 20, 40):
            slot = ((keys[left] >> np.uint64(shift)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)
            own, index = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
            index[slot[::-1]] = left[::-1]  # earlier keys stay
            own[slot] = keys[index[slot]]
            self.tables.append((shift, own, index))
            left = left[index[slot] != left]
        order = np.argsort(keys[left])
        self.rest, self.rest_index = keys[left][order], left[order].astype(np.int32)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out, open_ = np.full(len(h), -1, np.int32), None
        for shift, own, index in self.tables:
            part = h if open_ is None else h[open_]
            slot = ((part >> np.uint64(shift)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)
            got = np.where(own[slot] == part, index[slot], -1)
            if open_ is None:
                out = got
                open_ = np.flatnonzero(got < 0)
            else:
                out[open_] = got
                open_ = open_[got < 0]
        if len(self.rest) and len(open_):
            at = np.minimum(np.searchsorted(self.rest, h[open_]), len(self.rest) - 1)
            out[open_] = np.where(self.rest[at] == h[open_], self.rest_index[at], -1)
        return out


def dealt(rank: np.ndarray) -> np.ndarray:
    """Places of words by rank, dealt out in turn to classes, then to groups: all have about the same mass, and the
    most frequent words are told apart by the first levels."""
    return rank % HEADS * GROUP + rank // HEADS % SLOTS * SLOTS + rank // (HEADS * SLOTS)


@dataclass
class Vocabulary:
    """What tasks need of the counts. ``keys`` are the frequent words by falling count."""

    keys: np.ndarray
    counts: np.ndarray
    ends: int  # training documents
    tail_mass: np.ndarray  # log10 of N_k + 0.1 (V_k + 1) for each tail class

    def __post_init__(self):
        # END takes the place among the tokens with weights that its count gives it
        self.lookup = Lookup(self.keys)
        self.n_items = min(len(self.keys) + 1, HEAD_WORDS)
        self.end_item = min(int(np.searchsorted(-self.counts, -self.ends)), self.n_items - 1)
        # without features a place has its share of the counts: biases are logarithms of these
        items = np.insert(self.counts[: self.n_items - 1].astype(float), self.end_item, self.ends) + 0.1
        mass = np.zeros(HEAD_WORDS)
        mass[dealt(np.arange(self.n_items))] = items
        mass = mass.reshape(HEADS, SLOTS, SLOTS)

        def log(m):
            share = m / np.maximum(m.sum(axis=-1, keepdims=True), 1e-30)
            return np.where(m > 0, np.log(np.maximum(share, 1e-30)), -80).astype(np.float32)

        self.bias = log(np.r_[mass.sum((1, 2)), 10.0**self.tail_mass]), log(mass.sum(2)), log(mass.reshape(-1, SLOTS))

    def __getstate__(self):
        return self.keys, self.counts, self.ends, self.tail_mass

    def __setstate__(self, state):
        self.__init__(*state)

    def code(self, t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of each token among the frequent words (-1: not there, -2: END), its place, whether it is in a tail class."""
        index = self.lookup(t.h)
        end = t.h == END
        index[end] = -2
        item = np.where(index >= self.end_item, index + 1, index)
        item[end] = self.end_item
        head = (item >= 0) & (item < self.n_items)
        return index, np.where(head, dealt(item), HEAD_WORDS + t.tail.astype(np.int64)), ~head


def features(t: Tokens, a: int, b: int) -> np.ndarray:
    """Hashes of the features of tokens a to b: FEATURES x tokens."""
    at = np.arange(a, b)

    def back(values, k, none):
        j = at - k
        return np.where(j >= t.first[a:b], values[np.maximum(j, 0)], none)

    one, two = (back(t.h, k, _SALTS[k]) for k in (1, 2))
    e1, e2, e3 = (back(t.ending, k, ENDINGS + 1).astype(np.uint64) for k in (1, 2, 3))
    s = _SALTS
    return np.stack([mix(one + s[11]), mix((e1 * np.uint64(64) + e2) * np.uint64(64) + e3 + s[16]), mix(one * s[12] + two + s[13]), mix(two + s[14])])


class Weights:
    """Weights of the three levels; hashed features share their rows."""

    def __init__(self, table: np.ndarray):
        self.rows = len(table)
        self.levels = [np.ascontiguousarray(table[:, a:b]) for a, b in ((0, CLASSES), (CLASSES, CLASSES + SLOTS), (CLASSES + SLOTS, WIDTH))]

    @property
    def table(self):
        return np.concatenate(self.levels, axis=1)


def new_table(rows: int) -> np.ndarray:
    return np.zeros((rows, WIDTH), np.float32)


def _exps(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp of each row, in place, and its sum; large ones are scaled first."""
    if z.max(initial=0) > 60:
        z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    return z, np.einsum("ij->i", z)


def forward(w: Weights, v: Vocabulary, f: np.ndarray, place: np.ndarray):
    """For each level (tokens that have it, weights of its members, their sum, the token's member, rows of its
    features). The skip, the last feature, tells classes apart, the two last words groups as well; words go by the
    last word and the history."""
    wide, all_ = np.uint64(w.rows - 1), np.arange(len(place))
    heads = np.flatnonzero(place < HEAD_WORDS)
    cls = np.where(place < HEAD_WORDS, place // GROUP, place - HEAD_WORDS + HEADS)
    own = place[heads]
    for level, tokens, node, member in ((0, all_, None, cls), (1, heads, own // GROUP, own // SLOTS % SLOTS), (2, heads, own // SLOTS, own % SLOTS)):
        table = w.levels[level]
        if level:
            rows = ((f[: FEATURES - level, heads] >> np.uint64(20 * level)) + (node.astype(np.uint64) * np.uint64(0x9E3779B1)) & wide).astype(np.int32)
            z = np.take(v.bias[level], node, axis=0)
        else:
            rows = (f & wide).astype(np.int32)
            z = np.tile(v.bias[0], (len(place), 1))
        for r in rows:
            z += np.take(table, r, axis=0)
        yield tokens, *_exps(z), member, rows


def log_probs(w: Weights, v: Vocabulary, t: Tokens, place: np.ndarray) -> np.ndarray:
    """log10 of each token's class, and of its group and place in it where it has one."""
    out = np.empty(len(place))
    for a in range(0, len(place), STEP_TOKENS):
        b = min(a + STEP_TOKENS, len(place))
        p = np.ones(b - a)
        for tokens, z, total, member, _ in forward(w, v, features(t, a, b), place[a:b]):
            p[tokens] *= z[np.arange(len(tokens)), member] / total
        out[a:b] = np.log10(np.maximum(p, 1e-30))
    return out


def _order(rows: np.ndarray) -> np.ndarray:
    """A stable order of row numbers, by radix sorts of 16 bits."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")
    high = rows >> 16
    return order[np.argsort(high[order].astype(np.uint16), kind="stable")] if high.any() else order


def _sums(values: np.ndarray, order: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the rows order[at[i]], order[at[i] + 1], ... of ``values`` up to the next run, for each run i.

    Runs are added up in parts of up to PART rows, longest first: the first rows of all parts, then the second rows of
    those that have one, and so on, whole rows at a time (``reduceat`` takes a step for each column of each run). Runs
    of several parts add up their parts' sums alike."""
    size = np.diff(at, append=len(order))
    parts = -(-size // PART)
    first = np.cumsum(parts) - parts
    k = PART * (np.arange(int(parts.sum())) - np.repeat(first, parts))
    held = np.minimum(np.repeat(size, parts) - k, PART)
    by = np.argsort((PART - held).astype(np.uint8), kind="stable")
    start = (np.repeat(at, parts) + k)[by]
    longer = len(held) - np.cumsum(np.bincount(held, minlength=PART + 1))
    out = np.take(values, order[start], axis=0)
    for j in range(1, PART):
        n = longer[j]
        if not n:
            break
        out[:n] += np.take(values, order[start[:n] + j], axis=0)
    place = np.empty_like(by)
    place[by] = np.arange(len(by))
    many = np.flatnonzero(parts > 1)
    if len(many):
        out[place[first[many]]] = _sums(out, place[np.repeat(parts > 1, parts)], np.cumsum(parts[many]) - parts[many])
    return np.take(out, place[first], axis=0)


def _push(table: np.ndarray, seen: np.ndarray, rows: np.ndarray, grad: np.ndarray) -> None:
    """Adagrad by row: add up the gradient of each row, and step along it."""
    order = _order(rows)
    own = rows[order]
    at = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    g = _sums(grad, order, at)
    r = own[at].astype(np.int64)
    seen[r] += np.einsum("ij,ij->i", g, g)
    g *= (RATE / np.sqrt(1.0 + seen[r]))[:, None]
    table[r] = np.take(table, r, axis=0) - g


class Trainer:
    """Follows the gradient from common weights over the documents that it is shown."""

    def __init__(self, table: np.ndarray, v: Vocabulary):
        self.w, self.v, self.n = Weights(table), v, 0
        self.seen = np.zeros((3, len(table)), np.float32)

    def show(self, t: Tokens) -> None:
        _, place, _ = self.v.code(t)
        for a in range(0, len(place), STEP_TOKENS):
            b = min(a + STEP_TOKENS, len(place))
            for level, (tokens, z, total, member, rows) in enumerate(forward(self.w, self.v, features(t, a, b), place[a:b])):
                z /= total[:, None]
                z[np.arange(len(tokens)), member] -= 1
                for r in rows if len(tokens) else ():
                    _push(self.w.levels[level], self.seen[level], r, z)
        self.n += len(place)


def _tokens(batch, column: str = "text"):
    texts = filled(batch.column(column))
    for a, b in steps(texts):
        yield a, tokenize(*text_bytes(texts.slice(a, b - a)))


def _counter(batches):
    """(h, tail, c): word counts of a task, merged whenever they have grown to a few million."""
    held, size = [], 0

    def merged(parts):
        h, k, c = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(h)
        h, k, c = h[order], k[order], c[order]
        at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        return h[at], k[at], np.add.reduceat(c, at)

    def out(h, k, c):
        for i in range(0, len(h), 1 << 16):
            s = slice(i, i + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(h[s].view(np.int64)), pa.array(k[s].astype(np.int32)), pa.array(c[s])], ["h", "tail", "c"])

    for batch in batches:
        for _, t in _tokens(batch):
            held.append((t.h, t.tail, np.ones(len(t.h), np.int64)))
            size += len(t.h)
            if size > 2_000_000:
                held = [merged(held)]
                size = len(held[0][0])
                if size > 1_500_000:
                    yield from out(*held.pop())
                    size = 0
    if held:
        yield from out(*merged(held))


def count_words(train: DataFrame) -> DataFrame:
    """(h, tail, c) of all training texts; END is a word like any other."""
    counts = train.select("text").mapInArrow(lean(_counter), "h long, tail int, c long")
    return counts.groupBy("h").agg(F.min("tail").alias("tail"), F.sum("c").alias("c"))


def vocabulary(counts: DataFrame) -> tuple[Vocabulary, int, int]:
    """The vocabulary of a table of counts, the number of training tokens and that of distinct ones.

    The frequent words are those over the lowest quarter power of two that leaves FREQUENT at most; the
    driver gets these words and sums by class, never the table."""
    end = int(END.view(np.int64))
    level = F.floor(F.log2("c") * 4).cast("int")
    levels = counts.groupBy(level.alias("level")).agg(F.count("*").alias("v"), F.sum("c").alias("n")).toPandas().sort_values("level", ascending=False)
    if not len(levels):
        return Vocabulary(np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, np.full(TAILS, -1.0)), 0, 0
    ok = levels.v.cumsum() <= FREQUENT
    least = int(levels.level[ok].min()) if ok.any() else int(levels.level.max()) + 1
    top = counts.where((level >= least) | (F.col("h") == end)).toPandas().sort_values(["c", "h"], ascending=[False, True])
    ends = int(top.c[top.h == end].sum())
    top = top[top.h != end]
    by_class = counts.where(F.col("h") != end).groupBy("tail").agg(F.count("*").alias("v"), F.sum("c").alias("n")).toPandas().set_index("tail")
    v = Vocabulary(top.h.to_numpy(np.int64).view(np.uint64), top.c.to_numpy(np.int64), ends, np.zeros(TAILS))
    heads = top.iloc[: v.n_items - 1].groupby("tail").c.agg(["count", "sum"])
    n, kinds = np.zeros(TAILS), np.zeros(TAILS)
    n[by_class.index], kinds[by_class.index] = by_class.n, by_class.v
    n[heads.index] -= heads["sum"]
    kinds[heads.index] -= heads["count"]
    v.tail_mass = np.log10(n + 0.1 * (kinds + 1))
    return v, int(levels.n.sum()), int(levels.v.sum())


def _train_task(table_, vocab_):
    def run(batches):
        trainer = None
        for batch in batches:
            trainer = trainer or Trainer(table_.value, vocab_.value)
            for _, t in _tokens(batch):
                trainer.show(t)
        if trainer is None or not trainer.n:
            return
        change = (trainer.w.table - table_.value) * np.float32(trainer.n)
        rows = np.flatnonzero(change.any(axis=1))
        for i in range(0, len(rows), 2048):
            r = rows[i : i + 2048]
            yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int32)), *(pa.array(np.ascontiguousarray(change[r, j])) for j in range(WIDTH))], ["row", *(f"w{j}" for j in range(WIDTH))])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), *(pa.array([float(trainer.n) if not j else 0.0], pa.float32()) for j in range(WIDTH))], ["row", *(f"w{j}" for j in range(WIDTH))])

    return run


def train(docs: DataFrame, v: Vocabulary, tokens: int, rounds: int = ROUNDS) -> np.ndarray:
    """Weights after ``rounds`` rounds, each over the documents whose hash falls to it. Rows of the weight
    table are summed over tasks by Spark; the driver gets one table of at most MOST_ROWS rows a round."""
    sc = docs.sparkSession.sparkContext
    rows = table_rows(tokens)
    table = new_table(rows)
    tasks = max(1, tokens // (rounds * rows * TOKENS_PER_ROW))
    vocab_ = sc.broadcast(v)
    schema = "row int, " + ", ".join(f"w{j} float" for j in range(WIDTH))
    for k in range(rounds):
        table_ = sc.broadcast(table)
        part = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("round")), F.lit(rounds)) == k).select("text").coalesce(tasks)
        sums = cut(part.mapInArrow(lean(_train_task(table_, vocab_)), schema).groupBy("row").agg(*[F.sum(f"w{j}").cast("float").alias(f"w{j}") for j in range(WIDTH)]))
        got = sums.toArrow()
        drop_table(sums)
        row, change = got["row"].to_numpy(), np.stack([got[f"w{j}"].to_numpy() for j in range(WIDTH)], axis=1)
        learnt = change[row < 0, 0].sum()
        if learnt:
            table = table.copy()
            table[row[row >= 0]] += change[row >= 0] / np.float32(learnt)
        table_.unpersist()
    return table


def _score_task(table_, vocab_):
    def run(batches):
        w, v = Weights(table_.value), vocab_.value
        value = np.log10(np.r_[v.counts, v.ends, 0] + 0.1)  # by index: -1 unknown (0 here), -2 END
        for batch in batches:
            got = []
            for _, t in _tokens(batch):
                index, place, shared = v.code(t)
                n = int(t.text[-1]) + 1
                own = value[index]
                rare = index == -1
                model = log_probs(w, v, t, place)
                model[shared] -= v.tail_mass[place[shared] - HEAD_WORDS]
                model[shared & ~rare] += own[shared & ~rare]
                base = np.where(rare, 0, own)
                known = ~rare & ((index >= 0) | (v.ends > 0))
                sums = [np.bincount(t.text, weights=x, minlength=n) for x in (np.ones(len(place)), known, base, model)]
                ends = np.cumsum(np.bincount(t.text, weights=rare, minlength=n)).astype(np.int64)
                got.append((*sums, ends, t.h[rare]))
            if not got:
                continue
            size, known, base, model = (np.concatenate([g[j] for g in got]) for j in range(4))
            offsets, at = [np.zeros(1, np.int64)], 0
            for g in got:
                offsets.append(g[4] + at)
                at += int(g[4][-1]) if len(g[4]) else 0
            tails = pa.ListArray.from_arrays(pa.array(np.concatenate(offsets).astype(np.int32)), pa.array(np.concatenate([g[5] for g in got]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(size.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(model), tails], ["doc_id", "held_out", "n_tokens", "n_known", "base", "model", "rare"])

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 10, held: int = 0, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``.

    Words are split at ASCII white space with A-Z lower-cased; END closes each text and counts as a token.
    Rows whose crc32 of the id as text leaves ``held`` are not learned from. ``base_score`` is the log10
    probability by smoothed word counts, ``score`` that by the model. Null texts are empty and have END
    alone. Rows with a null id are learned from; repeated rows count as often as they are there. If
    nothing is left to learn from, train_tokens is 0 and each score that of an untaught model. Other
    columns are not read."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("held_out", train_rows("doc_id", modulus, held))
    learn = rows.where("not held_out")
    counts = cut(count_words(learn))
    v, n, kinds = vocabulary(counts)
    table = train(learn, v, n, rounds)
    table_, vocab_ = spark.sparkContext.broadcast(table), spark.sparkContext.broadcast(v)
    scored = cut(rows.mapInArrow(lean(_score_task(table_, vocab_)), "doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double, rare array<long>").withColumn("rid", F.monotonically_increasing_id()))
    rare = scored.select("rid", F.explode("rare").alias("h"))
    c = F.coalesce("c", F.lit(0))
    seen = rare.join(counts.select("h", "c"), "h", "left").groupBy("rid").agg(F.sum(F.log10(c + F.lit(0.1))).alias("more"), F.sum((c > 0).cast("long")).alias("known"))
    more = F.coalesce("more", F.lit(0.0))
    mass = float(np.log10(n + 0.1 * (kinds + 1)))
    return scored.drop("rare").join(seen, "rid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.lit(mass)).alias("base_score"),
        (F.col("model") + more).alias("score"),
    )
