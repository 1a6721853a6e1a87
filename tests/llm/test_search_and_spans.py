import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from veilflow.llm import suffixdedup, topk

from .conftest import EDGE


def test_topk(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=40)]) for i in range(300)]
    rows += [(300 + i, rows[i % 3][1]) for i in range(30)]  # ties
    rows += [(900, None), (901, [float("nan")] * 40), (902, [1.0] * 39 + [None]), (903, [1.0, 2.0]), (904, [2.0, 1.0]), (None, [0.0] * 40), (905, []), (906, [float("inf")] * 40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in topk.search(df, df.where("vec_id % 20 = 0 or vec_id > 890"), k=4).collect())
    ok = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in ok:
        if q % 20 == 0 or q > 890:
            best = sorted((-int(ok[q] @ v), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))[:4]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert topk.search(df.where("false"), df, k=2).count() == 0


def test_topk_in_blocks_with_repeated_ids_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BYTES", 1 << 12)
    monkeypatch.setattr(topk, "QUERIES", 7)
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=12)]) for i in range(200)] + [(5, [1.0] * 12), (7, [3.0] * 12), (7, [3.0] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for c in ("v", "block", "query_id", "rank", "score"):
        df = df.withColumn(c, topk.F.lit(1))
    got = sorted(tuple(r) for r in topk.search(df, df.where("vec_id % 2 = 1"), k=3).collect())
    whole = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows]
    want = []
    for q in sorted({i for i, _ in whole if i % 2}):
        own = min((v.tolist() for i, v in whole if i == q))
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(sorted((-int(np.dot(own, v)), i) for i, v in whole if i != q)[:3])]
    assert got == sorted(want)


def test_topk_beyond_doubles(spark):
    df = spark.createDataFrame([(0, [1e6, 3e6]), (1, [2e6, 1e6]), (2, [1e6, 1.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.search(df, df.where("vec_id = 0"), k=2).orderBy("rank").collect()]
    a = [256 * 10**6, 768 * 10**6]
    assert got == [(0, 1, 1, a[0] * 512 * 10**6 + a[1] * 256 * 10**6), (0, 2, 2, a[0] * 256 * 10**6 + a[1] * 256)]


def brute(rows, size):
    data = [(t or "").encode() for _, t in rows]
    count = Counter(b[i : i + size] for b in data for i in range(len(b) - size + 1))
    out = []
    for (i, _), b in zip(rows, data):
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - size + 1):
            if count[b[p : p + size]] > 1:
                gone[p : p + size] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=repr)


def _rows():
    rng = random.Random(1)
    base = "".join(rng.choice("ab c") for _ in range(700))
    rows = []
    for i in range(40):
        start = "".join(rng.choice("xyzé ") for _ in range(rng.randint(0, 120)))
        rows.append((i, start + base[rng.randint(0, 80) : rng.randint(300, 700)] + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 60)))))
    return rows + [(50, None), (51, ""), (None, "q" * 500), (52, base), (52, base), (53, "ab" * 300)]


@pytest.mark.parametrize("most", [suffixdedup.MOST_BYTES, 300])
def test_suffix_dedup(docs, most):
    """The second run splits every group of runs until nothing is left to split."""
    got = suffixdedup.dedup(docs(_rows(), True), min_bytes=100, most_bytes=most)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(_rows(), 100)


def test_anchors_do_not_depend_on_the_batch():
    """Equal windows choose equal anchors at equal places, in batches of any size."""
    rng = np.random.default_rng(9)
    own = rng.integers(97, 101, 5000, dtype=np.uint8)
    seen = []
    for before in (0, 17, 70_000, 1_100_000):
        data = np.r_[rng.integers(97, 101, before, dtype=np.uint8), own]
        text, first, last, at, a, u = suffixdedup.runs_of(data, np.array([0, before, len(data)] if before else [0, len(data)]), 100)
        mine = first >= before
        seen.append(list(zip((first - before)[mine].tolist(), (last - before)[mine].tolist(), (at - before)[mine].tolist(), a[mine].tolist(), u[mine].tolist())))
    assert all(x == seen[0] for x in seen)


def test_one_window_in_many_contexts(docs):
    """A string of the least length between ever different bytes: its group can't be halved, and no shard sorts it."""
    rng = random.Random(8)
    line = "".join(rng.choice("abcdefgh ") for _ in range(100))
    rows = [(i, "".join(rng.choice("xyz") for _ in range(90)) + line + "".join(rng.choice("uvw") for _ in range(90))) for i in range(400)]
    got = suffixdedup.dedup(docs(rows), min_bytes=100, most_bytes=4000)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, 100)


def test_suffix_dedup_edges(docs):
    assert sorted((tuple(r) for r in suffixdedup.dedup(docs(EDGE), min_bytes=200).collect()), key=repr) == brute(EDGE, 200)
    assert suffixdedup.dedup(docs(EDGE).where("false")).count() == 0
    with pytest.raises(ValueError):
        suffixdedup.dedup(docs(EDGE), min_bytes=8)


@pytest.mark.parametrize("depth", [5, 8, 19, 200])
def test_expand_groups_by_common_prefix(depth):
    data = np.frombuffer(b"abracadabra " * 40 + b"xyz" * 90 + bytes(range(60)), np.uint8)
    order, rank, eight = suffixdedup.suffix_array(data, depth)
    ids = suffixdedup.expand(order, rank, eight, depth)
    raw = bytes(data)
    whole = [(i, p) for i, p in zip(ids, order) if p + depth <= len(raw)]
    by_id, by_text = {}, {}
    for i, p in whole:
        by_id.setdefault(i, set()).add(int(p))
        by_text.setdefault(raw[p : p + depth], set()).add(int(p))
    assert sorted(map(sorted, by_id.values())) == sorted(map(sorted, by_text.values()))
