import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from veilflow.llm import graph, linededup, minhash, simhash

from .conftest import EDGE


def brute_lines(rows, least):
    keys = Counter()
    for i, t in {(i, t or "") for i, t in rows}:
        keys.update({linededup.line_key(x) for x in t.encode().split(b"\n")} - {b""})
    out = []
    for i, t in rows:
        lines = (t or "").encode().split(b"\n")
        kept = [x for x in lines if keys[linededup.line_key(x)] < least]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256(b"\n".join(kept)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("rows", [EDGE, [(i, "\n".join(random.Random(i).choices(["Aa", " aa ", "b", "c%d" % i, "ä", ""], k=6))) for i in range(40)]])
def test_line_dedup(docs, rows):
    got = linededup.drop_frequent_lines(docs(rows, True), min_documents=3)
    mine = [(r["doc_id"], r["n_lines"], r["n_dropped"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in got.collect()]
    assert sorted(mine, key=repr) == brute_lines(rows, 3)


def test_line_dedup_when_the_filter_is_full(docs):
    rows = [(i, f"same\nline {i}\npair {i // 2}") for i in range(60)]
    got = linededup.drop_frequent_lines(docs(rows), min_documents=2, expected_lines=1)
    assert {r["kept"] for r in got.collect()} == {f"line {i}" for i in range(60)}


def test_line_dedup_empty(docs):
    assert linededup.drop_frequent_lines(docs(EDGE).where("false"), min_documents=2).count() == 0


def test_rewrite_keeps_columns(docs):
    df = docs([(i, f"head\nbody {i}") for i in range(4)], True)
    out = linededup.rewrite(df, min_documents=3)
    assert out.columns == df.columns and {r["text"] for r in out.collect()} == {f"body {i}" for i in range(4)}


def plain_print(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def test_simhash(docs, spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    rows = list(EDGE[:5])
    for i in range(10, 40):
        base = random.Random(i // 3).choices(words, k=300)
        for _ in range(i % 3):
            base[rng.randrange(300)] = rng.choice(words)
        rows.append((i, " ".join(base)))
    prints = [plain_print(t) for _, t in rows]
    best = list(range(len(rows)))

    def root(i):
        while best[i] != i:
            i = best[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                best[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(x for x in (least.get(root(i)), d, float("inf")) if x is not None)
    want = sorted(((d, f"{p:016x}", least[root(i)]) for i, ((d, _), p) in enumerate(zip(rows, prints))), key=repr)
    found = simhash.near_duplicates(docs(rows, True)).select("doc_id", simhash.hex16(simhash.F.col("fp")), "component_id")
    assert sorted((tuple(r) for r in found.collect()), key=repr) == want
    assert simhash.near_duplicates(docs(rows).where("false")).count() == 0


@pytest.mark.parametrize("hot", [1000, 20])
def test_links_of_crowded_segments(spark, hot):
    """Hundreds of fingerprints share a segment: the split finds the same pairs as all pairs do."""
    rng = random.Random(7)
    prints = {0xABCDEF01 << 32 | rng.getrandbits(32) for _ in range(150)} | {rng.getrandbits(32) << 32 | 0x1234 for _ in range(150)}
    for p in list(prints):
        prints.add(p ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    got = {(r["u"], r["v"]) for r in simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), 3, hot).collect()}
    assert got == {(u, v) for i, u in enumerate(prints) for v in prints[:i] if ((u ^ v) & ((1 << 64) - 1)).bit_count() <= 3}


def test_keep_one(docs):
    kept = simhash.keep_one(docs(EDGE, True))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4, 5]


def test_keep_one_of_each_group_whatever_its_ids(docs):
    text = {k: " ".join(random.Random(k).choices([f"w{i}" for i in range(500)], k=80)) for k in range(6)}
    rows = [(None, text[0]), (None, text[1]), (None, text[1]), (7, text[2]), (7, text[3]), (7, text[3]), (9, text[3]), (None, text[4]), (8, text[4]), (5, text[5])]
    kept = simhash.keep_one(docs(rows, True)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=repr) == sorted([(None, text[0]), (None, text[1]), (7, text[2]), (7, text[3]), (8, text[4]), (5, text[5])], key=repr)


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(500, i) for i in range(501, 540)] + [(i, i + 1) for i in range(600, 640)]
    got = {r["u"]: r["v"] for r in graph.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    near = {}
    for u, v in pairs:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    for start in near:
        seen, todo = {start}, [start]
        while todo:
            todo += [y for y in near[todo.pop()] if y not in seen and not seen.add(y)]
        assert got.get(start, start) == min(seen)


def test_fingerprint_edits(docs):
    rows = [(i, " ".join(random.Random(i // 2).choices("ab cé def gh ijk".split(), k=40 + i))) for i in range(30)] + [(100, None), (101, ""), (None, "no id"), (None, None)]
    got = {r["doc_id"]: r for r in minhash.fingerprint_edits(docs(rows[:-2], True)).collect()}
    order = sorted(rows[:-2], key=lambda r: -r[0])
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        assert got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest() and got[i]["n_chars"] == len(t)
    assert len(minhash.fingerprint_edits(docs(rows)).collect()) == len(rows)
    assert minhash.fingerprint_edits(docs(rows).where("false")).count() == 0
    lone = minhash.fingerprint_edits(docs([(7, "abcd")])).first()
    assert lone["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and lone["near_next"] == 1.0


def test_fingerprints_by_brute_force(docs):
    """Each byte of a fingerprint is the least permuted hash of the text's shingles, cut to 8 bits."""
    rows = [(i, " ".join(random.Random(i).choices("Ab cé def gh ijk".split(), k=3 + i))) for i in range(12)] + [(50, None), (51, " \t ")]
    got = {r["doc_id"]: r["fingerprint"] for r in minhash.fingerprint_edits(docs(rows, True)).collect()}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        texts = [b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))]
        hashes = [minhash.shingles(np.frombuffer(x, np.uint8), np.array([0, len(x)]))[0][0].item() for x in texts]
        least = [min((int(a) * h + int(b)) % (1 << 64) >> 32 for h in hashes) for a, b in zip(minhash._A, minhash._B)]
        assert got[i] == bytes((x >> 3) & 255 for x in least).hex()


def test_edits_of_a_crowded_id_in_many_parts(docs, monkeypatch):
    """Ranges are split by the text's hash where many rows have one id or none; the order stays."""
    monkeypatch.setattr(minhash, "PART_BYTES", 2000)
    monkeypatch.setattr(minhash, "CROWDED", 20)
    rows = [(i if i % 3 else 30 if i % 2 else None, f"text number {i} " * (i % 7)) for i in range(300)]
    got = minhash.fingerprint_edits(docs(rows)).collect()
    th = {t: h for t, h in minhash_hashes(docs(rows))}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, th[r[1]]), reverse=True)
    want = []
    for k, (i, t) in enumerate(order):
        nxt, half = order[(k + 1) % len(order)][1], len(t) // 2
        want.append((i, hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()))
    assert sorted(((r["doc_id"], r["edited_sha256"]) for r in got), key=repr) == sorted(want, key=repr)


def minhash_hashes(df):
    return [(r["text"], r["h"]) for r in df.select("text", minhash.F.xxhash64("text").alias("h")).collect()]


def test_recall_of_links(docs):
    """Pairs from 0.8 on are joined in nine of ten cases at least (here: all), as all pairs tell."""
    rng = random.Random(21)
    texts = []
    for k in range(60):
        base = [f"v{rng.randrange(4000)}" for _ in range(rng.randint(40, 400))]
        texts += [" ".join(base), " ".join(_template(rng, base, rng.uniform(0, 0.12)))]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs(list(enumerate(texts)))).collect()}
    want = brute_groups(texts)
    pairs = [i for i in range(0, 120, 2) if want[i] == want[i + 1]]
    assert len(pairs) > 20 and sum(got[i] == got[i + 1] for i in pairs) >= 0.9 * len(pairs)
    assert all(got[i] == i for i in range(0, 120, 2)) and all(got[i + 1] != i for i in range(0, 120, 2) if i not in pairs)


def test_likeness_estimates_jaccard():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    errors = []
    for _ in range(60):
        a = rng.choices(words, k=300)
        b = a[: rng.randrange(300)] + rng.choices(words, k=100)
        sets = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (a, b)]
        signs = minhash.short(minhash._sign(minhash.pa.array([" ".join(a), " ".join(b)])))
        errors.append(minhash.likeness(signs[:1], signs[1:])[0] - len(sets[0] & sets[1]) / len(sets[0] | sets[1]))
    assert np.std(errors) < 0.06 and abs(np.mean(errors)) < 0.03


def test_minhash_near_duplicates(docs):
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(1, base), (2, base + " more"), (3, base), (4, "other text " * 9), (None, ""), (6, None)]
    got = {(r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(docs(rows, True)).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (None, 6), (6, 6)}


def _template(rng, base, share):
    """A copy of ``base`` in which runs of words are replaced, about ``share`` of them."""
    out = list(base)
    for _ in range(int(len(base) * share / 5)):
        at = rng.randrange(len(base) - 5)
        out[at : at + 5] = [f"r{rng.randrange(10**6)}" for _ in range(5)]
    return out


def brute_groups(texts, similarity=0.8):
    """The least index of each text's group by all pairs of 5-word shingle sets."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    best = list(range(len(texts)))

    def root(i):
        while best[i] != i:
            i = best[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= similarity:
                a, b = sorted((root(i), root(j)))
                best[b] = a
    return [root(i) for i in range(len(texts))]


def skewed():
    """Texts of one template, about 0.7 alike, each with a near copy at about 0.8."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(100):
        one = _template(rng, base, 0.0501)
        at = rng.randrange(277)
        texts += [" ".join(one), " ".join(one[:at] + [f"c{rng.randrange(10**6)}" for _ in range(22)] + one[at + 22 :])]
    return texts


@pytest.mark.parametrize("few", [1 << 22, 0])
def test_minhash_near_duplicates_in_skewed_buckets(docs, monkeypatch, few):
    """With counts of shingles in the tasks, and with sets taken apart and joined."""
    monkeypatch.setattr(minhash, "FEW", few)
    texts = skewed()
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs(list(enumerate(texts)), True)).collect()}
    want = brute_groups(texts)
    assert 10 < len(set(want)) < 190 and [got[i] for i in range(len(texts))] == want


def test_near_dedup_leaves_no_pair_of_similar_texts(docs, spark):
    import corpus_pipeline

    texts = skewed()
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs(list(enumerate(texts)), True), "").collect()}
    # every group by similarity leaves one at most, and its first text unless a fingerprint links it to an earlier one
    assert kept <= set(brute_groups(texts)) and len(kept) > 10
    assert corpus_pipeline.near_dedup(spark, docs(EDGE).where("false"), "").count() == 0


def test_balls_of_fingerprints_are_not_broadcast(spark, tmp_path):
    """By its file a ball looks small enough for the driver, whatever the session's threshold is."""
    spark.range(20_000).selectExpr("xxhash64(id) AS fp").write.parquet(f"{tmp_path}/prints")
    prints = spark.read.parquet(f"{tmp_path}/prints")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        found = simhash.links(prints)
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_near_copies_are_not_broadcast(spark, docs):
    """Tables of a row a document stay out of the driver, whatever the session's threshold is; so do keys beyond FEW."""
    from veilflow.llm.common import few

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        for rows in (EDGE, [(i, f"text {i}") for i in range(5)]):  # with and without repeated ids
            plan = simhash.keep_one(docs(rows))._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Broadcast" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    keys = lambda n: few(spark.range(n))._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in keys(1 << 20) and "broadcast" not in keys((1 << 20) + 1)
