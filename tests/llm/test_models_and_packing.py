import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from veilflow.llm import lm, mixing, packing, quality, urlfilter
from veilflow.llm.queries import URL_RULES, byte_bpe

from .conftest import EDGE


def test_lm_scores(docs):
    rng = random.Random(0)
    rows = EDGE[:5] + EDGE[6:] + [(i, " ".join(rng.choice(["the cat sat", "a dog ran", f"rare{i}"]) for _ in range(40))) for i in range(10, 160)]
    got = lm.score(docs(rows, True)).collect()
    words = [((t or "").encode().lower().split() + [None], i is not None and zlib.crc32(str(i).encode()) % 10 == 0) for i, t in rows]
    c = Counter(x for w, held in words if not held for x in w)
    n, v = sum(c.values()), len(c)
    want = sorted((held, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)) for w, held in words)
    assert sorted((r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    held = [r for r in got if r["held_out"]]
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_lm_is_a_distribution():
    """After any context the probabilities of all words with a place of their own and of all tail classes sum to one."""
    rng = np.random.default_rng(0)
    for words in (59, 5000):
        v = lm.Vocabulary(np.arange(1, words + 1, dtype=np.uint64), np.arange(words, 0, -1), 5, np.zeros(lm.TAILS))
        w = lm.Weights(rng.normal(size=lm.new_table(256).shape).astype(np.float32))
        places = np.r_[lm.dealt(np.arange(v.n_items)), lm.HEAD_WORDS + np.arange(lm.TAILS)]
        f = np.tile(rng.integers(0, 1 << 63, (lm.FEATURES, 1), dtype=np.uint64), (1, len(places)))
        p = np.ones(len(places))
        for tokens, z, total, member, _ in lm.forward(w, v, f, places):
            p[tokens] *= z[np.arange(len(tokens)), member] / total
        assert abs(p.sum() - 1) < 1e-4


def test_lm_shares_of_a_class_sum_to_one(spark):
    """Known words of a tail class by their counts, and one unknown word, have its whole probability."""
    rows = [(i, i % lm.TAILS if i < 3000 else 7, 1 + 4000 // (i + 1)) for i in range(6000)]
    counts = spark.createDataFrame([*rows, (int(lm.END.view(np.int64)), 0, 9)], "h long, tail int, c long")
    v, n, kinds = lm.vocabulary(counts)
    heads = {int(k) for k in v.keys[: v.n_items - 1]}
    assert n == sum(r[2] for r in rows) + 9 and kinds == 6001 and v.n_items == lm.HEAD_WORDS
    for tail in range(lm.TAILS):
        own = [c for h, t, c in rows if t == tail and h not in heads]
        assert abs((sum(c + 0.1 for c in own) + 0.1) / 10 ** v.tail_mass[tail] - 1) < 1e-9


def test_lm_gains_from_contexts_held_out(docs):
    """Words that only their neighbours tell: the model's held-out score is far above that by counts alone."""
    rng = random.Random(1)
    pairs = [(f"a{i}", f"b{i}") for i in range(60)]
    rows = [(i, " ".join(x for _ in range(60) for x in rng.choice(pairs))) for i in range(600)]
    got = [r for r in lm.score(docs(rows)).collect() if r["held_out"]]
    tokens = sum(r["n_tokens"] for r in got)
    assert (sum(r["score"] for r in got) - sum(r["base_score"] for r in got)) / tokens > 0.3


def test_lm_gradients_are_summed_by_row():
    """Runs of one row, of a part, of a part and one, and of parts of parts: sums as by hand, and no row of the table is touched besides."""
    rng = np.random.default_rng(3)
    for sizes in ([1], [8, 9, 1, 1], [7, 600, 64, 65, 1, 2, 513], [1] * 50, [5000], rng.integers(1, 40, 300)):
        rows = rng.permutation(np.repeat(rng.permutation(70_000)[: len(sizes)], sizes)).astype(np.int32)
        grad = rng.normal(size=(len(rows), 32)).astype(np.float32)
        table, seen = rng.normal(size=(70_000, 32)).astype(np.float32), rng.random(70_000).astype(np.float32)
        sums, want, so_far = np.zeros(table.shape), table.astype(float), seen.astype(float)
        np.add.at(sums, rows, grad)
        so_far += (sums**2).sum(1)
        want -= sums * (lm.RATE / np.sqrt(1 + so_far))[:, None]
        lm._push(table, seen, rows, grad)
        assert np.allclose(table, want, atol=1e-5) and np.allclose(seen, so_far, rtol=1e-4)


def test_lm_gradients_cost_less_than_a_reduceat():
    """A whole step along the gradient of pairs of words takes less CPU time than the sums alone by ``reduceat``, which it was made of."""
    rng = np.random.default_rng(4)
    share = np.cumsum(1 / np.arange(1, 30_001))
    one, two = np.searchsorted(share / share[-1], rng.random((2, lm.STEP_TOKENS)))
    rows = ((one * 31_013 + two) % (1 << 15)).astype(np.int32)
    grad = rng.normal(size=(len(rows), lm.CLASSES)).astype(np.float32)
    table, seen = np.zeros((1 << 15, lm.CLASSES), np.float32), np.zeros(1 << 15, np.float32)
    at = np.flatnonzero(np.r_[True, np.diff(np.sort(rows)) > 0])

    def least(run):
        took = []
        for _ in range(15):
            began = time.process_time()
            run()
            took.append(time.process_time() - began)
        return min(took)

    assert least(lambda: lm._push(table, seen, rows, grad)) < least(lambda: np.add.reduceat(grad, at, axis=0))


def test_lm_empty_and_untaught(docs):
    assert lm.score(docs(EDGE).where("false")).count() == 0
    rows = lm.score(docs([(1, "a b")]), modulus=1).collect()
    assert rows[0]["held_out"] and rows[0]["train_tokens"] == 0 and rows[0]["base_score"] == 0.0


def test_words_of_long_texts_in_windows(monkeypatch):
    from veilflow.llm import common

    rng = random.Random(2)
    texts = ["", " ", "a" * 700, "".join(rng.choices("ab  \n\u00e9", k=3000)), "x y", " ".join(rng.choices(["Ab", "\u4e2d", "c" * 90], k=400))]
    data, places = common.text_bytes(common.filled(common.pa.array(texts)))
    whole = common.words(data, places)
    monkeypatch.setattr(common, "_WINDOW", 64)
    parts = common.words(data, places)
    assert all((x == y).all() for x, y in zip(whole, parts)) and len(whole[0]) == sum(len(t.encode().split()) for t in texts)


def test_lm_scores_of_a_long_text(docs):
    rows = [(i, "the cat sat on the mat") for i in range(20)] + [(100, " ".join(f"w{i % 5000}" for i in range(400_000)))]
    got = {r["doc_id"]: r for r in lm.score(docs(rows, True)).collect()}
    assert got[100]["n_tokens"] == 400_001 and math.isfinite(got[100]["score"]) and len(got) == 21


def test_lookup_finds_every_key():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 50_000, dtype=np.uint64)
    keys[1000:2000] = keys[:1000] + np.uint64(1 << 63)  # equal low bits
    found = lm.Lookup(keys)
    assert (found(keys) == np.arange(len(keys))).all() and (found(keys ^ np.uint64(12345)) == -1).all()


def test_quality(spark, docs):
    rng = random.Random(0)
    good = [(i, " ".join(rng.choice(["tree", "River", "stone.", "sky", "wind"]) + str(rng.randrange(50)) for _ in range(60))) for i in range(150)]
    bad = [(i, " ".join(["spam"] * 30 + ["BUY!!"] * 30)) for i in range(150, 300)]
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(300)] + [(None, 1), (5, None)], "doc_id long, quality int")
    out = quality.classify(docs(good + bad + EDGE, True), labels).collect()
    known = [r for r in out if r["doc_id"] is not None and r["doc_id"] > 5]
    assert all((r["predicted"] == 1) == (r["doc_id"] < 150) for r in known if r["held_out"])
    assert all(0 <= r["score"] <= 1 for r in out) and len(out) == 307
    assert quality.classify(docs(EDGE).where("false"), labels).count() == 0
    assert {r["score"] for r in quality.classify(docs(EDGE), labels.where("false")).collect()} == {0.5}


def test_statistics_by_hand():
    data = np.frombuffer("AA aa aa\nb1$$".encode(), np.uint8)
    s = dict(zip(quality.STATS, quality.statistics(data, np.array([0, len(data), len(data)]))[0]))
    assert round(s["words"], 6) == round(math.log(5), 6) and s["distinct"] == 0.5 and s["top_word"] == 0.75 and s["repeat"] == 0.5
    assert s["breaks"] == 1 / 13 and s["upper"] == 2 / 13 and s["doubled"] == 1 / 13 and s["ended"] == 0.25


def plain_targets(sizes, weights, most):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = sum(sizes.values()), set(names), {}
    while True:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > most * sizes[s] + 1e-9}
        if not over:
            return out | {s: left * w[s] / total for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= over


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(1, 200)), rng.choice(["a", "b", "b", "b", "b", "c", None])) for i in range(600)] + [(900, None, "a"), (901, "", "z"), (None, "x y", "b"), (5, "x", "tiny")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), carry=("source",)).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = plain_targets(sizes, (5, 2, 1), 3)
    taken = Counter()
    for r in got:
        assert r["taken"] <= 3 * r["size"] and abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        taken[r["source"]] += r["taken"]
    assert len(got) == len(rows)
    assert all(abs(taken[s] - want[s]) <= max(3, 0.01 * want[s]) for s in sizes if s != "tiny")
    again = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), carry=("source",)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_mixing_of_repeated_rows_and_clashing_names(spark):
    """40 equal rows of 10 words: the source comes within one row of its target, copies differ within the group."""
    rows = [(1, " ".join(["w"] * 10), "a")] * 40 + [(i, " ".join(["v"] * 9), "b") for i in range(2, 102)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for c in ("h", "rid", "size", "copies", "_again", "target", "cell"):
        df = df.withColumn(c, mixing.F.lit(1))
    got = mixing.mix(df, weights=(6, 2)).collect()
    own = [r for r in got if r["doc_id"] == 1]
    target = own[0]["target"]
    assert len(got) == 140 and 400 < target < 1200 and abs(sum(r["taken"] for r in own) - target) <= 10
    assert abs(sum(r["taken"] for r in got if r["doc_id"] != 1) - next(r["target"] for r in got if r["doc_id"] != 1)) <= 9
    again = mixing.mix(df, weights=(6, 2)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_mixing_empty(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("https://X.Example.ORG/en/2?q#f", "x.example.org", "/en/2", "org/", "allow"),
        ("http://example.org/en/17", "example.org", "/en/17", "example.org/en/1", "block"),
        ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
        ("http://a.com/de/1", "a.com", "/de/1", "com/de/", "block"),
        ("http://a.com?x", "a.com", "", None, None),
        ("no scheme", "", "", None, None),
        (None, "", "", None, None),
    ],
)
def test_url_rules(spark, url, host, path, rule, verdict):
    df = spark.createDataFrame([(1, url)], "page_id long, url string")
    r = urlfilter.judge(df, URL_RULES).first()
    assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and (verdict is None or r["verdict"] == verdict)


def test_url_models(spark):
    rows = [(i, f"http://s{i}.org/good/{i}") for i in range(60)] + [(100 + i, f"http://s{i}.com/de/casino{i}") for i in range(60)] + [(300, "http://new.net/good/77"), (301, "http://new.net/de/casino88"), (302, None), (None, "http://new.net/good/1")]
    got = {r["page_id"]: r["verdict"] for r in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string"), URL_RULES).collect()}
    assert got[300] == "allow" and got[301] == "block" and len(got) == len(rows)
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string"), URL_RULES).count() == 0


def test_token_ids_equal_the_tokenizers():
    from tokenizers import Tokenizer

    texts = ["", " ", "a  b", "x \n y ", " lead", "trail ", "a\tb c", "a\n b", "don't 'll", "\n", "é ñ", "Hello, world!\nNext line here", "x" * 3000]
    tok = Tokenizer.from_file(byte_bpe())
    assert [np.frombuffer(b, "<u4").tolist() for b in packing.token_ids(texts, byte_bpe())] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_ids_of_special_tokens_odd_characters_and_long_texts(monkeypatch):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(byte_bpe())
    rng = random.Random(3)
    letters = ["a", "S", "s", "re", "ll", "'", " ", "  ", "\n", "\t", "\x85", "\xa0", "\u2003", "\u200b", "1", "\u00b2", "\u216f", "\u4e2d", "\U0001f600", "-", "\x1c", "\U00010400", "\ua64e", "\u180e"]
    texts = ["a<|endoftext|>b", "<|endoftext|>"] + ["".join(rng.choices(letters, k=rng.randint(0, 30))) for _ in range(2000)]
    monkeypatch.setattr(packing, "WINDOW", 50)
    monkeypatch.setattr(packing, "REMEMBERED", 100)
    packing._encoder.cache_clear()
    texts += [" ".join(rng.choices(["it's", "x", "don't ", "y\n"], k=400))]
    assert [np.frombuffer(b, "<u4").tolist() for b in packing.token_ids(texts, byte_bpe())] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert np.frombuffer(packing.token_ids(texts[:1], byte_bpe())[0], "<u4").tolist() == [64, 50256, 65]
    packing._encoder.cache_clear()


def test_packing(docs):
    rng = random.Random(1)
    rows = EDGE + [(10 + i, " ".join(rng.choices(["alpha", "beta", "gamma"], k=rng.randint(1, 900)))) for i in range(200)]
    got = packing.pack_documents(docs(rows, True), byte_bpe(), capacity=256).collect()
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(byte_bpe())
    ids = {i: tok.encode(t or "", add_special_tokens=False).ids + [0] for i, t in rows}
    for r in got:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(own, "<u4").tobytes()) == r["ids_crc32"]
    lengths = np.array([r["length"] for r in got])
    assert packing.lower_bound(lengths, 256) <= len(by) <= packing.lower_bound(lengths, 256) + 1
    assert packing.pack_documents(docs(EDGE).where("false"), byte_bpe()).count() == 0


def test_packing_exchanges_between_partitions(spark, monkeypatch):
    monkeypatch.setattr(packing, "PIECES", 20)
    rng = random.Random(4)
    items = spark.createDataFrame([(i, 0, 0, rng.randint(1, 100), i) for i in range(700)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(items, 100).collect()
    assert len(got) == 700
    lengths = np.array([r["length"] for r in got])
    assert len({r["sequence_id"] for r in got}) <= packing.lower_bound(lengths, 100) * 1.03 + 1


def test_certified_partitions_close():
    """Where nothing fits the room that is left nothing travels; what does is bounded."""
    lengths = np.full(16384, 1200)
    assert not packing.given_up(lengths, packing.best_fit(lengths, 2048), 2048, 1200).any()
    rng = np.random.default_rng(5)
    for lengths in (rng.integers(1, 700, 16384), rng.choice([683, 700, 1100, 400], 16384), np.ones(16384, int)):
        where = packing.best_fit(lengths, 2048)
        assert np.bincount(where)[packing.given_up(lengths, where, 2048, int(lengths.min()))].sum() <= packing.GIVE


def test_packing_of_equal_rows_and_ties(docs):
    rows = [(None, "same words here")] * 300 + [(7, "")] * 50
    got = packing.pack_documents(docs(rows, True), byte_bpe(), capacity=64).collect()
    fill = Counter()
    for r in got:
        fill[r["sequence_id"]] += r["length"]
    assert len(got) == 350 and max(fill.values()) <= 64 and len(fill) <= -(-sum(fill.values()) // 64) + 1


def test_bounds_hold():
    rng = np.random.default_rng(3)
    for _ in range(30):
        lengths = rng.integers(1, 51, rng.integers(1, 60))
        where = packing.best_fit(lengths, 50)
        assert packing.lower_bound(lengths, 50) <= where.max() + 1
        assert np.bincount(where, weights=lengths).max() <= 50
    assert packing.lower_bound(np.full(10, 26), 50) == 10


def plain_difference(labelled, url, kept=None):
    """The two models' log-likelihood difference a character by dictionaries; ``kept``: contexts that count."""
    order, out = urlfilter.ORDER, 0.0
    counts = {x: Counter() for x in ("allow", "block")}
    for u, label in labelled:
        t = "\x02" * order + u + "\x03"
        for i in range(order, len(t)):
            for o in range(order + 1):
                counts[label][t[i - o : i], t[i]] += 1
    totals = {x: Counter() for x in counts}
    for x, c in counts.items():
        for (g, _), n in c.items():
            totals[x][g] += n

    def chance(label, t, i):
        p = 1 / urlfilter.CHARACTERS
        for o in range(order + 1):
            g = t[i - o : i]
            if kept is None or g in kept:
                p = (counts[label][g, t[i]] + urlfilter.PRIOR * p) / (totals[label][g] + urlfilter.PRIOR)
        return p

    t = "\x02" * order + url + "\x03"
    for i in range(order, len(t)):
        out += math.log(chance("allow", t, i)) - math.log(chance("block", t, i))
    seen = {x for c in counts.values() for _, x in c}
    some = t[:order] + "a"
    for label in counts:  # all characters together have probability one, seen and unseen ones
        total = sum(chance(label, some + x, order + 1) for x in seen) + (urlfilter.CHARACTERS - len(seen)) * chance(label, some + "\U0010fff0", order + 1)
        assert abs(total - 1) < 1e-9
    return out / (len(t) - order)


@pytest.mark.parametrize("most", [1 << 17, 60])
def test_url_likelihood_by_dictionaries(spark, monkeypatch, most):
    monkeypatch.setattr(urlfilter, "KEPT", most)
    rng = random.Random(3)
    labelled = [("".join(rng.choices("abc/é", k=rng.randint(0, 12))), rng.choice(["allow", "block"])) for _ in range(150)]
    urls = ["", "abc", "zz", "ab/c" * 2000, "é😀"]
    tables = urlfilter.count_tables(spark.createDataFrame(labelled, "url string, label string").groupBy("url", "label").agg(urlfilter.F.count("*").alias("n")))
    rows = tables.collect()
    for o in range(urlfilter.ORDER + 1):
        assert sum(r["o"] == o for r in rows) <= most
    got = {r["url"]: r["difference"] for r in urlfilter.differences(spark.createDataFrame([(u,) for u in urls], "url string"), tables).collect()}
    kept = {r["g"] for r in rows}
    assert (most > 1000) == (len(rows) == len({(t[i - o : i], t[i]) for u, _ in labelled for t in ["\x02" * 4 + u + "\x03"] for i in range(4, len(t)) for o in range(5)}))
    for u in urls:
        assert abs(got[u] - plain_difference(labelled, u, kept)) < 1e-9


def test_url_models_keep_all_contexts(spark, monkeypatch):
    """However few rows of an order are broadcast, the others count too."""
    monkeypatch.setattr(urlfilter, "KEPT", 20)
    rng = random.Random(4)
    labelled = [("".join(rng.choices("abc/é", k=rng.randint(0, 12))), rng.choice(["allow", "block"])) for _ in range(150)]
    urls = ["", "abc", "zz", "ab/c" * 20, "é😀", "abc"]
    df = spark.createDataFrame(labelled, "url string, label string")
    tables, _ = urlfilter.fit(df)
    trains = urlfilter.F.pmod(urlfilter.F.xxhash64("url", urlfilter.F.lit("calibrate")), urlfilter.F.lit(urlfilter.CALIBRATE)) != 0
    trained = [(r["url"], r["label"]) for r in df.where(trains).collect()]
    got = urlfilter.differences(spark.createDataFrame([(u,) for u in urls], "url string"), tables).collect()
    assert sorted(r["url"] for r in got) == sorted(urls)
    assert all(abs(r["difference"] - plain_difference(trained, r["url"])) < 1e-9 for r in got)


def test_url_ties_repeats_and_clashing_names(spark):
    rules = [("allow", "a.com/x/"), ("block", "a.com/x/"), ("block", "b.com/")]
    rows = [(1, "http://a.com/x/1"), (1, "http://a.com/x/1"), (2, "http://b.com/"), (None, "http://c.com/"), (None, "http://c.com/"), (3, "http://d.com/" + "y" * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    for c in ("host", "path", "rule", "given", "verdict", "difference", "_rid", "_t"):
        df = df.withColumn(c, urlfilter.F.lit("z"))
    got = urlfilter.judge(df, rules).collect()
    assert len(got) == 6 and [r["verdict"] for r in got if r["page_id"] == 1] == ["allow", "allow"]
    assert len({(r["page_id"], r["verdict"]) for r in got if r["page_id"] is None}) == 1


def test_compiled_rules_equal_a_plain_evaluation(spark, docs):
    rng = np.random.default_rng(2)
    x = rng.random((400, len(quality.STATS)))
    y = ((x[:, 1] > 0.5) & (x[:, 4] <= 0.7)).astype(int)
    model = quality.fit_rules(x, y)
    assert len(model.rules) > 3
    own = spark.createDataFrame([(tuple(map(float, row)),) for row in x], f"{quality.NAME} struct<{', '.join(f'{s}: double' for s in quality.STATS)}>")
    got = np.array([r["p"] for r in own.select(model.score().alias("p")).collect()])
    total = model.bias + sum(w * quality._holds(x, rule) for rule, w in model.rules)
    assert np.abs(got - 1 / (1 + np.exp(-total))).max() < 1e-9 and ((got > 0.5) == y).mean() > 0.95


def _pattern(doublings):
    """Words of which polynomial sums modulo 2^64 can't tell the two: a pattern and its complement, doubled."""
    one, two = "a", "b"
    for _ in range(doublings):
        one, two = one + two, two + one
    return one, two


@pytest.mark.parametrize("doublings", [5, 8, 10, 11, 13])
def test_unlike_words_have_unlike_hashes(doublings):
    from veilflow.llm import common

    one, two = _pattern(doublings)
    data = np.frombuffer(f"{one} {two} {one.upper()} {one}".encode(), np.uint8)
    h, first, last, text = common.words(data, np.array([0, len(data)]))
    assert h[0] != h[1] and h[0] == h[2] == h[3]


def test_unlike_words_are_encoded_by_themselves(monkeypatch):
    one, two = _pattern(11)
    texts = [f"x {one} y", f"x {two} y", f"{two} {one}", "plain words", one, two]
    enc = packing.Encoder(byte_bpe())
    want = [enc.tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in packing.Encoder(byte_bpe()).encode(texts)] == want
    assert [x.tolist() for t in texts for x in enc.encode([t])] == want
    # even where all hashes are one
    monkeypatch.setattr(packing, "hashed", lambda values, first, last: np.zeros(len(first), np.uint64))
    broken = packing.Encoder(byte_bpe())
    assert [x.tolist() for t in texts for x in broken.encode([t])] == want and [x.tolist() for x in broken.encode(texts)] == want


def test_unlike_words_of_a_pattern_are_not_near_or_counted_as_one(docs):
    from veilflow.llm import minhash

    one, two = _pattern(11)
    df = docs([(1, one), (2, two), (3, one)])
    got = {r["doc_id"]: r for r in minhash.fingerprint_edits(df).collect()}
    assert got[1]["fingerprint"] == got[3]["fingerprint"] != got[2]["fingerprint"] and got[2]["near_next"] < 0.5
    assert [got[i]["component_id"] for i in (1, 2, 3)] == [1, 2, 1]
    scored = lm.score(docs([(1, one), (2, two), (4, one), (5, two), (7, one)]), modulus=10, held=0)
    n, c = 5 + 5, {one: 3, two: 2}
    for r in scored.collect():
        word = one if r["doc_id"] in (1, 4, 7) else two
        want = math.log10((c[word] + 0.1) / (n + 0.1 * 4)) + math.log10((5 + 0.1) / (n + 0.1 * 4))
        assert abs(r["base_score"] - want) < 1e-9
