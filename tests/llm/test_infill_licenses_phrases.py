import hashlib
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilflow.llm import collocations, infill, licenses

from .conftest import EDGE

TEXTS = ["", " ", "a", " \t\n", "one two", "  lead and trail \n", "é ü x y", "a<P>b c d", "has <S> in it", "<M>", "<", "S> P> M> <S <P", "x" * 5000, "w " * 4000, "\x0b\x0cz"]


def plain_infill(key, text, seed=42):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    d = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(d[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    if text == "" or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    spm = h4 % 100 < 80
    return n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def sha(x):
    return hashlib.sha256((x or "").encode()).hexdigest()


def test_infill_by_brute_force(docs):
    rows = list(EDGE) + [(100 + 20 * i + k, t) for i, t in enumerate(TEXTS) for k in range(20)] + [(None, None), (-7, "minus seven words")]
    df = docs(rows, True).withColumn("n", infill.F.lit("own"))
    out = infill.transform(df, digests=True)
    assert out.columns == [*df.columns, "fim"]
    got = sorted(((r["doc_id"], r["text"], *r["fim"]) for r in out.collect()), key=repr)
    want = sorted(((i, t, *plain_infill(i, t), sha(plain_infill(i, t)[4]), sha(t)) for i, t in rows), key=repr)
    assert got == want and {x[3] for x in got} == {"plain", "psm", "spm"}
    back = out.select("text", infill.restored("fim.output", "fim.form").alias("t")).collect()
    assert all((r["text"] or "") == r["t"] for r in back)
    assert infill.transform(df.where("false")).count() == 0
    bare = infill.transform(df, texts=False, digests=True).where("fim.output is null").count()
    assert bare == len(rows)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<PSM> ab\n é", max_size=60), st.integers(-(2**63), 2**63 - 1))
def test_infill_comes_back(text, key):
    n, form, prefix, middle, out = infill.rearrange(text, key, rates=infill.Rates(100, 50))
    assert infill.restore(out, form) == text and (n, form) == (len(infill.ends(text)), form)
    assert form == "plain" or (prefix + middle <= len(text) and len(out) == len(text) + 9)


def test_infill_refuses_what_it_did_not_make():
    with pytest.raises(ValueError):
        infill.restore("no marks", "spm")


def plain_words(text):
    return re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").encode().lower())


def plain_places(words, phrases):
    found = []
    for p, label in phrases:
        p = p.encode().split()
        found += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return found


def plain_statistics(words, sequences):
    """Longest run ending after each word that a sequence holds."""
    out = []
    for i in range(1, len(words) + 1):
        n = 0
        while n < i and any(words[i - n - 1 : i] == s[j : j + n + 1] for s in sequences for j in range(len(s) - n)):
            n += 1
        out.append(n)
    return out


def plain_best(words, sequence):
    """Most words of a sequence that a chain of right-maximal matches covers, over all chains."""
    n = plain_statistics(words, ALL)
    matches = [(e, k) for e, k in enumerate(n, 1) if k >= licenses.MATCH and not (e < len(n) and n[e] == k + 1)]
    items = [(e, q + k, k) for e, k in matches for q in range(len(sequence) - k + 1) if sequence[q : q + k] == words[e - k : e]]

    def grow(j):
        e, p, k = items[j]
        return max([k] + [grow(i) + min(k, e - a, p - b) for i, (a, b, m) in enumerate(items) if a < e and b < p and a - m < e - k and b - m < p - k and e - k - a <= licenses.GAP and p - k - b <= licenses.GAP])

    return max((grow(j) for j in range(len(items))), default=0)


PHRASE_LIST = [("a b", "ab"), ("b c a", "bca"), ("d", "d"), ("a b a b", "abab")]
WORDING_LIST = [("one", "a b c d a b c a"), ("two", "b c d b c d b c d a"), ("three", "c a b c a a b d d c a"), ("one", "a b c d a b c a d d")]
ALL = [licenses.words(w.encode()) for _, w in WORDING_LIST] + [licenses.words(p.encode()) for p, _ in PHRASE_LIST]


@pytest.mark.parametrize("seed", range(60))
def test_licenses_by_brute_force(seed):
    lib = licenses.library(PHRASE_LIST, WORDING_LIST)
    rng = random.Random(seed)
    text = " ".join(rng.choices("abcd" * 6 + "x", k=rng.randrange(60)) + WORDING_LIST[seed % 4][1].split()[: rng.randrange(12)])
    words = licenses.words(text.encode())
    found = plain_places(words, PHRASE_LIST)
    n, count, first, last, base, labels, score, spans = licenses.scan_text(text.encode(), lib)
    assert (n, count) == (len(words), len(found))
    assert (first, last) == ((min(found)[0], max(found)[0]) if found else (None, None))
    assert base == ",".join(sorted({x for _, x in found}))
    shares = [plain_best(words, licenses.words(w.encode())) / len(w.split()) for _, w in WORDING_LIST]
    assert score == (1.0 if found else max(shares))
    assert {s["wording"] for s in spans} == {i for i, x in enumerate(shares) if x >= licenses.COVER}
    assert labels == ",".join(sorted({x for _, x in found} | {s["label"] for s in spans}))
    for w in range(4):  # spans of one wording don't overlap
        own = sorted((s["first"], s["last"]) for s in spans if s["wording"] == w)
        assert all(a[1] <= b[0] for a, b in zip(own, own[1:]))


@pytest.mark.parametrize("seed", range(20))
def test_licenses_matching_statistics_and_portions(seed):
    lib = licenses.library(PHRASE_LIST, WORDING_LIST)
    text = " ".join(random.Random(seed).choices("abcdx", k=80)).encode()
    want = plain_statistics(licenses.words(text), ALL)
    whole, parts = licenses.Reader(lib), licenses.Reader(lib)
    got = []
    for w in licenses.words(text):
        whole.read([w])
        got.append(whole.length)
    whole.end()
    for part in licenses.portions(text, 1 + seed):
        parts.read(licenses.words(part))
    parts.end()
    assert got == want
    assert (parts.at, parts.found, parts.matches) == (whole.at, whole.found, whole.matches)


def test_licenses_of_edge_rows(docs):
    rows = list(EDGE) + [(10, "This is under the GNU General\nPublic  LICENSE"), (10, "This is under the GNU General\nPublic  LICENSE"), (11, dict(licenses.WORDINGS)["isc"].replace("fee", "charge")), (12, "ΜIT LICENSE cc-BY é"), (13, "none " * 30_000 + "Apache License " * 2000)]
    got = sorted((tuple(r) for r in licenses.scan(docs(rows, True)).drop("spans").collect()), key=repr)
    assert len(got) == len(rows)
    by = {r[0]: r[1:] for r in got}
    assert by[1] == by[2] == (0, 0, None, None, "", "", 0.0)
    assert by[10] == (8, 1, 4, 4, "gpl", "gpl", 1.0)
    assert by[11][1:6] == (0, None, None, "", "isc") and 0.75 <= by[11][6] < 1
    assert by[12] == (5, 1, 2, 2, "cc-by", "cc-by", 1.0)
    assert by[13][:4] == (34_000, 2000, 30_000, 33_998)
    for i, t in rows:
        n, count = len(plain_words(t)), len(plain_places(plain_words(t), licenses.PHRASES))
        assert (i, n, count) in {r[:3] for r in got}
    assert licenses.scan(docs(rows).where("false")).count() == 0


def test_licenses_refuse_bad_wordings():
    for phrases, wordings in (([("--", "x")], []), ([], [("x", "too short it")]), ([], [("x", "w " * (licenses.MOST_TOKENS + 1))])):
        with pytest.raises(ValueError):
            licenses.library(phrases, wordings)


def plain_collocations(rows, least, longest, contained, keep):
    out = []
    for lang in {x or "und" if x is None else x for x, _ in rows}:
        f, n = [Counter() for _ in range(longest + 1)], 0
        for own, text in rows:
            if ("und" if own is None else own) == lang:
                text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
                for piece in re.split("[.,;:!?\x0a-\x0d]", text):
                    w = re.findall("[^\x20\x09]+", piece)
                    n += len(w)
                    for k in range(1, longest + 1):
                        f[k].update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
        made = []
        for k in range(2, longest + 1):
            for p, a in f[k].items():
                w = p.split(" ")
                if a < least:
                    continue
                if any(b >= least and 100 * b >= contained * a and any(q.split(" ")[i : i + k] == w for i in range(m - k + 1)) for m in range(k + 1, longest + 1) for q, b in f[m].items()):
                    continue
                cuts = [(10**6 * a * a // (f[i][" ".join(w[:i])] * f[k - i][" ".join(w[i:])]), i) for i in range(1, k)]
                score, i = min(cuts)
                made.append((-score, -a, p.encode(), f[i][" ".join(w[:i])], f[k - i][" ".join(w[i:])]))
        out += [(lang, rank, p.decode(), -a, left, right, n, -s) for rank, (s, a, p, left, right) in enumerate(sorted(made)[:keep], 1)]
    return sorted(out)


@pytest.mark.parametrize("block, longest, least", [(1 << 22, 3, 3), (40, 3, 3), (7, 4, 2), (90, 2, 2)])
def test_collocations_by_brute_force(spark, block, longest, least):
    rng = random.Random(block)
    rows = [(rng.choice(["en", "fi", None, ""]), " ".join(rng.choice(["a", "B", "b", "cd", "é", "E", "xyz.", "tt,", "n\n", "\tq", "r\x0b", " ", " "]) for _ in range(rng.randrange(120)))) for _ in range(40)]
    rows += [("en", None), ("en", ""), ("xx", " .,\t"), ("en", "a b " * 300), ("en", "a b " * 300), ("long", "z" * 300 + " y " * 5)]
    df = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 AS phrase", "2 AS f", "3 AS n", "4 AS a")
    got = sorted(tuple(r) for r in collocations.collocations(df, least=least, longest=longest, contained=50, keep=25, block=block).collect())
    assert got == plain_collocations(rows, least, longest, 50, 25)


def test_collocations_of_nothing(spark):
    df = spark.createDataFrame([("en", "a b c")], "lang string, text string")
    assert collocations.collocations(df).count() == 0 and collocations.collocations(df.where("false")).count() == 0


def test_collocation_counts_beyond_64_bits(spark):
    tables = [spark.createDataFrame(rows, "lang string, phrase string, f long") for rows in ([("x", "a", 4 * 10**12), ("x", "b", 3 * 10**12)], [("x", "a b", 10**12 + 1)])]
    (r,) = collocations.scored(tables)[0].collect()
    assert r["score"] == 10**6 * (10**12 + 1) ** 2 // (12 * 10**24)


def test_filter_lets_pass_all_when_full():
    import numpy as np

    f = collocations.Filter(1 << 16, np.full(1 << 13, 255, np.uint8))
    assert f.holds(np.arange(100, dtype=np.uint64) * np.uint64(2**57 + 1)).all()


def test_lists_are_read_a_few_blocks_at_once(spark, monkeypatch):
    """A task of many blocks read all of them at once: groups of rows are told by bytes, however few rows that are."""
    import random

    import pyarrow.parquet as pq

    monkeypatch.setattr(collocations, "GROUP", 1 << 16, raising=False)
    rng = random.Random(5)
    rows = [("en", " ".join(f"w{rng.randrange(10**6)}" for _ in range(2000))) for _ in range(120)]
    kept = []
    monkeypatch.setattr(collocations, "drop_table", kept.append)
    collocations.frequent(spark.createDataFrame(rows, "lang string, text string").coalesce(1), block=1 << 14)
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in kept[0].inputFiles()]
    sizes = [m.row_group(k).num_rows for m in groups for k in range(m.num_row_groups)]
    assert sum(sizes) == kept[0].count() > 100 and max(sizes) <= 10
