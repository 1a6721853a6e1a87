import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilflow.entities import Registry
from veilflow.functions.spans import SPANS
from veilflow.operators import recognizers as R
from veilflow.operators import rewriting as W
from veilflow.operators import search


def plain(text, needles):
    """(number, start, end) by one case-insensitive search a needle."""
    return [(k, m.start(), m.end()) for k, s in enumerate(needles) if s for m in re.finditer(re.escape(s), text, re.I)]


@pytest.mark.parametrize("seed", range(60))
def test_automaton_by_one_search_a_surface(seed):
    rng = random.Random(seed)
    alphabet = rng.choice(["ab", "abc A", "aäÄöÖ x", "xyzw-"])
    needles = ["".join(rng.choices(alphabet, k=rng.randrange(1, 7))) for _ in range(rng.randrange(1, 25))] + [""]
    text = "".join(rng.choices(alphabet + "q", k=300)) + (" 😀aab" if seed % 3 == 0 else "")
    machine = search.Automaton(needles)
    assert machine.find(text) == plain(text, needles)
    every = sorted((k, i) for k, s in enumerate(needles) if s for i in range(len(text)) if text[i : i + len(s)].lower() == s.lower())
    assert sorted(machine.hits(text)) == every


def test_automaton_edges():
    assert search.Automaton([]).find("abc") == [] and search.Automaton([""]).find("abc") == []
    assert search.Automaton(["ABC", "abc"]).find("xAbC") == [(0, 1, 4), (1, 1, 4)]
    assert search.Automaton(["aa"]).find("aaaaa") == [(0, 0, 2), (0, 2, 4)]
    assert search.Automaton(["aB"], fold=False).find("ab aB") == [(0, 3, 5)]
    assert search.Automaton(["Straße"]).find("STRAßE") == [(0, 0, 6)]
    with pytest.raises(ValueError):
        search.Automaton(["x" * (search.MOST_POINTS + 1)])


def test_deny_list_of_many_entries(spark):
    words = [f"word{i}x" for i in range(3000)]
    texts = [(1, "a Word17X and word170x, word17xword18x"), (2, None), (3, ""), (4, " ".join(words)), (5, "Ärtti ÄRTTI")]
    df = spark.createDataFrame(texts, "id int, text string")
    deny = [(w, "org") for w in words] + [("  ärtti ", "person"), (" ", "org")]
    got = {r["id"]: [(x["entity_type"], x["start"], x["end"], x["score"], x["surface"]) for x in r["s"]] for r in df.select("id", R.deny_spans(F.col("text"), deny).alias("s")).collect()}
    assert [x[4] for x in got[1]] == ["Word17X", "word17x", "word18x", "word170x"]
    assert got[2] == got[3] == [] and len(got[4]) == 3000
    assert got[5] == [("PERSON", 0, 5, 1.0, "Ärtti"), ("PERSON", 6, 11, 1.0, "ÄRTTI")]


def test_stems(spark):
    def of(text, *orgs):
        spans = [("ORG", text.index(o), text.index(o) + len(o), 0.9, o) for o in orgs]
        row = spark.createDataFrame([(text, spans)], f"text string, spans {SPANS}")
        row = R.with_mentions(row, "text", "spans", "x").first()["x"]
        return [(x["start"], x["surface"]) for x in row]

    text = "LähiTapiola Rahoitus Oy. LähiTapiolan, lähitapiolassa, LähiTapiolax, XLähiTapiola, LÄHITAPIOLA RAHOITUS"
    got = of(text, "LähiTapiola Rahoitus Oy")
    assert set(got) == {(0, "LähiTapiola Rahoitus"), (0, "LähiTapiola"), (25, "LähiTapiolan"), (39, "lähitapiolassa"), (83, "LÄHITAPIOLA RAHOITUS"), (83, "LÄHITAPIOLA")}
    assert set(of("Meri-Kaivos Oy: Meri Kaivos, MeriKaivoksen, merikaivosn, Meri-Kaivos", "Meri-Kaivos Oy")) >= {(0, "Meri-Kaivos"), (16, "Meri Kaivos"), (44, "merikaivosn"), (57, "Meri-Kaivos")}
    assert of("nothing here") == []
    both = spark.createDataFrame([("LähiTapiola Rahoitus Oy ja LähiTapiolan",), ("Nordic Widgets Oy, Nordic",)], "text string").withColumn("spans", R.company(F.col("text")))
    got = [sorted(x["surface"] for x in r["x"]) for r in R.with_mentions(both, "text", "spans", "x").collect()]
    assert got == [["LähiTapiola", "LähiTapiola Rahoitus", "LähiTapiolan"], ["Nordic Widgets"]]


def test_literal_mapping_in_one_pass(spark):
    rows = [(1, "Anna Bell and Anna, ANNA; Annabel", [("[P_1]", "Anna"), ("[P_2]", "Anna Bell")]), (2, "P_1 Anna", [("[P_1]", "Anna"), ("[X_1]", "P_1")]), (3, "none", []), (4, None, [("[P_1]", "a")]), (5, "keep", None)]
    df = spark.createDataFrame(rows, "id int, text string, e array<struct<placeholder:string,original:string>>")
    got = {r["id"]: r["t"] for r in df.select("id", W.apply_mapping(F.col("text"), F.col("e")).alias("t")).collect()}
    assert got == {1: "[P_2] and [P_1], ANNA; [P_1]bel", 2: "[X_1] [P_1]", 3: "none", 4: None, 5: "keep"}


@pytest.mark.parametrize("seed", range(3))
def test_table_of_surfaces(spark, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abÄ") + "".join(rng.choices("abcdÄ ", k=rng.randrange(2, 5))) + rng.choice("abä")
    entries = [(rng.choice("xy"), word(), rng.choice(["org", "PERSON"])) for _ in range(60)] + [("x", "  ", "org")]
    docs = [(i, rng.choice("xyz"), "".join(rng.choices("abcdäÄ ", k=300))) for i in range(25)] + [(90, "x", None), (91, "y", ""), (92, "x", "abc")]
    docs += [docs[0], (93, docs[1][1], docs[1][2])]
    e = spark.createDataFrame(entries, "g string, surface string, entity_type string")
    d = spark.createDataFrame(docs, "id int, g string, text string").withColumn("surface", F.lit("own")).withColumn("gram", F.lit(1))
    for within in (None, "g"):
        out = search.search_table(d, e, within=within)
        assert out.columns == [*d.columns, "spans"]
        got = sorted(((r["id"], sorted((x["entity_type"], x["start"], x["end"]) for x in r["spans"])) for r in out.collect()), key=repr)
        want = []
        for i, g, t in docs:
            own = {(s.strip(), k.upper()) for h, s, k in entries if (within is None or h == g) and s.strip()}
            want.append((i, sorted((k, m.start(), m.end()) for s, k in own for m in re.finditer(re.escape(s), t or "", re.I))))
        assert got == sorted(want, key=repr)


def test_table_refuses_short_surfaces(spark):
    df = spark.createDataFrame([("abc", "org", "abc")], "surface string, entity_type string, text string")
    with pytest.raises(ValueError):
        search.search_table(df, df)


@pytest.mark.parametrize("seed", range(4))
def test_numbers_by_first_appearance(spark, seed):
    """Against a plain count: labels, other spellings of one entity, one or very many entities."""
    rng = random.Random(seed)
    types = ["PERSON", "ORG", "EMAIL_ADDRESS", "CITY"]
    spans, at = [], 0
    for _ in range([0, 1, 40, 700][seed]):
        s = rng.choice(["Anna", "anna", "ANNA  B", "anna b", "Ä", "ä", "x" * rng.randrange(1, 40)])
        at += rng.randrange(1, 5)
        spans.append((rng.choice(types), at, at + len(s), 0.9, s))
        at += len(s)
    want, seen = [], {}
    for t, a, b, _, s in spans:
        label = Registry().label(t) if hasattr(Registry(), "label") else {"EMAIL_ADDRESS": "EMAIL"}.get(t, t)
        own = seen.setdefault(label, {})
        n = own.setdefault(" ".join(s.split()).lower(), len(own) + 1)
        want.append((a, n, f"[{label}_{n}]"))
    rng.shuffle(spans)
    df = spark.createDataFrame([(spans,)], f"spans {SPANS}").select(W.numbered(F.col("spans")).alias("h"))
    row = df.select("h", W.mapping(F.col("h")).alias("m")).first()
    assert [(x["start"], x["number"], x["placeholder"]) for x in row["h"]] == want
    firsts = {}
    for x in row["h"]:
        firsts.setdefault(x["placeholder"], x["surface"])
    assert [tuple(x) for x in row["m"]] == list(firsts.items())


@pytest.mark.parametrize("seed", range(20))
def test_surfaces_singly_and_by_automaton(seed):
    rng = random.Random(seed)
    needles = ["".join(rng.choices("aÄb ", k=rng.randrange(1, 6))) for _ in range(20)] + [""]
    text = "".join(rng.choices("aAäÄbB ß😀", k=400))
    assert search._find(text, needles) == search.Automaton(needles).find(text) == search._find(text, needles + ["zz"] * 20)


def test_surfaces_that_begin_alike_meet_only_texts_that_hold_them():
    """Surfaces have all their short grams in common, and most of their letters: texts met hundreds of them, or all."""
    import pyarrow as pa

    surfaces = [f"Supplier#{i:09d}" for i in range(2000)]
    keys = search._surface_keys(pa.array(surfaces)).to_pylist()
    bits = 1 << 17
    firsts, wholes = np.zeros(bits, bool), np.zeros(bits, bool)
    firsts[[k["first"] & (bits - 1) for k in keys]] = True
    wholes[[k["whole"] & (bits - 1) for k in keys]] = True
    numbers = {k["whole"]: i for i, k in enumerate(keys)}
    texts = [f"by supplier#{i:09d} and SUPPLIER#{i + 1:09d}" for i in range(0, 1900, 7)] + ["", "supplier#00000", "supplier#", "000000012 supplier"]
    row, key = search._met(texts, {16: [18]}, firsts, wholes)
    met = {}
    for r, k in zip(row.tolist(), key.tolist()):
        met.setdefault(r, []).append(numbers.get(k))
    for i, t in enumerate(texts):
        own = [x for x in met.get(i, []) if x is not None]
        assert sorted(own) == [k for k, s in enumerate(surfaces) if s.lower() in t.lower()]
        assert len(met.get(i, [])) <= 4


@pytest.mark.parametrize("size", [4, 5, 7, 8, 9, 31, 32, 33, 300])
def test_table_of_surfaces_of_each_size(spark, size):
    """At both ends of texts, across neighbouring texts of one step, and one letter off."""
    s = "".join(random.Random(size).choices("abcdefghÄ", k=size))
    rows = [(0, s.upper()), (1, "x" + s), (2, s + "x" + s), (3, s[:-1]), (4, s[-1:] + "q"), (5, s[:-1] + "#"), (6, "#" + s[1:]), (7, s[: size // 2]), (8, s[size // 2 :])]
    out = search.search_table(spark.createDataFrame(rows, "id int, text string").coalesce(1), spark.createDataFrame([(s, "org")], "surface string, entity_type string"))
    got = {r["id"]: [x["start"] for x in r["spans"] or []] for r in out.collect()}
    assert got == {0: [0], 1: [1], 2: [0, size + 1]} | {i: [] for i in range(3, 9)}


def test_tables_of_surfaces_move_no_texts(spark):
    """Hits join the rows they are asked for by hashes of texts; the texts themselves, and what only looks like a surface, stay."""
    rows = [(k, f"text {k} with ABCDEFGH and again abcdefgh abcdEFGHabcdefgh") for k in range(3)] * 2 + [(7, None), (8, "aaaaaaaaa")]
    docs = spark.createDataFrame(rows, "id int, text string")
    entries = spark.createDataFrame([("abcdefgh", "org"), ("ABCDEFGH", "org"), ("aaaa", "x")], "surface string, entity_type string")
    out = search.search_table(docs, entries)
    plan = out.select("id", F.size("spans"))._jdf.queryExecution().optimizedPlan().toString()
    left = next(x for x in plan[plan.index("Join LeftOuter") :].splitlines() if "Project" in x)
    assert "xxhash64(text#" in left and not re.search(r"[\[ ]text#", left)
    got = sorted((r["id"], [(x["start"], x["surface"]) for x in r["spans"]]) for r in out.collect())
    places = [(12, "ABCDEFGH"), (31, "abcdefgh"), (40, "abcdEFGH"), (48, "abcdefgh")]
    assert got == sorted([(k, places * 2) for k in range(3)] * 2 + [(7, []), (8, [(0, "aaaa"), (4, "aaaa")])])
