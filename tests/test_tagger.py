import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilflow.operators import tagger as T
from veilflow.plans.config import Config
from veilflow.plans.pipeline import analyze

FIRST, LAST, FIRMS = ["Anna", "Matti", "John", "Liisa", "Pekka", "Mary"], ["Virtanen", "Smith", "Korhonen", "Bell", "Nieminen"], ["Acme", "Nordic", "Silver", "Copper"]


def _examples(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        person, firm = f"{rng.choice(FIRST)} {rng.choice(LAST)}{rng.randrange(50)}", f"{rng.choice(FIRMS)} Works{rng.randrange(90)}"
        text = rng.choice(["yesterday {p} came to see {f} about it", "the letter that {p} wrote\nto {f} was late", "we told {f}, and {p} heard", "nothing to see here at all", "signed by {p}"]).format(p=person, f=firm)
        out.append((text, [(k, text.index(s), text.index(s) + len(s), 1.0, s) for k, s in (("PERSON", person), ("ORG", firm)) if s in text]))
    return out


@pytest.mark.parametrize("seed", range(30))
def test_decoder_by_all_sequences(seed):
    rng = np.random.default_rng(seed)
    model = T.Tagger.blank(("A", "B"))
    model.moves = rng.normal(size=(5, 5)).astype(np.float32)
    scores = rng.normal(size=(4, 5)).astype(np.float32)
    out, start = model.forbidden()
    best = max((p for p in itertools.product(range(5), repeat=4) if not start[p[0]] and not any(out[a, b] for a, b in zip(p, p[1:]))), key=lambda p: sum(float(scores[i, t]) for i, t in enumerate(p)) + sum(float(model.moves[a, b]) for a, b in zip(p, p[1:])))
    assert tuple(model.decode(scores)) == best
    names = T.tags(("A", "B"))
    assert all(not n.startswith("I") or (i and names[best[i - 1]][1:] == n[1:] and names[best[i - 1]] != "O") for i, n in enumerate(names[t] for t in best))


def test_learns_names_and_finds_new_ones(spark):
    kind = "text string, spans array<struct<entity_type:string,start:int,end:int,score:double,surface:string>>"
    rows = spark.createDataFrame([*_examples(300, 1), (None, None), ("", [])], kind).repartition(3)
    model = T.learn(rows, ("PERSON", "ORG"), rounds=4)
    again = T.learn(rows, ("PERSON", "ORG"), rounds=4)
    assert np.allclose(model.weights, again.weights, atol=1e-4)
    held = _examples(100, 2)
    hit = found = there = 0
    for text, spans in held:
        got, want = set(model.spans(text)), {x[:3] for x in spans}
        hit, found, there = hit + len(got & want), found + len(got), there + len(want)
    assert hit / found > 0.95 and hit / there > 0.95
    df = spark.createDataFrame([(1, "yesterday Maija Virtanen came to see us"), (2, None)], "doc_id int, text string")
    out = analyze(df, Config(entities=("PERSON",), plugins=(T.recognizer(spark, model),)))
    assert {r["doc_id"]: [(x["surface"], x["score"]) for x in r["spans"]] for r in out.collect()} == {1: [("Maija Virtanen", 0.75)], 2: []}


def test_nothing_to_learn_from(spark):
    rows = spark.createDataFrame([(None, None)], "text string, spans array<struct<entity_type:string,start:int,end:int>>")
    model = T.learn(rows.where("false"), ("PERSON",))
    assert not model.weights.any() and T.Tagger.blank(("A",)).spans("no names\n\nhere") == []


def test_windows_of_long_lines():
    model = T.Tagger.blank(("A",))
    model.weights[T.features(["name"])[0, 1], 1] = 5  # the word's form
    line = " ".join("name" if i % 7 == 0 else f"w{i}" for i in range(3 * T.WINDOW))
    assert [line[a:b] for _, a, b in model.spans(line)] == ["name"] * len(range(0, 3 * T.WINDOW, 7))


def test_gold_tags():
    line = "Anna Bell, of Acme"
    places = T.tokens(line)
    assert T.gold(line, places, [("P", 0, 9), ("O", 14, 18), ("X", 0, 4)], ("P", "O")).tolist() == [1, 2, 0, 0, 3]
