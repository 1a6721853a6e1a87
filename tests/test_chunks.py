import random

import pytest
from pyspark.sql import functions as F

from veilflow.plans import chunks
from veilflow.plans.config import Config
from veilflow.plans.pipeline import anonymize

PARTS = [
    "Mail anna.bell@example.com or Anna.Bell@example.com today.", "Call 040 123 4567 now.", "Asiakas on LähiTapiola Rahoitus Oy.", "LähiTapiolan ehdot.",
    "Kauppakatu 12\n00100 Helsinki", "Nimi: Matti Meikäläinen\n", "Pay FI21 1234 5600 0007 85.", "Y-tunnus 0737546-2.", "plain words here and there, nothing else",
    "user.name@example.f\ni", "Virtanen, Maija met Nordic Widgets Oy.", "see https://example.com/x/y", "\n\n", "😀 ääkköset", "Name: john smith.\nBadge",
]


def _texts(n):
    rng = random.Random(n)
    return [(1, None), (2, ""), (3, "short a@b.fi")] + [(10 + i, " ".join(rng.choice(PARTS) for _ in range(60))) for i in range(n)]


@pytest.mark.parametrize("cfg", [Config(mode="strict"), Config(mode="standard", deny=(("nothing else", "ORG"),), allow=("Nordic Widgets Oy",))])
def test_chunks_give_what_whole_texts_give(spark, cfg):
    df = spark.createDataFrame(_texts(6), "doc_id long, text string")
    want = {r["doc_id"]: (r["anonymized_text"], {m["placeholder"]: m["original"] for m in r["mapping"]}) for r in anonymize(df, cfg).collect()}
    pieces, names = chunks.anonymize_chunks(df, cfg, size=350, halo=300)
    texts = {r["id"]: r["text"] for r in chunks.whole(pieces).collect()}
    maps = {i: {} for i in want}
    for r in names.collect():
        maps[r["id"]][r["placeholder"]] = r["original"]
    assert pieces.where("id >= 10").count() >= 24
    for i, (text, own) in want.items():
        assert texts[i] == text and maps[i] == own, i


def test_cuts():
    text = "a b@c.d e\n" * 50
    places = chunks.cuts(text, 40)
    assert places[0] == 0 and places[-1] == len(text) and all(0 < b - a <= 40 for a, b in zip(places, places[1:]))
    for k in places[1:-1]:
        assert text[k - 1].isspace() and "@" not in text[:k].split()[-1] and "@" not in text[k:].split()[0]
    assert chunks.cuts("x" * 100, 40) == [0, 40, 80, 100] and chunks.cuts("", 5) == [0, 0]


def test_numbers_go_over_all_chunks(spark):
    text = " ".join(f"word user{i % 700}@example.com" for i in range(3000))
    df = spark.createDataFrame([("d", text)], "key string, text string")
    pieces, names = chunks.anonymize_chunks(df, Config(entities=("EMAIL_ADDRESS",)), "key", size=4000, halo=100)
    assert chunks.whole(pieces).first()["text"] == " ".join(f"word [EMAIL_{i % 700 + 1}]" for i in range(3000))
    assert {(r["placeholder"], r["original"]) for r in names.collect()} == {(f"[EMAIL_{i + 1}]", f"user{i}@example.com") for i in range(700)}
    assert names.agg(F.max("number")).first()[0] == 700
