import random

from pyspark.sql import functions as F

from veilflow.entities import Registry
from veilflow.functions.spans import SPANS, merge
from veilflow.operators import blocks as B
from veilflow.operators import filters as X
from veilflow.operators import language as L
from veilflow.operators import rewriting as W

PRIORITY = {"LOCATION": 1, "ORG": 2, "PHONE_NUMBER": 3}


def brute(spans):
    """The rules of ``merge`` in plain words, with a search among all kept spans."""
    kept = []
    for s in sorted(enumerate(spans), key=lambda v: (v[1][1], v[1][1] - v[1][2], -v[1][3], -PRIORITY[v[1][0]], v[0])):
        t, a, b, c = s[1][:4]
        hit = next((i for i, k in enumerate(kept) if a < k[2] and b > k[1]), None)
        if hit is None:
            kept.append((t, a, b, c))
            continue
        u, x, y, d = kept[hit]
        p, q = PRIORITY[t], PRIORITY[u]
        if c > d or (c == d and (p > q or (p == q and b - a > y - x))) or (p > q and c >= d - 0.15):
            kept[hit] = (t, a, b, c)
    return kept


def test_merge_matches_brute_force(spark):
    rng = random.Random(3)
    cases = []
    for i in range(300):
        spans = []
        for _ in range(rng.randint(0, 8)):
            a = rng.randint(0, 20)
            spans.append((rng.choice(list(PRIORITY)), a, a + rng.randint(1, 8), rng.choice([0.7, 0.75, 0.85, 0.9]), ""))
        cases.append((i, spans))
    df = spark.createDataFrame(cases, f"id int, xs {SPANS}").select("id", merge(F.col("xs"), Registry().priority_column).alias("m"))
    got = {r["id"]: [tuple(m)[:4] for m in r["m"]] for r in df.collect()}
    assert got == {i: brute(s) for i, s in cases}


def _one(spark, text, spans, *columns):
    return spark.createDataFrame([(text, [(t, a, b, s, text[a:b]) for t, a, b, s in spans])], f"text string, spans {SPANS}").select(*columns).first()


def test_placeholders(spark):
    text = "Alice met Alice and Bob."
    spans = [("PERSON", 0, 5, 0.9), ("PERSON", 10, 15, 0.9), ("PERSON", 20, 23, 0.9)]
    hits = W.numbered(F.col("spans"))
    row = _one(spark, text, spans, W.rewritten(F.col("text"), hits).alias("a"), W.rewritten(F.col("text"), hits, "remove").alias("b"), W.mapping(hits).alias("m"))
    assert row["a"] == "[PERSON_1] met [PERSON_1] and [PERSON_2]." and row["b"] == " met and ."
    assert [tuple(m) for m in row["m"]] == [("[PERSON_1]", "Alice"), ("[PERSON_2]", "Bob")]


def test_filters(spark):
    def left(fn, text, kind, surface):
        a = text.index(surface)
        return bool(_one(spark, text, [(kind, a, a + len(surface), 0.9)], fn(F.col("text"), F.col("spans")).alias("x"))["x"])

    assert not left(X.drop_field_labels, "Osoite: Katu 1", "STREET", "Osoite")
    assert left(X.drop_field_labels, "NORDIC WIDGETS OY: ____", "ORG", "NORDIC WIDGETS OY")
    for s in ("Customer", "Force Majeure", "GENERAL TERMS SECTION", "Kuukausimaksu", "Limitation of Liability"):
        assert not left(X.drop_false_positives, f"the {s} here", "ORG", s)
    assert left(X.drop_false_positives, "the ACME Oy here", "ORG", "ACME Oy")
    assert not left(X.drop_false_positives, "an Initial Delivery Date", "PERSON", "Initial Delivery Date")
    assert left(X.drop_false_positives, "met Alice Wonderland", "PERSON", "Alice Wonderland")
    assert not left(X.drop_false_positives, "§ 4 Definitions apply", "PERSON", "Definitions")
    assert not left(X.drop_false_positives, "in Ylikilometriveloitus", "LOCATION", "Ylikilometriveloitus")
    assert left(X.drop_false_positives, "in Helsinki", "LOCATION", "Helsinki")
    assert not left(X.drop_noisy, "a\nb", "ORG", "a\nb")


def test_text_preparation(spark):
    def of(fn, text):
        return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t")).alias("x")).first()["x"]

    assert of(B.repair, "user.name@example.f\ni") == "user.name@example.fi"
    assert [tuple(b) for b in of(B.blocks, "## Head\n\nbody\n\n- item\n\n")] == [("heading", 2, "Head"), ("paragraph", None, "body"), ("list_item", None, "- item")]
    assert of(lambda t: B.reflow(F.split(t, "\n")), "MYYJÄLIIKE\nNimi:\nACME OY") == "MYYJÄLIIKE\nNimi:\nACME OY"
    assert of(lambda t: B.reflow(F.split(t, "\n")), "soft\nwrap of (eta-\nmaat)") == "soft wrap of (eta-maat)"
    assert [tuple(r) for r in of(lambda t: B.block_ranges(F.split(t, ",")), "aaa,bb,c")] == [(0, 3), (5, 7), (9, 10)]
    assert tuple(of(L.detect, "Hi")) == (["en", "fi"], "short_text") and tuple(of(L.detect, ""))[1] == "empty_text"
    assert of(L.detect, "the cat is on the mat and it was not that of the other one " * 6)["languages"] == ["en"]
    assert L.forced("en,sv") == ["en", "sv"] and L.forced("auto") is None and L.ocr_languages("en,sv") == "eng+swe"


def test_running_headers(spark):
    rows = [("d", i, i % 3, t) for i, t in enumerate(["ACME OY, Testikatu 1, 02330 Espoo", "body one", "1 (3)"] * 3 + ["doc 7", "ASIAKAS", "body two"])]
    left = B.drop_running_headers(spark.createDataFrame(rows, "doc_id string, pos int, page int, text string"))
    assert sorted(r["text"] for r in left.collect()) == ["ASIAKAS", "body one", "body one", "body one", "body two"]
