import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilflow.operators import language as L

# sentences that no profile was learnt from
HELD_OUT = {
    "en": ["The lawyer read the letter twice before he gave it back to his client.", "Our new neighbours are very friendly and often invite us to dinner.", "You should never leave a dog alone in a hot car during summer.", "The museum will be closed for repairs until the beginning of next year.", "Nobody believed the old man when he spoke about the storm.", "Please send the signed form to the address given below.", "They have been waiting for the train since half past seven.", "A small garden with apple trees lies behind the house."],
    "fi": ["Lakimies luki kirjeen kahdesti ennen kuin antoi sen takaisin asiakkaalleen.", "Uudet naapurimme ovat hyvin ystävällisiä ja kutsuvat meidät usein illalliselle.", "Koiraa ei saa koskaan jättää yksin kuumaan autoon kesällä.", "Museo on suljettu korjausten vuoksi ensi vuoden alkuun saakka.", "Kukaan ei uskonut vanhaa miestä, kun tämä puhui myrskystä.", "Lähetä allekirjoitettu lomake alla olevaan osoitteeseen.", "He ovat odottaneet junaa puoli kahdeksasta lähtien.", "Talon takana on pieni puutarha, jossa kasvaa omenapuita."],
    "sv": ["Advokaten läste brevet två gånger innan han gav det tillbaka till sin klient.", "Våra nya grannar är mycket vänliga och bjuder oss ofta på middag.", "Man får aldrig lämna en hund ensam i en varm bil på sommaren.", "Museet är stängt för reparationer fram till början av nästa år.", "Ingen trodde på den gamle mannen när han talade om stormen.", "Skicka den undertecknade blanketten till adressen nedan.", "De har väntat på tåget sedan halv åtta på morgonen.", "Bakom huset ligger en liten trädgård med äppelträd."],
}


def test_held_out_sentences():
    right = sum(L.CODES[int(np.argmin(L.distances(s)))] == code for code, own in HELD_OUT.items() for s in own)
    assert right == sum(map(len, HELD_OUT.values()))


@pytest.mark.parametrize("code", L.CODES)
def test_long_texts_are_decided_and_mixed_ones_keep_both(spark, code):
    other = {"en": "fi", "fi": "sv", "sv": "en"}[code]
    own, both = " ".join(HELD_OUT[code]), " ".join(HELD_OUT[code] + HELD_OUT[other])
    rows = spark.createDataFrame([(0, own), (1, both), (2, "one two"), (3, None), (4, "12 34 " * 50)], "id int, text string")
    got = {r["id"]: (r["x"]["languages"], r["x"]["reason"]) for r in rows.select("id", L.detect(F.col("text")).alias("x")).collect()}
    assert got[0] == ([code], "scored")
    assert (sorted(got[1][0]), got[1][1]) == (sorted([code, other]), "scored")
    assert got[2] == (["en", "fi"], "short_text") and got[3] == (["en", "fi"], "empty_text") and got[4][1] == "short_text"


def test_profiles_by_a_plain_count():
    rng = random.Random(2)
    text = "".join(rng.choice("abc dÄ.1") for _ in range(400))
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    padded = " " + " ".join(words) + " "
    counts = {}
    for n in L.GRAMS:
        for i in range(len(padded) - n + 1):
            g = padded[i : i + n]
            if g.strip() and " " not in g[1:-1] and (n > 1 or g != " "):
                counts[g] = counts.get(g, 0) + 1
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
    want = sorted(counts, key=lambda g: (-counts[g], code(g)))[: L.RANKS]
    assert [int(x) for x in L._ranked(text)] == [code(g) for g in want]
    assert L.distances("") == L.distances("123") == [1.0] * 3
