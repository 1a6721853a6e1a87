import pytest
from pyspark.sql import functions as F

from veilflow.functions import scalar as S
from veilflow.operators import recognizers as R


@pytest.fixture
def find(spark):
    def run(fn, text):
        rows = spark.createDataFrame([(text,)], "t string").select(fn(F.col("t")).alias("x")).first()["x"]
        assert all(text[r["start"] : r["end"]].upper() == r["surface"].upper() for r in rows)
        return [(r["entity_type"], r["surface"]) for r in rows]

    return run


@pytest.mark.parametrize(
    ("fn", "text", "surfaces"),
    [
        (R.hetu, "id 131052-308T, 131052-308X and 000000-0000", ["131052-308T"]),
        (R.business_id, "0737546-2 and 1234567-0", ["0737546-2"]),
        (R.vat, "FI28567738 or FI-07375462, not FI12345678", ["FI28567738", "FI-07375462"]),
        (R.plate, "XYZ-987 and ABC123 but OK-1", ["XYZ-987", "ABC123"]),
        (R.postal, "Testikatu 1, 02330 Espoo. Postal code:02330", ["02330", "02330"]),
        (R.postal, "order 10233099, Amount 12345.00 EUR, price=00100.50, code 02330Espoo, A02330 ", []),
        (R.postal, "Kilometri/käyttöaikaraja:\n23333\n", []),
        (R.phone, "+358 50 987 6543", ["+358 50 987 6543"]),
        (R.phone, "+358 (0) 40 123 4567 ja 050-987-6543", ["+358 (0) 40 123 4567", "050-987-6543"]),
        (R.phone, "Puhelinnumero: 0108324500", ["0108324500"]),
        (R.phone, "040 12 tai +358 1", []),
        (R.url, "https://example.com/x, www.example.fi, christofer.sj", ["https://example.com/x", "www.example.fi"]),
        (R.vin, "auto VF7YGCPAU12W11969 ja 12345678901234567", ["VF7YGCPAU12W11969"]),
        (R.address, "Avainkierto 11, 02330 ESPOO", ["Avainkierto 11", "02330", "ESPOO"]),
        (R.address, "Mannerheimintie 12 A\nlomake\n00100 Helsinki", ["Mannerheimintie 12 A", "00100", "Helsinki"]),
        (R.address, "12 Baker Street, London\nCustomer", ["12 Baker Street", "London"]),
        (R.company, "Client ACME LOGISTICS LTD; Toimittaja Nordic Widgets Oy", ["ACME LOGISTICS LTD", "Nordic Widgets Oy"]),
        (R.brand, "SILVER PINE, Letter of Intent, Payment IBAN, European Contract Law, Initial Delivery Date", ["SILVER PINE"]),
        (R.person, "Nimi:\nKorhonen, Maija", ["Korhonen, Maija"]),
        (R.person, "nimi: matti meikäläinen\nx", ["matti meikäläinen"]),
        (R.person, "Name: john smith.", ["john smith"]),
        (R.company, "with " + "Ab" * 600 + " Trade Ltd", ["Ab" * 600 + " Trade Ltd"]),
        (R.brand, "saw Copper " + "Lake" * 300 + " now", ["Copper " + "Lake" * 300]),
        (R.email, "\ue0a7 a.b@example.com \ue0a7 c@d.fi", ["a.b@example.com", "c@d.fi"]),
        (R.email, "a.b@example.com, x@y", ["a.b@example.com"]),
        (R.iban, "FI21 1234 5600 0007 85 FI22 1234 5600 0007 85", ["FI21 1234 5600 0007 85"]),
        (R.credit_card, "4111 1111 1111 1111, 4111 1111 1111 1112", ["4111 1111 1111 1111"]),
        (R.ip_address, "10.0.0.1, 300.1.1.1, 2001:db8::1", ["10.0.0.1", "2001:db8::1"]),
        (R.intl_phone, "+1 415 555 0199 or (415) 555-0199, 2025-01-01-11", ["+1 415 555 0199", "(415) 555-0199"]),
        (R.rule_recognizer("badge", "BADGE", [(r"EMP-[0-9]{6}", 0)]).spans, "Badge EMP-123456 and EMP-12.", ["EMP-123456"]),
        (lambda t: R.deny_spans(t, [("acme", "ORG")]), "ACME and Acme", ["ACME", "Acme"]),
        (R.email, "", []),
    ],
)
def test_detectors(find, fn, text, surfaces):
    assert sorted(s for _, s in find(fn, text)) == sorted(surfaces)


def test_offsets_beyond_the_basic_plane(find):
    assert find(R.email, "😀 ääkkö a@b.fi 😀 c@d.fi") == [("EMAIL_ADDRESS", "a@b.fi"), ("EMAIL_ADDRESS", "c@d.fi")]


def test_checks(spark):
    row = spark.range(1).select(
        S.valid_iban(F.lit("GB82 WEST 1234 5698 7654 32")), S.valid_iban(F.lit("GB83 WEST 1234 5698 7654 32")), S.vin_check(F.lit("1M8GDM9AXKP042788")),
        S.web_url(F.lit("christofer.sj")), S.loopback_url(F.lit("http://0.0.0.0/x")), S.loopback_url(F.lit("http://127.0.0.1:1/x")), S.slug(F.lit(" My Pack! ")), S.placeholder(F.lit("org_1")),
    ).first()
    assert list(row) == [True, False, True, False, False, True, "my-pack", "[ORG_1]"]


def test_a_hundred_thousand_matches(spark):
    """Searches and folds take time in step with the text."""
    import time

    text = " ".join(f"u{i}@example.com" for i in range(100_000))
    df = spark.createDataFrame([(text,)], "t string")
    began = time.time()
    row = df.select(R.email(F.col("t")).alias("x")).select(F.size("x").alias("n"), F.element_at("x", -1).alias("last")).first()
    assert row["n"] == 100_000 and text[row["last"]["start"] :] == "u99999@example.com" and time.time() - began < 30
