"""Whole documents: what must go, what must stay, and what must never be taken for a name."""

import pytest

from veilflow.plans.config import Config
from veilflow.plans.pipeline import anonymize

EN = """SERVICE AGREEMENT

This Agreement is made between the Customer and the Supplier on the Effective Date.

Supplier: Nordic Lantern Oy
Business id: 0737546-2, VAT FI07375462
Address: Kauppakatu 12, 00100 Helsinki
Contact person: Maija Virtanen
Email: maija.virtanen@nordiclantern.example.com
Phone: +358 50 987 6543

Customer: Copper Field Ltd
Name: John Appleby
Address: 14 Baker Street, London
Bank account: FI21 1234 5600 0007 85
Website: https://www.copperfield.example.com/contact

1. Limitation of Liability
Neither party is liable for Force Majeure. Nordic Lanternin obligations end on termination.
The Supplier shall keep Confidential Information secret. Server address 10.20.30.40 is monitored.
"""
FI = """TOIMITUSSOPIMUS

Toimittaja: Hopeakuusi Rakennus Oy
Y-tunnus: 2856773-8
Katuosoite: Avainkierto 11, 02330 ESPOO
Yhteyshenkilö: Korhonen, Maija
Puhelin: 040 123 4567
Sähköposti: maija.korhonen@hopeakuusi.example.com
Henkilötunnus: 131052-308T
Rekisterinumero: XYZ-987
Valmistenumero: VF7YGCPAU12W11969

Tilaaja ja toimittaja sopivat seuraavaa. Hopeakuusen vastuu rajoittuu sopimuksen arvoon.
Kuukausimaksu on 250 euroa. Yleiset sopimusehdot ovat liitteenä. Kilometriraja: 23333 km.
"""
MUST_GO = {
    "en": ["Nordic Lantern Oy", "0737546-2", "FI07375462", "Kauppakatu 12", "00100", "Maija Virtanen", "maija.virtanen@", "+358 50 987 6543", "Copper Field Ltd", "John Appleby", "FI21 1234 5600 0007 85", "www.copperfield.example.com", "Nordic Lanternin", "10.20.30.40", "14 Baker Street"],
    "fi": ["Hopeakuusi Rakennus Oy", "2856773-8", "Avainkierto 11", "02330", "Korhonen, Maija", "040 123 4567", "maija.korhonen@", "131052-308T", "XYZ-987", "VF7YGCPAU12W11969"],
}
MUST_STAY = {
    "en": ["SERVICE AGREEMENT", "Customer", "Supplier", "Effective Date", "Limitation of Liability", "Force Majeure", "Confidential Information", "Business id", "Bank account", "Website", "termination"],
    "fi": ["TOIMITUSSOPIMUS", "Toimittaja", "Y-tunnus", "Katuosoite", "Yhteyshenkilö", "Kuukausimaksu", "Yleiset sopimusehdot", "250 euroa", "23333 km", "Tilaaja"],
}


@pytest.fixture(scope="module")
def done(spark):
    df = spark.createDataFrame([("en", EN), ("fi", FI)], "doc_id string, text string")
    return {mode: {r["doc_id"]: r for r in anonymize(df, Config(mode=mode)).select("doc_id", "anonymized_text", "mapping").collect()} for mode in ("strict", "standard")}


@pytest.mark.parametrize("lang", ["en", "fi"])
def test_strict(done, lang):
    row = done["strict"][lang]
    assert [s for s in MUST_GO[lang] if s in row["anonymized_text"]] == []
    assert [s for s in MUST_STAY[lang] if s not in row["anonymized_text"]] == []
    originals = [m["original"] for m in row["mapping"]]
    assert all("\n" not in s and s.strip() for s in originals)
    assert not {s.lower() for s in originals} & {"customer", "supplier", "toimittaja", "tilaaja", "force majeure", "limitation of liability", "effective date", "confidential information"}
    assert not any(s.split()[0].rstrip(":").lower() in ("customer", "supplier", "toimittaja", "client") for s in originals)


def test_standard_keeps_firms_and_links(done):
    text = done["standard"]["en"]["anonymized_text"]
    assert all(s in text for s in ("Nordic Lantern Oy", "Copper Field Ltd", "0737546-2", "FI07375462", "https://www.copperfield.example.com/contact"))
    assert not any(s in text for s in ("Maija Virtanen", "maija.virtanen@", "+358 50 987 6543", "FI21 1234"))
