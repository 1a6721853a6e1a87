"""Word lists and small patterns of legal and commercial text in English and Finnish.

They name roles, form labels and collocations, not people or companies. ``Lexicon`` is a frozen snapshot;
``extended`` adds lists from a configuration."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, replace


def _set(words: str) -> frozenset[str]:
    return frozenset(w.strip() for w in words.split(",") if w.strip())


# --- fixed values: lists that results depend on ---------------------------------------------------
ROLES = _set(
    "asiakas, myyjä, ostaja, toimittaja, tilaaja, vuokralainen, vuokranantaja, osapuoli, edustaja, asiamies, yhteyshenkilö,"
    "yhteyshenkilo, allekirjoittaja, käyttäjä, kayttaja, omistaja, työntekijä, tyontekija, työnantaja, tyonantaja,"
    "vakuutuksenottaja, vakuutuksenantaja, vakuutettu, maksaja, saaja, velallinen, velkoja, urakoitsija, alihankkija,"
    "konsultti, neuvonantaja, client, customer, seller, buyer, supplier, provider, vendor, contractor, subcontractor, author,"
    "publisher, lessor, lessee, landlord, tenant, party, parties, insured, insurer, policyholder, broker, agent, signatory,"
    "principal, licensee, licensor, consultant, employee, employer, guarantor, beneficiary, payee, payer, owner, user,"
    "representative, attorney, counsel"
)
ROLE_PREFIXES = ROLES | _set("brand, brands, brändi, brändiä, partner, partners, kumppani")
COMPANY_ROLES = _set(
    "client, customer, supplier, provider, vendor, seller, buyer, contractor, toimittaja, tilaaja, asiakas, myyjä, ostaja, brand, brands, brändi, brändiä"
)
LEGAL_PHRASES = _set(
    "force majeure, green card, green cardiin, letter of intent, memorandum of understanding, terms and conditions,"
    "terms of service, privacy policy, data protection, personal data, governing law, non-disclosure, non disclosure,"
    "confidential information, intellectual property, indemnification, limitation of liability, service level agreement,"
    "data processing agreement, business day, calendar day, initial delivery date, delivery date, effective date,"
    "termination date, notice period, good faith, best efforts, arm's length, arms length, without prejudice,"
    "subject to contract, all rights reserved, confidential, henkilötiedot, henkilotiedot, sopimusehdot, yleiset ehdot,"
    "yleiset sopimusehdot, erityisehdot, peruutusehdot, salassapito, liikesalaisuus, sovellettava laki, riidanratkaisu,"
    "vahingonkorvaus, vastuunrajoitus, henkilötietojen käsittely, henkilotietojen kasittely, tietosuoja, tietosuojaseloste,"
    "sopimusrikkomus, sopimussakko, irtisanomisaika, voimaantulopäivä, voimaantulopaiva, päättymispäivä, paattymispaiva,"
    "maksuehdot, toimitusehdot, vastuu, velvollisuudet, oikeudet ja velvollisuudet, hallituksen jäsen, hallituksen jasen,"
    "toimitusjohtaja"
)
TITLE_TAILS = _set(
    "agreement, contract, policy, addendum, amendment, schedule, appendix, annex, exhibit, caselist, summaries, summary,"
    "warranty, warranties, indemnity, definitions, recitals, whereas, ehdot, peruutusehdot, veloitus, veloitusukset, palvelut,"
    "yhteensä, yhteensa, majeure, card, cardiin, sopimus, liite, liitteet, osio, luku, määritelmät, maaritelmat, vastuut,"
    "veloitusperusteet, perusteet, menettely, menettelyt, ohjeet, guidelines, principles"
)
WEAK_STEMS = (
    _set(
        "best, global, nordic, nordisk, international, european, national, general, special, standard, premium, new, first,"
        "group, holding, holdings, services, service, solutions, solution, systems, system, finland, suomi, helsinki, company,"
        "companies, yhtiö, yhtio, oyj, limited, universal, united, common, public, private, digital, smart, modern, advanced,"
        "professional, commercial, corporate, regional, local, central, paikallinen, kansallinen, eurooppalainen, pohjoismainen"
    )
    | ROLES
    | TITLE_TAILS
)
LEGALISH = _set(
    "agreement, publishing, rights, delivery, date, initial, author, changes, warranties, warranty, indemnity, indemnification,"
    "limitation, liability, information, grant, section, article, clause, schedule, appendix, promotion, distribution,"
    "copyright, manuscript, work, new, letter, intent, memorandum, understanding, contract, law, case, cases, summaries,"
    "summary, basics, convention, sale, international, european, united, nations, nation, archive, internet, caselist, list,"
    "principles, school, university, college, institute, wikipedia, wiki, leasingkohde, sopimus, sopimusehdot, ehdot, liite,"
    "osapuoli, velvollisuus, vakuutus, korvaus, maksu, veloitus, vuokra, palvelu, palvelut, premium, deductible, excess, claim,"
    "claims, coverage, policy, policies, omavastuu, vakuutusmaksu, leasing, kilometri, yliajo, ylikilometri, kilometriraja,"
    "vakuutuskausi, korvaushakemus, vahinko, riski, risk, recitals, definitions, whereas, hereby, hereof, herein, shall,"
    "confidential, salassapito, liikesalaisuus, tietosuoja, käsittely, kasittely, vastuu, rajoitus, sanktio, sanktiot,"
    "määritelmä, maaritelma, määritelmät, maaritelmat"
)
FORMISH = _set(
    "payment, iban, email, e-mail, phone, address, website, contact, account, invoice, reference, number, code, field, label,"
    "source, url, http, https, name, legal, office, registered, delivery, vehicle, network, endpoint, person, business,"
    "secondary, site, also, trading, customer, supplier, annex, synthetic, osoite, puhelin, sähköposti, sahkoposti, nimi,"
    "viite, lasku, tili, numero, tunnus, tunniste, postinumero, toimipaikka, matkapuhelin, fax, faksi, kotisivu, verkkosivu,"
    "y-tunnus, alv, vat, bic, swift, rekisterinumero, rekisteritunnus, asiakasnumero, tilausnumero, laskunumero, viitenumero,"
    "päivämäärä, paivamaara, allekirjoitus, signature, title, titteli, position, asema"
)
CUES = _set(
    "section, article, clause, schedule, appendix, annex, exhibit, whereas, hereby, hereof, pursuant, agreement, contract,"
    "liite, kohta, luku, pykälä, pykala, sopimus, sopimusehdot, ehto, ehdot, määritelmä, maaritelma, määritelmät, maaritelmat"
)
JOINERS = _set("of, and, the, for, to, a, an, on, in, ja, tai, sekä, seka, or, with, by, as")
BRAND_JOINERS = _set("of, and, the, for, to, a, an, on, in, uk, fi, en, ja, tai")
FEE_TAIL = r"(?iu)(veloitus|maksu|palkkio|vuokra|ehdot|palvelut|yhteens[aä]|raja|korvaus|vakuutus|maksuerä|erä|omavastuu|vakuutusmaksu|kilometriveloitus|ylikilometriveloitus|kilometriraja|leasingmaksu|kuukausimaksu|käyttömaksu|kayttomaksu)$"
SEED_ALLOW = tuple(
    w.strip()
    for w in (
        "Y-tunnus, Y tunnus, Hetu, Henkilötunnus, ALV-numero, ALV numero, ALV, VAT, IBAN, BIC, SWIFT, Email, E-mail, Sähköposti,"
        "Phone, Puhelin, Mobile, Fax, Address, Osoite, Street, Postinumero, Toimipaikka, City, Country, Maa, Name, Nimi,"
        "Reference, Viite, Invoice, Lasku, Account, Yhteyshenkilö, Rekisterinumero, Rekisterinumero/tunniste, Asiakas, Myyjä,"
        "Ostaja, Toimittaja, Tilaaja, Osapuoli, Vuokralainen, Vuokranantaja, Vakuutuksenottaja, Vakuutuksenantaja, Client,"
        "Customer, Supplier, Seller, Buyer, Insurer, Insured, Policyholder, Lessor, Lessee, Force Majeure, Letter of Intent,"
        "Green Card, Governing Law, Memorandum of Understanding, Terms and Conditions, Privacy Policy, Confidential Information,"
        "Intellectual Property, Sovellettava laki, Yleiset sopimusehdot, Salassapito, Vastuunrajoitus"
    ).split(",")
)
# ---------------------------------------------------------------------------------------------------


def surface_norm(text: str) -> str:
    """A surface as the lists hold it: outer white space, quotes and brackets off, case folded."""
    return text.strip().strip("\"'()«»").casefold()


@dataclass(frozen=True)
class Lexicon:
    roles: frozenset[str] = ROLES
    legal_phrases: frozenset[str] = LEGAL_PHRASES
    doc_title_tails: frozenset[str] = TITLE_TAILS
    weak_org_stems: frozenset[str] = WEAK_STEMS
    legalish_tokens: frozenset[str] = LEGALISH
    formish_tokens: frozenset[str] = FORMISH
    org_role_prefixes: frozenset[str] = ROLE_PREFIXES
    boilerplate_cues: frozenset[str] = CUES

    @property
    def noise(self) -> frozenset[str]:
        return self.roles | self.legalish_tokens | self.formish_tokens | self.doc_title_tails | JOINERS

    @property
    def weak(self) -> frozenset[str]:
        return self.weak_org_stems | self.legalish_tokens | self.formish_tokens

    def extended(self, extra: Mapping[str, Iterable[str]] | None) -> Lexicon:
        """With more words by list name; new roles are prefixes too, and weak stems hold roles and title tails."""
        own = {k: getattr(self, k) | {surface_norm(str(w)) for w in extra[k] if w is not None and surface_norm(str(w))} for k in self.__dataclass_fields__ if extra and extra.get(k)}
        new = replace(self, **own)
        return replace(new, org_role_prefixes=new.org_role_prefixes | new.roles, weak_org_stems=new.weak_org_stems | new.roles | new.doc_title_tails)
