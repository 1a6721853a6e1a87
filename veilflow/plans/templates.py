"""Allow and deny packs: union with conflicts, teaching from reviews, storage."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as S


@dataclass(frozen=True)
class Template:
    id: str
    title: str = ""
    allow: tuple[str, ...] = ()
    deny: tuple[tuple[str, str], ...] = ()
    builtin: bool = False
    default: bool = False
    languages: tuple[str, ...] = ()
    description: str = ""


# --- fixed values: packs that come with the library -------------------------------------------------
BUILTIN = (
    Template("en-field-labels", "English field labels", ("Email", "E-mail", "Phone", "Mobile", "Fax", "Address", "Street", "City", "Country", "Name", "Reference", "Invoice", "Account", "VAT", "IBAN", "BIC", "SWIFT", "Client", "Customer", "Supplier", "Seller", "Buyer"), (), True, True, ("en",)),
    Template("fi-field-labels", "Finnish field labels", ("Y-tunnus", "Hetu", "Henkilötunnus", "ALV", "ALV-numero", "Sähköposti", "Puhelin", "Osoite", "Postinumero", "Toimipaikka", "Maa", "Nimi", "Viite", "Lasku", "Yhteyshenkilö", "Asiakas", "Myyjä", "Ostaja", "Toimittaja", "Tilaaja", "Osapuoli"), (), True, True, ("fi",)),
    Template("en-legal-boilerplate", "English legal phrases", ("Force Majeure", "Letter of Intent", "Green Card", "Governing Law", "Memorandum of Understanding", "Terms and Conditions", "Privacy Policy", "Confidential Information", "Intellectual Property"), (), True, True, ("en",)),
    Template("fi-legal-boilerplate", "Finnish legal phrases", ("Sovellettava laki", "Yleiset sopimusehdot", "Salassapito", "Vastuunrajoitus", "Vuokralainen", "Vuokranantaja", "Vakuutuksenottaja", "Vakuutuksenantaja"), (), True, True, ("fi",)),
)
# ---------------------------------------------------------------------------------------------------


def as_table(spark: SparkSession, templates: list[Template]) -> DataFrame:
    rows = [(i, t.id, t.builtin, t.default, list(t.allow), [{"text": a, "entity_type": b} for a, b in t.deny]) for i, t in enumerate(templates)]
    return spark.createDataFrame(rows, "pos int, id string, builtin boolean, default boolean, allow array<string>, deny array<struct<text:string,entity_type:string>>")


def _first(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("norm").orderBy("pos", "i")
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def union(templates: DataFrame, enabled: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(allow, deny, conflicts) of the enabled packs (pos, id): entries in order, the first of equal normal
    forms; what is allowed is not denied, and such conflicts are reported. Unknown ids are left out."""
    own = templates.drop("pos").join(enabled.select("pos", "id"), "id")
    allow = _first(own.select("pos", F.posexplode("allow").alias("i", "text")).withColumn("norm", S.entity_norm(F.col("text"))))
    deny = _first(own.select("pos", F.posexplode("deny").alias("i", "d")).select("pos", "i", "d.text", "d.entity_type").withColumn("norm", S.entity_norm(F.col("text"))))
    return allow, deny.join(allow.select("norm"), "norm", "left_anti"), deny.join(allow.select("norm"), "norm", "left_semi")


def enabled_ids(templates: list[Template], config: list[str] | None = None, flag: str | None = None) -> list[str]:
    """The flag's ids, else the configuration's, else defaults; an empty flag means none."""
    if flag is not None:
        return [x.strip() for x in flag.split(",") if x.strip()]
    return list(config) if config is not None else [t.id for t in templates if t.default]


def merged(t: Template, allow: list[str], deny: list[tuple[str, str]]) -> Template:
    """``t`` with more entries, those it has (in any case) left out."""
    have = {a.casefold() for a in t.allow}
    more = tuple(a for a in dict.fromkeys(x.strip() for x in allow) if a and not (a.casefold() in have or have.add(a.casefold())))
    denied = {d.casefold() for d, _ in t.deny}
    bad = tuple((d.strip(), k) for d, k in deny if d.strip() and not (d.strip().casefold() in denied or denied.add(d.strip().casefold())))
    return replace(t, allow=t.allow + more, deny=t.deny + bad)


def run_lists(templates: list[Template], ids: list[str], allow: tuple[str, ...] = (), deny: tuple[tuple[str, str], ...] = ()) -> tuple[tuple[str, ...], tuple[tuple[str, str], ...]]:
    """(allow, deny) of a run: the enabled packs in order, then a run's own entries. Equal entries, in any case, count
    once, and what is allowed is not denied. Ids that no pack has are an error."""
    known = {t.id: t for t in templates}
    if unknown := [i for i in ids if i not in known]:
        raise ValueError(f"no pack is named {', '.join(unknown)}; there are {', '.join(sorted(known))}")
    packs = [known[i] for i in dict.fromkeys(ids)]
    good = {a.casefold(): a for a in reversed([a for t in packs for a in t.allow] + list(allow)) if a.strip()}
    bad = {d[0].casefold(): d for d in reversed([d for t in packs for d in t.deny] + list(deny)) if d[0].strip()}
    return tuple(reversed(good.values())), tuple(d for k, d in reversed(bad.items()) if k not in good)


def fork(t: Template) -> Template:
    return replace(t, id=f"{t.id}-custom", title=f"{t.title or t.id} (custom)", builtin=False, default=False)


def lines(text: str) -> list[str]:
    return [x.strip() for x in text.splitlines() if x.strip() and not x.strip().startswith("#")]


def save(t: Template, path: Path) -> Path:
    """Write a pack as JSON, readable by its owner only."""
    path.parent.mkdir(parents=True, exist_ok=True)
    data = {"id": t.id, "title": t.title, "description": t.description, "default": t.default, "languages": t.languages, "allow": t.allow, "deny": [{"text": a, "entity_type": b} for a, b in t.deny]}
    fd = os.open(path, os.O_WRONLY | os.O_CREAT | os.O_TRUNC | getattr(os, "O_NOFOLLOW", 0), 0o600)
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        json.dump(data, f, ensure_ascii=False, indent=2)
    return path


def load(path: Path) -> Template:
    from .config import _read, deny_entries

    raw = _read(path)
    return Template(str(raw.get("id") or path.stem), str(raw.get("title") or ""), tuple(str(a) for a in raw.get("allow") or ()), deny_entries(raw.get("deny")), False, bool(raw.get("default")), tuple(raw.get("languages") or ()), str(raw.get("description") or ""))


def taught(pack: str, folder: Path, allow: list[str], deny: list[tuple[str, str]]) -> Path:
    """Add what a review taught to a pack of ``folder``; one that isn't there is made, one of the library is forked."""
    found = {t.id: t for t in discover(folder)}
    t = found.get(pack) or Template(pack, pack)
    t = fork(t) if t.builtin else t
    return save(merged(t, allow, deny), Path(folder) / f"{file_name(t.id)}.json")


def file_name(name: str) -> str:
    """``slug`` for one name on the driver."""
    out = re.sub(r"[^a-z0-9]+", "-", name.strip().lower()).strip("-")
    return out or "template"


def migrated(raw: dict) -> Template | None:
    """The lists of an old configuration as a pack of their own; None if it has none."""
    from .config import deny_entries

    allow, deny = tuple(str(a) for a in raw.get("allowlist_extra") or ()), deny_entries(raw.get("denylist"))
    return Template("my-lists", "My lists", allow, deny, default=True) if allow or deny else None


def discover(*folders: Path) -> list[Template]:
    """Packs of the library, then of each folder; later ones of an id win; files that can't be read are left out."""
    found = {t.id: t for t in BUILTIN}
    for folder in folders:
        for path in sorted(p for p in Path(folder).glob("*") if p.suffix in (".json", ".yaml", ".yml")):
            try:
                t = load(path)
            except (ValueError, OSError):
                continue
            found[t.id] = t
    return sorted(found.values(), key=lambda t: (not t.builtin, t.id))
