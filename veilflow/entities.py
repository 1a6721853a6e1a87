"""Entity types: placeholder label, merge priority and the modes that ask for a type."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

BOTH, STRICT, NONE = frozenset({"strict", "standard"}), frozenset({"strict"}), frozenset()


@dataclass(frozen=True)
class EntityType:
    code: str
    label: str
    priority: int = 3
    modes: frozenset[str] = BOTH


# --- fixed values: code, label, priority, modes ---------------------------------------------------
BUILTIN = (
    EntityType("PERSON", "PERSON", 2), EntityType("ORG", "ORG", 2, STRICT), EntityType("ORGANIZATION", "ORG", 2, STRICT),
    EntityType("EMAIL_ADDRESS", "EMAIL"), EntityType("PHONE_NUMBER", "PHONE"), EntityType("LOCATION", "LOCATION", 1, STRICT),
    EntityType("LOC", "LOCATION", 1, STRICT), EntityType("GPE", "LOCATION", 1, STRICT), EntityType("STREET", "STREET"),
    EntityType("CITY", "CITY"), EntityType("DATE_TIME", "DATE", 2, NONE), EntityType("IP_ADDRESS", "IP"),
    EntityType("CREDIT_CARD", "CREDIT_CARD"), EntityType("IBAN_CODE", "IBAN"), EntityType("US_SSN", "US_SSN", 3, NONE),
    EntityType("US_DRIVER_LICENSE", "US_DL", 3, NONE), EntityType("NRP", "NRP", 1, NONE), EntityType("FI_HETU", "FI_HETU"),
    EntityType("FI_BUSINESS_ID", "FI_BUSINESS_ID", 3, STRICT), EntityType("FI_VAT", "VAT_FI", 3, STRICT),
    EntityType("FI_LICENSE_PLATE", "PLATE_FI", 3, STRICT), EntityType("FI_POSTAL_CODE", "POSTAL"),
    EntityType("VEHICLE_VIN", "VIN", 3, STRICT), EntityType("URL", "URL", 3, STRICT), EntityType("CUSTOM", "CUSTOM", 2, NONE),
)
ALIASES = frozenset({"ORGANIZATION", "LOC", "GPE"})  # left out of presets
MODES = {"strict": "strict", "full": "strict", "standard": "standard", "light": "standard", "extract": "extract", "none": "extract"}
# ---------------------------------------------------------------------------------------------------


@dataclass
class Registry:
    """Known entity types. ``register`` refuses to change one that differs unless told to."""

    types: dict[str, EntityType] = field(default_factory=lambda: {t.code: t for t in BUILTIN})

    def register(self, code: str, label: str | None = None, priority: int = 3, modes: Iterable[str] = BOTH, overwrite: bool = False) -> EntityType:
        code = code.strip().upper()
        new = EntityType(code, (label or code).strip().upper(), priority, frozenset(modes))
        if self.types.get(code, new) != new and not overwrite:
            raise ValueError(f"{code} is registered in another way")
        self.types[code] = new
        return new

    def label_for(self, code: str) -> str:
        code = code.upper()
        if code in self.types:
            return self.types[code].label
        return f"PLATE_{code[:2]}" if len(code) == 16 and code[2:] == "_LICENSE_PLATE" else code

    def priority_for(self, code: str) -> int:
        own = self.types.get(code.upper())
        return own.priority if own else 0

    def codes_for_mode(self, mode: str) -> list[str]:
        return [c for c, t in self.types.items() if mode in t.modes and c not in ALIASES]

    def label_column(self, code: Column) -> Column:
        """The label of a type column; unknown plates by country, else the code itself."""
        out = F.when(F.upper(code).rlike("^[A-Z]{2}_LICENSE_PLATE$"), F.concat(F.lit("PLATE_"), F.substring(F.upper(code), 1, 2))).otherwise(F.upper(code))
        for c, t in self.types.items():
            if t.label != c:
                out = F.when(F.upper(code) == c, t.label).otherwise(out)
        return out

    def priority_column(self, code: Column) -> Column:
        out = F.lit(0)
        for p in sorted({t.priority for t in self.types.values()}):
            out = F.when(F.upper(code).isin(sorted(c for c, t in self.types.items() if t.priority == p)), p).otherwise(out)
        return out


def normalize_mode(mode: str) -> str:
    key = (mode or "strict").strip().lower()
    if key not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    return MODES[key]
