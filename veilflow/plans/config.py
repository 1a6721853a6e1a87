"""Configuration of a run, from defaults, a JSON or YAML file and keyword overrides."""

from __future__ import annotations

import importlib
import importlib.util
import json
import os
from dataclasses import dataclass, field, replace
from pathlib import Path

from ..entities import Registry, normalize_mode
from ..lexicon import SEED_ALLOW, Lexicon
from ..operators.recognizers import Recognizer, row_recognizer, rule_recognizer

# --- fixed values: aliases ------------------------------------------------------------------------
STYLES = {"placeholder": "placeholder", "tag": "placeholder", "tags": "placeholder", "remove": "remove", "delete": "remove", "strip": "remove"}
FORMATS = {"md": "markdown", "markdown": "markdown", "source": "source", "native": "source", "original": "source", "both": "both", "all": "both", "dual": "both"}
# ---------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Config:
    """What to look for and how to rewrite it. ``entities`` None means all of the mode."""

    mode: str = "strict"
    redact_style: str = "placeholder"
    output_format: str = "markdown"
    languages: tuple[str, ...] | None = None
    entities: tuple[str, ...] | None = None
    include_dates: bool = False
    score_threshold: float = 0.5
    allow: tuple[str, ...] = SEED_ALLOW
    deny: tuple[tuple[str, str], ...] = ()
    lexicon: Lexicon = field(default_factory=Lexicon)
    registry: Registry = field(default_factory=Registry)
    plugins: tuple[Recognizer, ...] = ()
    templates: tuple[str, ...] | None = None

    def effective_entities(self) -> tuple[str, ...]:
        """Types to detect: none in extract mode; dates only if asked for."""
        if self.mode == "extract":
            return ()
        own = tuple(self.entities) if self.entities is not None else tuple(self.registry.codes_for_mode(self.mode))
        return (*own, "DATE_TIME") if self.include_dates and "DATE_TIME" not in own else own


def _read(path: str | Path) -> dict:
    text = Path(path).read_text(encoding="utf-8")
    try:
        import yaml
    except ImportError:
        yaml = None
    try:
        data = yaml.safe_load(text) if yaml else json.loads(text or "{}")
    except Exception as e:
        raise ValueError(f"{path}: {e}") from e
    if data is not None and not isinstance(data, dict):
        raise ValueError(f"{path}: the top level must be a mapping")
    return data or {}


def deny_entries(raw) -> tuple[tuple[str, str], ...]:
    """Deny lists hold texts, or mappings of text and entity_type; ORG is the default type."""
    out = []
    for x in raw or ():
        text, kind = (x.get("text"), x.get("entity_type", "ORG")) if isinstance(x, dict) else (x, "ORG")
        if not isinstance(text, str) or not text.strip():
            raise ValueError(f"a deny entry needs a text: {x!r}")
        out.append((text.strip(), str(kind).upper()))
    return tuple(out)


def _module(path: str, base: Path | None):
    """A Python file next to the configuration as a module."""
    where = (base or Path()) / path
    spec = importlib.util.spec_from_file_location(where.stem, where)
    if spec is None or not where.is_file():
        raise ValueError(f"{where} is no Python file")
    made = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(made)
    return made


def plugin(entry: dict, registry: Registry, base: Path | None = None) -> Recognizer:
    """A recognizer from rules (``patterns``: name, regex, score), or from ``module: package.module:name`` or
    ``python: file.py:name``, a function of a text column that returns spans; with ``rows``, a function of one
    text that returns (start, end, score) tuples, run over Arrow batches. The type is registered unless it is
    known."""
    if "rules" in entry:
        entry = _read((base or Path()) / entry["rules"])
    if "module" in entry or "python" in entry:
        module, _, name = (entry.get("module") or entry["python"]).partition(":")
        fn = getattr(_module(module, base) if "python" in entry else importlib.import_module(module), name)
        kind = entry["entity_type"].upper()
        made = row_recognizer(entry.get("name", name), kind, fn) if entry.get("rows") else Recognizer(entry.get("name", name), (kind,), fn)
    elif entry.get("patterns"):
        kind = entry["entity_type"].upper()
        made = rule_recognizer(entry.get("name", kind), kind, [(p["regex"], float(p.get("score", 0.85))) for p in entry["patterns"]])
    else:
        raise ValueError("a plugin needs patterns or a module")
    if kind not in registry.types:
        registry.register(kind, entry.get("label"), int(entry.get("priority", 3)), entry.get("modes") or ("strict", "standard"))
    return made


#: Keys that a file may hold, and the types of their values.
KEYS = {"mode": str, "redact_style": str, "output_format": str, "languages": list, "entities": list, "include_dates": bool, "score_threshold": (int, float), "allowlist": list, "allowlist_extra": list, "denylist": list, "lexicon_extra": dict, "plugins": list, "templates": list, "template_dirs": list}


def checked(raw: dict, path) -> dict:
    """``raw`` if it holds known keys of right types only."""
    wrong = [f"{k} is not known" for k in raw if k not in KEYS]
    wrong += [f"{k} has a wrong type" for k, v in raw.items() if k in KEYS and v is not None and (not isinstance(v, KEYS[k]) or isinstance(v, bool) != (KEYS[k] is bool))]
    if wrong:
        raise ValueError(f"{path}: {'; '.join(wrong)}")
    return raw


def with_packs(cfg: Config, flag: str | None = None, folders: tuple[Path, ...] = ()) -> Config:
    """``cfg`` with the lists of its packs: those that the flag names, else the configuration's, else the default
    ones. The library's own allow list gives way to packs; a run's own entries are kept."""
    from .templates import discover, enabled_ids, run_lists

    packs = discover(*folders)
    own = tuple(a for a in cfg.allow if a not in SEED_ALLOW)
    allow, deny = run_lists(packs, enabled_ids(packs, list(cfg.templates) if cfg.templates is not None else None, flag), own, cfg.deny)
    return replace(cfg, allow=allow, deny=deny)


def load_config(path: str | Path | None = None, **overrides) -> Config:
    """Values of a file, then of the call. Plugin errors are gathered and raised together."""
    raw = checked(_read(path), path) if path else {}
    registry = Registry()
    errors, plugins = [], []
    for entry in raw.get("plugins") or ():
        try:
            plugins.append(plugin(dict(entry), registry, Path(path).parent))
        except Exception as e:
            errors.append(f"{entry}: {e}")
    if errors:
        raise ValueError("; ".join(errors))
    cfg = Config(registry=registry, plugins=tuple(plugins), lexicon=Lexicon().extended(raw.get("lexicon_extra")))
    allow = tuple(raw["allowlist"]) if raw.get("allowlist") is not None else cfg.allow
    cfg = replace(cfg, mode=normalize_mode(raw.get("mode", cfg.mode)), allow=(*allow, *(raw.get("allowlist_extra") or ())), deny=deny_entries(raw.get("denylist")))
    for key in ("score_threshold", "include_dates"):
        if key in raw:
            cfg = replace(cfg, **{key: type(getattr(cfg, key))(raw[key])})
    if raw.get("entities"):
        cfg = replace(cfg, entities=tuple(str(e).upper() for e in raw["entities"]))
    if raw.get("redact_style"):
        cfg = replace(cfg, redact_style=STYLES[str(raw["redact_style"]).lower()])
    if raw.get("output_format"):
        cfg = replace(cfg, output_format=FORMATS[str(raw["output_format"]).lower()])
    if raw.get("languages"):
        cfg = replace(cfg, languages=tuple(str(x) for x in raw["languages"]))
    if raw.get("templates") is not None:
        cfg = replace(cfg, templates=tuple(str(x) for x in raw["templates"]))
    if "mode" in overrides:
        overrides["mode"] = normalize_mode(overrides["mode"])
    return replace(cfg, **overrides)


def load_raw(path: str | Path) -> dict:
    """The keys of a configuration file."""
    return checked(_read(path), path)


def load_lists(path: str | Path) -> tuple[list[str], list[str]]:
    """The allowed and the denied surfaces of a configuration file; the library's own where there is no file. A list
    that is there and empty stays empty."""
    cfg = load_config(path if Path(path).is_file() else None)
    return list(cfg.allow), [t for t, _ in cfg.deny]


def save_lists(allow: list[str], deny: list[str], path: str | Path) -> Path:
    """Put lists into a configuration file (JSON, which is YAML, too), whose other keys stay; for its owner's eyes only. Blank
    lines and those that begin with # don't count. What a file would not be read with isn't written."""
    from .templates import lines

    path = Path(path)
    data = checked(_read(path), path) if path.is_file() else {}
    data |= {"allowlist": lines("\n".join(allow)), "denylist": [{"text": t, "entity_type": "ORG"} for t in lines("\n".join(deny))]}
    checked(data, path)
    path.parent.mkdir(parents=True, exist_ok=True)
    fd = os.open(path, os.O_WRONLY | os.O_CREAT | os.O_TRUNC | getattr(os, "O_NOFOLLOW", 0), 0o600)
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        json.dump(data, f, ensure_ascii=False, indent=2)
    os.chmod(path, 0o600)
    return path
