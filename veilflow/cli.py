"""Command line: anonymize files or a folder. ``python -m veilflow.cli [MODE] PATH -o OUT``; nothing leaves the machine.

``templates list|get|new|fork|delete|teach|set-enabled|print-enabled`` keep packs of allowed and denied surfaces,
``lists print|save|migrate`` a configuration's own ones; ``doctor`` tells what this installation can do."""

from __future__ import annotations

import argparse
import json
import logging
import sys
import time
from dataclasses import replace
from datetime import datetime, timezone
from pathlib import Path

from .entities import Registry
from .operators.language import forced, ocr_languages
from .plans import review, templates
from .plans.config import FORMATS, STYLES, load_config, load_lists, load_raw, save_lists, with_packs
from .plans.pipeline import anonymize_blocks
from .plans.tables import remove, written
from .shipping import ship
from .sources import sinks
from .sources.files import collect_inputs, read_documents, recognized

MODES = ("extract", "standard", "strict")
CONFIG, PACKS = Path("~/.config/veilflow/config.json"), Path("~/.config/veilflow/templates")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="veilflow", description=__doc__)
    p.add_argument("path", nargs="?")
    p.add_argument("-o", "--output", default="-", help="Markdown file of one input, a folder, or - for standard output")
    p.add_argument("--out-dir", help="folder for the results of many inputs")
    p.add_argument("-m", "--mode", default=None, help="strict, standard or extract")
    p.add_argument("--config")
    p.add_argument("--redact-style", choices=sorted(STYLES), default=None)
    p.add_argument("--format", choices=sorted(FORMATS), default=None, help="Markdown, the source's own format, or both")
    p.add_argument("--entities", help="types, with commas between")
    p.add_argument("--include-dates", action="store_true")
    p.add_argument("--score-threshold", type=float)
    p.add_argument("--lang", default="auto")
    p.add_argument("--map", help="file for the placeholder map of one input, or folder for those of many")
    p.add_argument("--template", "--templates", dest="templates", help="packs to use, with commas between; empty for none")
    p.add_argument("--template-dir", default=str(PACKS), help="folder of one's own packs")
    p.add_argument("--learn-to", help="pack that takes what --reject names as allowed")
    p.add_argument("--reject", help="placeholders to keep clear, such as org_1, with commas between")
    p.add_argument("--force-ocr", action="store_true")
    p.add_argument("--no-ocr", action="store_true")
    p.add_argument("--keep-headers", action="store_true")
    p.add_argument("-q", "--quiet", action="store_true")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("--list-entities", action="store_true")
    p.add_argument("--version", action="version", version=sinks.VERSION)
    return p


def packs(argv: list[str]) -> int:
    """The verbs of ``templates``."""
    p = argparse.ArgumentParser(prog="veilflow templates")
    p.add_argument("verb", choices=("list", "get", "new", "fork", "delete", "teach", "set-enabled", "print-enabled"))
    p.add_argument("id", nargs="?", default="")
    p.add_argument("--title", default="")
    p.add_argument("--allow", action="append", default=[])
    p.add_argument("--deny", action="append", default=[])
    p.add_argument("--dir", default=str(PACKS))
    a = p.parse_args(argv)
    folder = Path(a.dir).expanduser()
    found = {t.id: t for t in templates.discover(folder)}
    enabled = folder / "enabled.list"
    shown = lambda t: {"id": t.id, "title": t.title, "builtin": t.builtin, "default": t.default, "languages": list(t.languages), "allow": list(t.allow), "deny": [{"text": x, "entity_type": k} for x, k in t.deny]}
    if a.verb in ("get", "fork", "delete") and a.id not in found:
        print(f"no pack is named {a.id}", file=sys.stderr)
        return 2
    if a.verb == "list":
        print(json.dumps([shown(t) for t in found.values()], ensure_ascii=False))
    elif a.verb == "get":
        print(json.dumps(shown(found[a.id]), ensure_ascii=False))
    elif a.verb in ("new", "teach"):
        if not (a.title or a.id).strip():
            print("a pack needs a title", file=sys.stderr)
            return 2
        name = a.id or templates.file_name(a.title)
        if a.verb == "new" and name in found:
            print(f"{name} is there already", file=sys.stderr)
            return 2
        if a.verb == "new":
            templates.save(templates.Template(name, a.title or name), folder / f"{templates.file_name(name)}.json")
        print(templates.taught(name, folder, a.allow, [(x, "ORG") for x in a.deny]))
    elif a.verb == "fork":
        made = templates.fork(found[a.id])
        templates.save(made, folder / f"{templates.file_name(made.id)}.json")
        print(made.id)
    elif a.verb == "delete":
        if found[a.id].builtin:
            print("packs of the library stay", file=sys.stderr)
            return 2
        (folder / f"{templates.file_name(a.id)}.json").unlink()
    elif a.verb == "set-enabled":
        folder.mkdir(parents=True, exist_ok=True)
        enabled.write_text(a.id, encoding="utf-8")
    else:
        print(",".join(templates.enabled_ids(list(found.values()), flag=enabled.read_text(encoding="utf-8") if enabled.is_file() else None)))
    return 0


def lists(argv: list[str]) -> int:
    """The verbs of ``lists``: print the allowed and denied surfaces of a configuration, or save new ones from files."""
    p = argparse.ArgumentParser(prog="veilflow lists")
    p.add_argument("verb", choices=("print", "save", "migrate"))
    p.add_argument("--config", default=str(CONFIG))
    p.add_argument("--allow-file")
    p.add_argument("--deny-file")
    p.add_argument("--dir", default=str(PACKS))
    a = p.parse_args(argv)
    path = Path(a.config).expanduser()
    if a.verb == "save":
        allow, deny = load_lists(path)
        own = lambda name, old: Path(name).read_text(encoding="utf-8").splitlines() if name else old
        print(save_lists(own(a.allow_file, allow), own(a.deny_file, deny), path))
    elif a.verb == "migrate":
        pack = templates.migrated(load_raw(path)) if path.is_file() else None
        if pack is None:
            print("the configuration has no lists", file=sys.stderr)
            return 2
        print(templates.save(pack, Path(a.dir).expanduser() / f"{templates.file_name(pack.id)}.json"))
    else:
        allow, deny = load_lists(path)
        print("\n".join(["---ALLOW---", *allow, "---DENY---", *deny]))
    return 0


def doctor() -> int:
    """What this installation can do: Spark, Java, the shared folder, and the programs that plugins of formats use."""
    import importlib.util
    import os
    import shutil

    import pyspark

    rows = [("python", sys.version.split()[0], True), ("pyspark", pyspark.__version__, True), ("java", shutil.which("java") or os.environ.get("JAVA_HOME", ""), True)]
    rows += [("yaml configurations", "PyYAML" if importlib.util.find_spec("yaml") else "", False), ("PDF text", "PyMuPDF" if importlib.util.find_spec("pymupdf") else "", False), ("recognition of scans", shutil.which("ocrmypdf") or "", False)]
    for name, found, needed in rows:
        print(name, found or ("missing" if needed else "not installed"), sep="\t")
    return int(any(needed and not found for _, found, needed in rows))


def main(argv: list[str] | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    if argv[:1] == ["lists"]:
        return lists(argv[1:])
    if argv[:1] == ["doctor"]:
        return doctor()
    if argv[:1] == ["templates"]:
        return packs(argv[1:])
    if argv[:1] and argv[0] in MODES:
        argv = [*argv[1:], "--mode", argv[0]]
    a = parser().parse_args(argv)
    if a.list_entities:
        for t in Registry().types.values():
            print(t.code, t.label, t.priority, ",".join(sorted(t.modes)), sep="\t")
        return 0
    if not a.path:
        parser().error("a path is needed")
    began = time.monotonic()
    say = (lambda *x: None) if a.quiet else (lambda *x: print(*x, file=sys.stderr))
    over = {k: v for k, v in {"mode": a.mode, "score_threshold": a.score_threshold}.items() if v is not None}
    if a.redact_style:
        over["redact_style"] = STYLES[a.redact_style]
    if a.format:
        over["output_format"] = FORMATS[a.format]
    if a.entities:
        over["entities"] = tuple(x.strip().upper() for x in a.entities.split(",") if x.strip())
    if forced(a.lang):
        over["languages"] = tuple(forced(a.lang))
    if a.include_dates:
        over["include_dates"] = True
    folder = Path(a.template_dir).expanduser()
    cfg = load_config(a.config, **over)
    saved = folder / "enabled.list"
    flag = saved.read_text(encoding="utf-8") if a.templates is None and cfg.templates is None and saved.is_file() else a.templates
    cfg = with_packs(cfg, flag, (folder,))
    inputs = collect_inputs(a.path)
    one, root = len(inputs) == 1, str(Path(a.path) if Path(a.path).is_dir() else Path(a.path).parent)
    target = a.out_dir or (None if a.output == "-" else a.output)
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    if not a.verbose:
        logging.getLogger("py4j").setLevel(logging.ERROR)
    spark = SparkSession.builder.appName("veilflow").config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate()
    languages = ocr_languages(a.lang)
    ship(spark)
    # files are parsed once, and documents worked out once, however many results are asked for
    docs = written(read_documents(spark, str(a.path), inputs, a.keep_headers, ocr=lambda content: recognized(content, languages), force_ocr=a.force_ocr, no_ocr=a.no_ocr))
    bad = docs.where("error IS NOT NULL").select("source", "error").collect()
    for r in bad:
        print(f"{r['source']}: {r['error']}", file=sys.stderr)
    say(f"{docs.count() - len(bad)} files read in {time.monotonic() - began:.1f} s")
    out = written(anonymize_blocks(docs.where("error IS NULL"), cfg))
    if a.reject:
        out = _without(out, a.reject, cfg, folder if a.learn_to else None, a.learn_to)
    made = sinks.markdown_document(out, cfg.mode, cfg.redact_style, a.lang, datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"))
    if cfg.output_format in ("markdown", "both"):
        if target is None:
            for r in made.orderBy("source").toLocalIterator():
                print(r["markdown"])
        elif one and not a.out_dir and Path(target).suffix:
            rows = made.select(F.lit(Path(target).name).alias("path"), F.col("markdown").cast("binary").alias("content"))
            sinks.write_files(rows, str(Path(target).absolute().parent))
        else:
            sinks.write_markdown(made, str(Path(target).absolute()), root, cfg.mode)
    if cfg.output_format in ("source", "both"):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(a.path)).select(F.col("path").alias("source"), "content")
        native = written(sinks.native_documents(out, files, cfg.redact_style))
        rows = native.where("error IS NULL").select(sinks.relative(F.col("source"), root, sinks.native_name(F.col("source"))).alias("path"), "content")
        say(sinks.write_files(rows, str(Path(target or root).absolute())), "files in their own format")
        for r in native.where("error IS NOT NULL").select("source", "error").collect():
            print(f"{r['source']}: {r['error']}", file=sys.stderr)
        for r in sinks.native_stats(native).orderBy("document").toLocalIterator():
            say(f"{r['document']}: {r['found']} of {r['total']} surfaces found, {r['hit_count']} replaced" + (f"; not found: {', '.join(r['missing'][:10])}" if r["missing"] else ""))
        remove(native)
    if a.map and one and Path(a.map).suffix:
        sinks.write_map({m["placeholder"]: m["original"] for m in out.first()["mapping"]}, a.map)
    elif a.map:
        sinks.write_maps(out, str(Path(a.map).absolute()), root)
    remove(docs)
    say(f"{len(inputs) - len(bad)} of {len(inputs)} files done in {time.monotonic() - began:.1f} s")
    return 1 if bad and len(bad) == len(inputs) else 0


def _without(out, rejected: str, cfg, folder: Path | None, pack: str | None):
    """Documents with the named placeholders switched off; a pack may learn their surfaces as allowed."""
    from pyspark.sql import functions as F

    table = review.reject(review.findings(out.select(F.col("source").alias("document"), "hits"), "document"), rejected)
    if folder is not None:
        allow, _ = review.teach(table)
        templates.taught(pack, folder, [r["text"] for r in allow.collect()], [])
    names = [x for x in (y.strip().strip("[]").upper() for y in rejected.replace(";", ",").replace(" ", ",").split(",")) if x]
    off = F.array(*[F.lit(f"[{n}]") for n in names])
    kept = lambda xs: F.filter(xs, lambda h: ~F.array_contains(off, h["placeholder"]))
    back = lambda b: F.struct(b["kind"].alias("kind"), b["level"].alias("level"), F.aggregate(F.filter(F.col("mapping"), lambda m: F.array_contains(off, m["placeholder"])), b["text"], lambda t, m: F.replace(t, m["placeholder"], m["original"])).alias("text"))
    out = out.withColumn("anonymized_blocks", F.transform("anonymized_blocks", back))
    return out.withColumn("hits", kept(F.col("hits"))).withColumn("mapping", kept(F.col("mapping")))


if __name__ == "__main__":
    raise SystemExit(main())
