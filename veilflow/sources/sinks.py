"""Results as files: Markdown with front matter, maps as JSON, redacted DOCX, match statistics."""

from __future__ import annotations

import io
import json
import os
import re
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import blocks as B


def output_name(source: Column, mode: str = "strict") -> Column:
    """``stem.anonymized.md``; in extract mode ``stem.md``, or ``stem.extracted.md`` where that is the source."""
    name = F.element_at(F.split(source, "/"), -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    if mode == "extract":
        return F.when(F.lower(name).rlike(r"\.md$"), F.concat(stem, F.lit(".extracted.md"))).otherwise(F.concat(stem, F.lit(".md")))
    return F.concat(stem, F.lit(".anonymized.md"))


def native_name(source: Column) -> Column:
    """``stem.anonymized.docx`` or ``.pdf``; null for formats that keep no layout."""
    name = F.element_at(F.split(source, "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    return F.when(ext.isin(".docx", ".pdf"), F.concat(F.regexp_replace(name, r"\.[^.]*$", ""), F.lit(".anonymized"), ext))


VERSION = "0.2.0"


def markdown_document(out: DataFrame, mode: str = "strict", style: str = "placeholder", lang_mode: str = "auto", anonymized_at: str | None = None) -> DataFrame:
    """(source, markdown) from anonymized documents with ``source`` and ``anonymized_blocks``. A time is written only if
    it is given, so that reruns agree."""
    counts = F.to_json(F.map_from_entries(F.transform(F.array_distinct(F.transform("hits", lambda h: h["entity_type"])), lambda t: F.struct(t, F.size(F.array_distinct(F.transform(F.filter("hits", lambda h: h["entity_type"] == t), lambda h: h["norm"])))))))
    quoted = lambda x: F.lit(json.dumps(x, ensure_ascii=False))
    text = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    fields = {"source": text("source"), "tool": quoted("veilflow"), "tool_version": quoted(VERSION), "mode": quoted(mode), "redact_style": quoted(style), "lang_mode": quoted(lang_mode), "detected_languages": F.to_json("language.languages"), "nlp_passes": F.lit("[]"), "entity_counts": counts}
    fields["used_ocr"] = F.col("used_ocr").cast("string") if "used_ocr" in out.columns else F.lit("false")
    if anonymized_at:
        fields["anonymized_at"] = quoted(anonymized_at)
    return out.select("source", F.concat(B.front_matter(fields), B.markdown(F.col("anonymized_blocks")), F.lit("\n")).alias("markdown"))


def relative(source: Column, root: str, name: Column) -> Column:
    """``name`` in the folder that ``source`` has below ``root``: sources of one name in two folders stay apart."""
    below = F.regexp_replace(F.regexp_replace(source, "^file:/*", "/"), "^" + re.escape(str(Path(root).absolute())) + "/*", "")
    return F.concat(F.regexp_replace(below, "[^/]*$", ""), name)


def _writer(folder: str, private: bool):
    def run(batches):
        for batch in batches:
            sizes = []
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                target = Path(folder) / name
                if not target.resolve().is_relative_to(Path(folder).resolve()):
                    raise ValueError(f"{name} leads out of {folder}")
                target.parent.mkdir(parents=True, exist_ok=True)
                part = target.with_name(f".{target.name}.{os.getpid()}")
                fd = os.open(part, os.O_WRONLY | os.O_CREAT | os.O_TRUNC | getattr(os, "O_NOFOLLOW", 0), 0o600 if private else 0o644)
                with os.fdopen(fd, "wb") as f:
                    f.write(content)
                os.replace(part, target)  # a retried task writes the same file again
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(sizes, pa.int64())], ["path", "size"])

    return run


def write_files(files: DataFrame, folder: str, private: bool = False) -> int:
    """Write a table (path below the folder, content) as one file a row, by the tasks; the folder must be one that
    all of them share. Returns how many."""
    if "://" in folder and not folder.startswith("file://"):
        raise ValueError("files are written to a mounted folder; write a table to other stores")
    return files.select("path", "content").mapInArrow(_writer(folder.removeprefix("file://"), private), "path string, size long").count()


def write_markdown(documents: DataFrame, folder: str, root: str = "/", mode: str = "strict") -> int:
    """Markdown files of a table (source, markdown), in the folders that the sources have below ``root``."""
    return write_files(documents.select(relative(F.col("source"), root, output_name(F.col("source"), mode)).alias("path"), F.col("markdown").cast("binary").alias("content")), folder)


def write_maps(out: DataFrame, folder: str, root: str = "/") -> int:
    """The placeholder map of each document as JSON, readable by its owner only."""
    body = F.to_json(F.map_from_entries(F.transform("mapping", lambda m: F.struct(m["placeholder"], m["original"]))))
    name = F.regexp_replace(output_name(F.col("source")), r"\.md$", ".map.json")
    return write_files(out.select(relative(F.col("source"), root, name).alias("path"), body.cast("binary").alias("content")), folder, private=True)


def write_map(entries: dict[str, str], path: str | Path) -> None:
    """Placeholder map of one document as JSON, for its owner's eyes only; never through a link."""
    fd = os.open(path, os.O_WRONLY | os.O_CREAT | os.O_TRUNC | getattr(os, "O_NOFOLLOW", 0), 0o600)
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        json.dump(entries, f, ensure_ascii=False, indent=2)


def redact_docx(content: bytes, entries: list[tuple[str, str]], style: str = "placeholder") -> tuple[bytes, dict[str, int]]:
    """A DOCX with every surface replaced in body, tables, headers and footers, and its properties blanked.

    ``entries`` are (placeholder, surface). Runs are joined per paragraph, so surfaces that formatting splits are found
    too. Also how often each surface was replaced."""
    from xml.etree import ElementTree

    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    hits = {s: 0 for _, s in entries}
    source, target = zipfile.ZipFile(io.BytesIO(content)), io.BytesIO()
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for item in source.infolist():
            data = source.read(item)
            if re.fullmatch(r"word/(document|header\d*|footer\d*|footnotes|endnotes|comments)\.xml", item.filename):
                root = ElementTree.fromstring(data)
                for p in root.iter(f"{w}p"):
                    runs = [t for t in p.iter(f"{w}t")]
                    old = new = "".join(t.text or "" for t in runs)
                    for tag, surface in sorted(entries, key=lambda e: (-len(e[1]), e[1].casefold())):
                        for form in dict.fromkeys((surface, surface.replace(" ", " "), " ".join(surface.split()))):
                            if form and form in new:
                                hits[surface] += new.count(form)
                                new = new.replace(form, "" if style == "remove" else tag)
                    if new != old:
                        runs[0].text = new
                        runs[0].set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
                        for t in runs[1:]:
                            t.text = ""
                data = ElementTree.tostring(root, xml_declaration=True, encoding="UTF-8")
            elif item.filename == "docProps/core.xml":
                data = re.sub(rb">[^<>]+</(dc:creator|cp:lastModifiedBy|dc:title|dc:subject|dc:description|cp:keywords|cp:category)>", rb"></\1>", data)
            out.writestr(item.filename, data)
    return target.getvalue(), hits


_NATIVE = "source string, content binary, stats array<struct<surface:string,n:int>>, error string"


def _redacted(style: str):
    def run(batches):
        for batch in batches:
            made, stats, errors = [], [], []
            for source, content, entries in zip(*(batch.column(c).to_pylist() for c in ("source", "content", "mapping"))):
                new, hits, error = None, {}, None
                try:
                    new, hits = redact_docx(content, [(e["placeholder"], e["original"]) for e in entries], style)
                except Exception as e:  # one bad file must not stop a folder
                    error = f"{type(e).__name__}: {e}"
                made.append(new)
                stats.append([{"surface": k, "n": v} for k, v in hits.items()])
                errors.append(error)
            kind = pa.list_(pa.struct([("surface", pa.string()), ("n", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("source"), pa.array(made, pa.binary()), pa.array(stats, kind), pa.array(errors, pa.string())], ["source", "content", "stats", "error"])

    return run


def native_documents(out: DataFrame, files: DataFrame, style: str = "placeholder") -> DataFrame:
    """(source, content, stats, error): DOCX files (source, content) redacted by the maps of ``out``. Other formats
    are left out: a PDF file's text is covered safely by rewriting the whole file only, which Markdown does. Files that
    fail have an error."""
    known = files.where(F.lower("source").endswith(".docx")).select("source", "content")
    return known.join(out.select("source", "mapping"), "source").mapInArrow(_redacted(style), _NATIVE)


def native_stats(native: DataFrame) -> DataFrame:
    """``match_stats`` of the files that ``native_documents`` made, and the surfaces that weren't found in them."""
    flat = native.where("error IS NULL").select(F.col("source").alias("document"), F.explode("stats").alias("x")).select("document", "x.surface", "x.n")
    missed = flat.where("n = 0").groupBy("document").agg(F.sort_array(F.collect_list("surface")).alias("missing"))
    return match_stats(flat).join(missed, "document", "left")


def match_stats(hits: DataFrame) -> DataFrame:
    """From (document, surface, n): surfaces found and missed, replacements, and the rate found (1 if none was asked for)."""
    total, found = F.count("*"), F.count_if(F.col("n") > 0)
    return hits.groupBy("document").agg(total.alias("total"), found.alias("found"), (total - found).alias("missed"), F.sum("n").alias("hit_count"), F.when(total == 0, 1.0).otherwise(found / total).alias("match_rate"))
