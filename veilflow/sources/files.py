"""Documents from files: text and Markdown natively, DOCX and PDF by Arrow batches over file contents.

A PDF's text layer comes page by page; where it is too thin, a hook may make one by character recognition.
Lines are reflowed, broken e-mails repaired and running headers dropped, all by column expressions."""

from __future__ import annotations

import io
import re
import shutil
import subprocess
import zipfile
from pathlib import Path
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks as B

SUFFIXES = (".pdf", ".docx", ".txt", ".md", ".markdown", ".text")  # fixed value
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
BLOCKS = "array<struct<kind:string,level:int,text:string>>"


def collect_inputs(path: str | Path) -> list[Path]:
    """Supported files of a folder, sorted, without symbolic links or anything that leads out of it; or the file itself."""
    root = Path(path).expanduser()
    if root.is_file():
        if root.suffix.lower() not in SUFFIXES:
            raise ValueError(f"{root}: supported are {', '.join(SUFFIXES)}")
        return [root]
    if not root.is_dir():
        near = sorted(p.name for p in root.parent.iterdir() if p.suffix.lower() in SUFFIXES)[:5] if root.parent.is_dir() else []
        raise FileNotFoundError(f"{root} is not there" + (f"; near it: {', '.join(near)}" if near else ""))
    real = root.resolve()
    found = sorted(p for p in root.rglob("*") if p.is_file() and not p.is_symlink() and p.suffix.lower() in SUFFIXES and p.resolve().is_relative_to(real))
    if not found:
        raise FileNotFoundError(f"{root} holds no supported files")
    return found


def decode(content: Column) -> Column:
    """Bytes as UTF-8 where they are valid, else as Latin-1."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.decode(content, "ISO-8859-1"))


def text_blocks(text: Column) -> Column:
    """Blocks of a text; one that has none but is not blank is a paragraph of its own."""
    own = B.blocks(F.replace(text, F.lit("\r\n"), F.lit("\n")))
    whole = F.array(F.struct(F.lit("paragraph").alias("kind"), F.lit(None).cast("int").alias("level"), F.trim(text).alias("text")))
    return F.when((F.size(own) == 0) & (F.trim(text) != ""), whole).otherwise(own).cast(BLOCKS)


def docx_blocks(content: bytes) -> list[dict]:
    """Paragraphs and table rows of a DOCX body, in order; neighbouring equal cells (merged ones) count once."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{_W}body")

    def words(node) -> str:
        return "".join(t.text or "" if t.tag == f"{_W}t" else "\t" if t.tag == f"{_W}tab" else "\n" for t in node.iter() if t.tag in (f"{_W}t", f"{_W}tab", f"{_W}br"))

    out = []
    for node in body if body is not None else ():
        if node.tag == f"{_W}p":
            style = node.find(f"{_W}pPr/{_W}pStyle")
            name = (style.get(f"{_W}val") or "").lower() if style is not None else ""
            text = words(node).strip()
            if not text:
                continue
            head = re.match(r"(?:heading|otsikko)\s*(\d?)", name)
            outline = node.find(f"{_W}pPr/{_W}outlineLvl")
            level = int(head[1] or 1) if head else int(outline.get(f"{_W}val") or 9) + 1 if outline is not None else 0
            head = 0 < level <= 9  # level 9 of an outline is body text
            kind = "heading" if head else "list_item" if "list" in name else "paragraph"
            out.append({"kind": kind, "level": min(level, 6) if head else None, "text": text})
        elif node.tag == f"{_W}tbl":
            for row in node.iter(f"{_W}tr"):
                cells = [words(c).strip() for c in row.findall(f"{_W}tc")]
                cells = [c for i, c in enumerate(cells) if c and (not i or c != cells[i - 1])]
                if cells:
                    out.append({"kind": "table_cell", "level": None, "text": " | ".join(cells)})
    return out


def pdf_blocks(content: bytes) -> list[dict]:
    """Text blocks of a PDF with their pages, by PyMuPDF where it is installed. Lines stay apart."""
    try:
        import pymupdf
    except ImportError as e:
        raise RuntimeError("reading PDF files needs PyMuPDF") from e
    out = []
    for number, page in enumerate(pymupdf.open(stream=content, filetype="pdf"), 1):
        out += [{"kind": "paragraph", "level": None, "text": b[4].strip(), "page": number} for b in page.get_text("blocks") if b[4].strip()]
    return out


def recognized(content: bytes, languages: str = "eng+fin") -> bytes:
    """A PDF with a text layer made by ``ocrmypdf``, where that is installed."""
    if not shutil.which("ocrmypdf"):
        raise RuntimeError("character recognition needs ocrmypdf")
    done = subprocess.run(["ocrmypdf", "--force-ocr", "-l", languages, "-", "-"], input=content, capture_output=True, timeout=1800)
    if done.returncode:
        raise RuntimeError(done.stderr.decode("utf-8", "replace")[-500:])
    return done.stdout


def pdf_document(content: bytes, extract=pdf_blocks, ocr=recognized, force_ocr: bool = False, no_ocr: bool = False) -> tuple[list[dict], bool]:
    """(blocks, was recognition used) of a PDF. It is used if asked for, or if the text layer is thinner than 40
    characters a page; if it fails, the text layer stands unless recognition was asked for."""
    blocks = extract(content)
    pages = max((b["page"] for b in blocks), default=0)
    thin = pages <= 0 or sum(len(b["text"]) for b in blocks) / pages < 40
    if no_ocr or not (force_ocr or thin):
        return blocks, False
    try:
        return extract(ocr(content)), True
    except RuntimeError:
        if force_ocr:
            raise
        return blocks, False


def _binary(**how):
    def run(batches):
        for batch in batches:
            found, pages, used, errors = [], [], [], []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                own, ocr, error = [], False, None
                try:
                    own, ocr = (docx_blocks(content), False) if path.lower().endswith(".docx") else pdf_document(content, **how)
                except Exception as e:  # one bad file must not stop a folder
                    error = f"{type(e).__name__}: {e}"
                found.append([{k: b[k] for k in ("kind", "level", "text")} for b in own])
                pages.append([b.get("page") for b in own] if path.lower().endswith(".pdf") else None)
                used.append(ocr)
                errors.append(error)
            kind = pa.list_(pa.struct([("kind", pa.string()), ("level", pa.int32()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(found, kind), pa.array(pages, pa.list_(pa.int32())), pa.array(used, pa.bool_()), pa.array(errors, pa.string())], ["source", "blocks", "pages", "used_ocr", "error"])

    return run


def without_headers(docs: DataFrame) -> DataFrame:
    """PDF documents (with ``pages``) without running headers: blocks are rows for that, and come back in order."""
    flat = docs.select("source", F.posexplode(F.arrays_zip("blocks", "pages")).alias("pos", "z")).select("source", "pos", F.col("z.blocks").alias("b"), F.col("z.pages").alias("page"))
    flat = flat.withColumn("text", F.col("b.text"))
    kept = B.drop_running_headers(flat, "source").groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "b"))), lambda x: x["b"]).alias("_kept"))
    joined = docs.join(kept, "source", "left")
    return joined.withColumn("blocks", F.coalesce("_kept", F.array()).cast(BLOCKS)).select(*docs.columns)


#: Paths of a list that a join broadcasts.
FEW = 10_000


def read_documents(spark: SparkSession, path: str, inputs: list[Path] | None = None, keep_headers: bool = False, **pdf) -> DataFrame:
    """(source, blocks, used_ocr, error) of the supported files under ``path``, or of those of ``inputs`` only, as
    ``collect_inputs`` lists them. Files that can't be read have an error. ``pdf``: how ``pdf_document`` reads."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    if inputs is not None:
        own = spark.createDataFrame([(f"file:{p.absolute()}",) for p in inputs], "path string")
        files = files.join(F.broadcast(own) if len(inputs) <= FEW else own, "path", "left_semi")
    low = F.lower("path")
    nothing = F.lit(None).cast("string").alias("error")
    plain = files.where(low.rlike(r"\.(txt|md|markdown|text)$")).select(F.col("path").alias("source"), text_blocks(decode(F.col("content"))).alias("blocks"), F.lit(False).alias("used_ocr"), nothing)
    packed = files.where(low.rlike(r"\.(docx|pdf)$")).mapInArrow(_binary(**pdf), f"source string, blocks {BLOCKS}, pages array<int>, used_ocr boolean, error string")
    pages = packed.where("pages IS NOT NULL")
    flowing = lambda b: F.struct(b["kind"].alias("kind"), b["level"].alias("level"), B.repair(B.reflow(F.split(b["text"], "\n"))).alias("text"))
    pages = pages.withColumn("blocks", F.transform("blocks", flowing))
    pages = pages if keep_headers else without_headers(pages)
    return plain.unionByName(packed.where("pages IS NULL").drop("pages")).unionByName(pages.drop("pages"))
