"""Text preparation: blocks, repair of broken e-mails, line reflow, running headers, Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S

# --- fixed values: patterns -----------------------------------------------------------------------
BREAKS = (
    (r"([A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z])(?:\n|[ \t])([a-z]{1,3})\b"),
    (r"([A-Za-z0-9._%+\-]+@)\n([A-Za-z0-9.\-]+\.[A-Za-z]{2,24})\b"),
    (r"([A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]{1,60})\n([a-z0-9.\-]*\.[A-Za-z]{2,24})\b"),
    (r"([A-Za-z0-9._%+\-]{2,64})\n(@[A-Za-z0-9.\-]+\.[A-Za-z]{2,24})\b"),
)
PAGE_MARK, DOC_STAMP = r"^[0-9]+\s*\([0-9]+\)$", r"(?i)^doc\s+[0-9]+"
HEAD_LEGAL = r"(?iu)\b(oyj|oy|abp|ab|ltd|limited|inc|corp|llc|gmbh|plc)\b"
HEAD_STREET = r"(?iu)(katu|tie|kuja|road|street|raitti|väylä)\b"
FIELD = r"(?iu)^\s*(sopimusnumero|luottopäätösnumero|luottopaatosnumero|y-tunnus|alv-numero|alv\s*numero|puh\.?|puhelin|phone|tel\.?)\b"
ONLY_URLS, ONLY_PHONE = r"(?i)^(?:\s*(?:https?://|www\.)\S+\s*)+$", r"(?i)^(?:puh\.?|puhelin|phone|tel\.?)?\s*[:：]?\s*[0-9\s\-./()+]+\s*$"
# ---------------------------------------------------------------------------------------------------


def repair(text: Column) -> Column:
    """Rejoin e-mail addresses that line ends broke, in up to four rounds; texts on one line stay as they are."""
    return F.when(text.contains("\n") & text.contains("@"), rejoined(text)).otherwise(text)


def rejoined(text: Column) -> Column:
    for _ in range(4):
        for pattern in BREAKS:
            text = F.regexp_replace(text, pattern, "$1$2")
    return text


def blocks(text: Column) -> Column:
    """Paragraphs between blank lines as structs (kind, level, text): headings, list items, paragraphs."""
    parts = F.filter(F.transform(F.split(text, "\n\n", -1), lambda p: F.regexp_replace(p, r"^\n+|\n+$", "")), lambda p: S.collapse(p) != "")

    def block(p: Column) -> Column:
        bare = F.regexp_replace(p, r"(?U)^\s+", "")
        marks = F.length(F.regexp_extract(bare, "^#+", 0))
        item = bare.rlike(r"^(?:[-*+] |[0-9][.)] )")
        return F.struct(
            F.when(marks > 0, "heading").when(item, "list_item").otherwise("paragraph").alias("kind"),
            F.when(marks > 0, F.least(marks, F.lit(6))).cast("int").alias("level"),
            F.when(marks > 0, F.regexp_replace(F.regexp_replace(bare, "^#+", ""), r"(?U)^\s+|\s+$", "")).otherwise(p).alias("text"),
        )

    return F.transform(parts, block)


def joined(texts: Column) -> Column:
    return F.array_join(texts, "\n\n")


def block_ranges(texts: Column) -> Column:
    """(first, last) of each block in the joined text."""
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<first:int,last:int>>").alias("out"))

    def add(acc: Column, t: Column) -> Column:
        end = acc["at"] + F.length(t)
        return F.struct((end + 2).cast("int").alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].cast("int").alias("first"), end.cast("int").alias("last")))).alias("out"))

    return F.aggregate(texts, empty, add)["out"]


def _caps_share(s: Column, least: int, share: float) -> Column:
    letters = F.length(F.regexp_replace(s, r"[^\p{L}]", ""))
    return (letters >= least) & (F.length(F.regexp_replace(s, r"[^\p{Lu}]", "")) >= letters * share)


def section_header(line: Column) -> Column:
    s = F.trim(line)
    return (s != "") & (F.length(s) <= 50) & _caps_share(s, 2, 0.85)


def label_line(line: Column) -> Column:
    s = F.trim(line)
    words = F.size(F.split(s, r"\s+"))
    small = s.rlike(r"^\p{Ll}")
    slash = s.endswith("/") & (F.length(s) < 80) & (words <= 12)
    return (s != "") & ~small & (slash | (s.rlike("[:：]$") & (F.length(s) <= 55) & (words <= 6)))


def reflow(lines: Column) -> Column:
    """Visual lines as text: labels and headers keep their line ends, hyphens join, other lines flow on."""
    clean = F.filter(F.transform(F.coalesce(lines, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    empty = F.struct(F.lit("").alias("last"), F.lit("").alias("out"))

    def add(acc: Column, nxt: Column) -> Column:
        stay = label_line(acc["last"]) | section_header(acc["last"]) | label_line(nxt) | (section_header(nxt) & (F.length(nxt) <= 40))
        glue = ~stay & acc["last"].endswith("-") & nxt.rlike(r"^\p{L}")
        gap = F.when(acc["out"] == "", "").when(stay, "\n").when(glue, "").otherwise(" ")
        return F.struct(F.when(glue, F.concat(acc["last"], nxt)).otherwise(nxt).alias("last"), F.concat(acc["out"], gap, nxt).alias("out"))

    return F.aggregate(clean, empty, add)["out"]


def thin_text(pages: Column, chars: Column) -> Column:
    """Too little text a page to be a text layer."""
    return (pages <= 0) | (chars / F.greatest(pages, F.lit(1)) < 40)


def page_chrome(text: Column) -> Column:
    t = F.trim(text)
    n = F.length(t)
    letterhead = n.between(20, 200) & t.rlike(HEAD_LEGAL) & (t.rlike("[0-9]{5}") | t.rlike(r"(?i)https?://|www\.") | t.rlike(HEAD_STREET))
    field = t.rlike(FIELD) & (n <= 180) & ~t.rlike(r"[.!].{40,}")
    ids = t.rlike("(?i)y-tunnus") & t.rlike("(?i)alv") & (n < 120)
    return (t != "") & (n <= 220) & (t.rlike(PAGE_MARK) | t.rlike(DOC_STAMP) | letterhead | field | t.rlike(ONLY_URLS) | (t.rlike(ONLY_PHONE) & (n < 40)) | ids)


def drop_running_headers(table: DataFrame, doc: str = "doc_id", pos: str = "pos", page: str = "page", text: str = "text") -> DataFrame:
    """Without page marks, stamps, repeated chrome and short texts that stand on three pages or more.

    One row a block. Counts are partial aggregates by document and normal form; what goes is a small table
    that is joined back. Blocks without a page count as pages of their own."""
    rows = table.withColumn("_norm", S.entity_norm(F.col(text)))
    stats = rows.where("_norm <> ''").groupBy(doc, "_norm").agg(
        F.count("*").alias("_c"), F.countDistinct(page).alias("_p"), F.count_if(F.col(page).isNull()).alias("_n"), F.min_by(F.col(text), F.col(pos)).alias("_sample")
    )
    pages = F.col("_p") + F.col("_n")
    sample = F.col("_sample")
    mark = F.trim(sample).rlike(PAGE_MARK) | F.trim(sample).rlike(DOC_STAMP)
    gone = mark | (page_chrome(sample) & ((pages >= 2) | (F.col("_c") >= 2))) | ((pages >= 3) & (F.length(sample) <= 200))
    left = rows.join(stats.where(gone).select(doc, "_norm"), [doc, "_norm"], "left_anti")
    own = F.trim(F.col(text))
    return left.where(~own.rlike(PAGE_MARK) & ~own.rlike(DOC_STAMP)).select(*table.columns)


def markdown_block(kind: Column, level: Column, text: Column) -> Column:
    t = F.regexp_replace(text, r"(?U)\s+$", "")
    marked = F.regexp_replace(t, r"(?U)^\s+", "").rlike(r"^(?:[-*+] |[0-9][.)] )")
    return F.when(kind == "heading", F.concat(F.repeat(F.lit("#"), F.coalesce(level, F.lit(1))), F.lit(" "), t)).when((kind == "list_item") & ~marked, F.concat(F.lit("- "), t)).otherwise(t)


def markdown(blocks_: Column) -> Column:
    """The body of a Markdown file from block structs."""
    full = F.filter(blocks_, lambda b: S.collapse(b["text"]) != "")
    return F.array_join(F.transform(full, lambda b: markdown_block(b["kind"], b["level"], b["text"])), "\n\n")


def front_matter(fields: dict[str, Column]) -> Column:
    """YAML front matter with sorted keys; values are JSON, which YAML reads."""
    lines = [F.concat(F.lit(f"{k}: "), F.coalesce(v, F.lit("null"))) for k, v in sorted(fields.items())]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n\n"))
