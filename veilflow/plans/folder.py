"""One map for a folder: documents of a group share numbers, and what is known from one of them is found in the others.

Entities of all documents of a group are one table, numbered by first appearance. Their surfaces are searched in every
document of the group by ``search_table``, whose join by hashed grams gives each document only what it may hold; so the
surfaces of a group can be any number."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.spans import SPANS, in_order, let, merge, sliced_spans
from ..operators import rewriting as W
from ..operators import search
from .config import Config
from .pipeline import analyze
from .tables import remove, written

#: Score of a surface that another document's detectors found: a document's own findings come before it.
KNOWN = 0.8


def _whole_words(text, spans):
    """Spans that no letter or digit touches, where their own end is one."""
    apart = lambda x, part: ~(part(x["start"] - 1, F.least(x["start"], F.lit(1))).rlike(r"[\p{L}\p{N}]") & x["surface"].rlike(r"^[\p{L}\p{N}]")) & ~(part(x["end"], 1).rlike(r"[\p{L}\p{N}]") & x["surface"].rlike(r"[\p{L}\p{N}]$"))
    return sliced_spans(text, spans, lambda xs, part: F.filter(xs, lambda x: apart(x, part)))


def anonymize_together(docs: DataFrame, cfg: Config = Config(), group: str = "folder", id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, names): ``docs`` with ``spans`` and ``anonymized_text``, and (group, label, norm, entity_type, number,
    placeholder, original) of every entity of a group.

    Numbers follow the order of ids, then of places. Surfaces of four characters or more are looked for in the other
    documents, as whole words, in any case; allowed ones are not. Ids must be unique; a null group is a group. The
    documents' spans, and the names, are tables in the shared folder."""
    own = written(analyze(docs, cfg, text_col).withColumn("__group", F.coalesce(F.col(f"`{group}`").cast("string"), F.lit("\x00"))))
    flat = own.select("__group", F.col(f"`{id_col}`").alias("id"), F.explode("spans").alias("x"))
    surfaces = flat.where(F.length(F.trim("x.surface")) >= search.JOIN_GRAM).select("__group", F.trim("x.surface").alias("surface"), "x.entity_type").distinct()
    found = search.search_table(own, surfaces, "clean_text", within="__group", into="__known", score=KNOWN)
    whole = found.withColumn("__known", _whole_words(F.col("clean_text"), F.col("__known")))
    settled = written(whole.withColumn("spans", merge(F.concat("spans", "__known"), cfg.registry.priority_column).cast(SPANS)).drop("__known"))
    remove(own)
    spans = settled.select("__group", F.col(f"`{id_col}`").alias("id"), F.explode("spans").alias("x"))
    keyed = spans.select("__group", "id", "x", cfg.registry.label_column(F.col("x.entity_type")).alias("label"), S.entity_norm(F.col("x.surface")).alias("norm"))
    firsts = keyed.groupBy("__group", "label", "norm").agg(F.min(F.struct("id", F.col("x.start").alias("at"), F.col("x.surface").alias("surface"), F.col("x.entity_type").alias("entity_type"))).alias("first"))
    number = F.row_number().over(Window.partitionBy("__group", "label").orderBy("first.id", "first.at"))
    tag = F.concat(F.lit("["), F.col("label"), F.lit("_"), F.col("number").cast("string"), F.lit("]"))
    names = written(firsts.withColumn("number", number).select("__group", "label", "norm", F.col("first.entity_type").alias("entity_type"), "number", tag.alias("placeholder"), F.col("first.surface").alias("original")))
    hits = keyed.join(names.select("__group", "label", "norm", "placeholder"), ["__group", "label", "norm"]).groupBy("id").agg(F.collect_list(F.struct("x.start", "x.end", "placeholder")).alias("__hits"))
    joined = settled.join(hits.withColumnRenamed("id", "__id"), F.col(f"`{id_col}`") == F.col("__id"), "left").drop("__id")
    ordered = F.coalesce(F.sort_array("__hits"), F.array().cast("array<struct<start:int,end:int,placeholder:string>>"))
    text = let(ordered, lambda hs: W.rewritten(F.col("clean_text"), hs, cfg.redact_style))
    out = joined.withColumn("spans", in_order(F.col("spans"))).withColumn("anonymized_text", text)
    return out.drop("__hits", "__group"), names.withColumn(group, F.when(F.col("__group") != "\x00", F.col("__group"))).drop("__group")
