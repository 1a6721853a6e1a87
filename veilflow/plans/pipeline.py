"""The document pipeline as one narrow stage: text -> spans -> rewritten text, map and counts.

Every step adds expressions to the row of its document. Nothing shuffles; recognizers that the wanted
types don't need never enter the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import SPANS, collecting, merge, none, pattern_spans
from ..operators import blocks as B
from ..operators import filters as X
from ..operators import language as L
from ..operators import rewriting as W
from ..operators.recognizers import BUILTIN, Recognizer, deny_spans, with_mentions
from .config import Config

DATE = r"\b(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4})\b"


def dates(text: Column) -> Column:
    return pattern_spans(text, DATE, "DATE_TIME", 0.6)


ALL = (*BUILTIN, Recognizer("dates", ("DATE_TIME",), dates))


def raw_spans(text: Column, cfg: Config) -> Column:
    """What the recognizers of the wanted types find, in their order, and the deny list."""
    wanted = set(cfg.effective_entities())
    out = []
    for r in (*ALL, *cfg.plugins):
        if not wanted & set(r.types):
            continue
        found = r.spans(text)
        if len(r.types) > 1 and not wanted >= set(r.types):
            found = F.filter(found, lambda x: x["entity_type"].isin(*wanted))
        if r.from_patterns:
            found = F.filter(found, lambda x: (x["score"] >= cfg.score_threshold) | ((x["entity_type"] == "PHONE_NUMBER") & (x["score"] >= 0.4)))
        out.append(found)
    out.append(deny_spans(text, list(cfg.deny)) if cfg.deny else none())
    return F.concat(*out)


def analyze(docs: DataFrame, cfg: Config = Config(), text_col: str = "text") -> DataFrame:
    """``docs`` with ``clean_text`` (repaired), ``language`` and ``spans``.

    The order is part of the result: detect, deny, resolve overlaps, drop labels, false positives and
    noise, then other mentions of companies (resolved and filtered again), the allow list last. Null texts are
    empty. In extract mode nothing is detected."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.withColumn("clean_text", (B.repair(text))).withColumn("language", L.detect(F.col("clean_text")))
    if cfg.languages:
        out = out.withColumn("language", F.struct(F.array(*[F.lit(c) for c in cfg.languages]).alias("languages"), F.lit("forced").alias("reason")))
    wanted = cfg.effective_entities()
    if not wanted:
        return out.withColumn("spans", none())
    out = detected(out, cfg)
    if "ORG" in wanted:
        # most documents name no company by its legal form, and are spared the second pass
        out = settled(with_mentions(out, "clean_text", "spans", "_stems", cfg.lexicon), "_stems", cfg)
    return out.withColumn("spans", X.drop_allowed(F.col("spans"), list(cfg.allow)).cast(SPANS))


def detected(docs: DataFrame, cfg: Config) -> DataFrame:
    """``docs`` with ``spans`` of ``clean_text``: detect, deny, resolve overlaps, drop labels, false positives and noise."""
    t = F.col("clean_text")
    with collecting("_found") as finder:
        raw = raw_spans(t, cfg)
    out = docs.withColumn("_found", finder.column()).withColumn("spans", merge(raw, cfg.registry.priority_column)).drop("_found")
    return out.withColumn("spans", X.drop_noisy(t, X.drop_false_positives(t, X.drop_field_labels(t, F.col("spans")), cfg.lexicon)))


def settled(docs: DataFrame, more: str, cfg: Config) -> DataFrame:
    """``spans`` with those of the column ``more``, resolved and filtered again where there are any."""
    again = X.drop_false_positives(F.col("clean_text"), merge(F.concat("spans", more), cfg.registry.priority_column), cfg.lexicon)
    return docs.withColumn("spans", F.when(F.size(more) > 0, again).otherwise(F.col("spans"))).drop(more)


def anonymize(docs: DataFrame, cfg: Config = Config(), text_col: str = "text") -> DataFrame:
    """``analyze`` and then ``hits`` (numbered spans), ``anonymized_text`` and ``mapping``."""
    out = analyze(docs, cfg, text_col).withColumn("hits", (W.numbered(F.col("spans"), cfg.registry)))
    return out.withColumn("anonymized_text", W.rewritten(F.col("clean_text"), F.col("hits"), cfg.redact_style)).withColumn("mapping", W.mapping(F.col("hits")))


def anonymize_blocks(docs: DataFrame, cfg: Config = Config(), blocks_col: str = "blocks") -> DataFrame:
    """Blocks (structs with ``text``) anonymized with one map a document: detection sees the joined text, and
    spans are cut to blocks. Adds ``anonymized_blocks``."""
    texts = F.transform(F.col(blocks_col), lambda b: B.repair(b["text"]))
    out = docs.withColumn("_texts", texts).withColumn("_joined", B.joined(F.col("_texts")))
    out = anonymize(out, cfg, "_joined").withColumn("_ranges", B.block_ranges(F.col("_texts")))

    def block(b: Column, i: Column) -> Column:
        own, text = F.get(F.col("_ranges"), i), F.get(F.col("_texts"), i)
        first, last = own["first"], own["last"]
        inside = F.filter(F.col("hits"), lambda h: (h["start"] < last) & (h["end"] > first))
        local = F.transform(inside, lambda h: F.struct(F.greatest(h["start"] - first, F.lit(0)).alias("start"), (F.least(h["end"], last) - first).alias("end"), h["placeholder"].alias("placeholder")))
        return F.struct(b["kind"].alias("kind"), b["level"].alias("level"), W.rewritten(text, local, cfg.redact_style).alias("text"))

    return out.withColumn("anonymized_blocks", F.transform(F.col(blocks_col), block)).drop("_texts", "_joined", "_ranges")


def spread(docs: DataFrame) -> DataFrame:
    """``docs`` over all cores if it came in few partitions, as small files do: their rows may all lie in one. Large
    inputs stay as they are."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= 8 * cores else docs.repartition(4 * cores)
