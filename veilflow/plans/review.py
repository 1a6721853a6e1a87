"""Reviews as a table of findings: one row for each document and placeholder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import rewriting as W

FINDING = "placeholder string, original string, entity_type string, enabled boolean, source string, occurrences int"


def findings(docs: DataFrame, id_col: str = "doc_id", hits: str = "hits") -> DataFrame:
    """Findings of anonymized documents: the first surface of each placeholder and how often it was hit."""
    h = docs.select(id_col, F.explode(hits).alias("h")).select(id_col, "h.*")
    return h.groupBy(id_col, "placeholder").agg(F.min_by("surface", "start").alias("original"), F.min_by("entity_type", "start").alias("entity_type"), F.lit(True).alias("enabled"), F.lit("auto").alias("source"), F.count("*").cast("int").alias("occurrences"))


def occurrences(text: Column, needle: Column) -> Column:
    """How often ``needle`` stands in ``text``, without overlaps."""
    return F.when(F.length(needle) > 0, ((F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.length(needle)).cast("int")).otherwise(0)


def set_enabled(table: DataFrame, changes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Findings with the flags of ``changes`` (id, placeholder, enabled) where it has one."""
    own = changes.select(id_col, "placeholder", F.col("enabled").alias("_new"))
    return table.join(own, [id_col, "placeholder"], "left").withColumn("enabled", F.coalesce("_new", "enabled")).drop("_new")


def reject(table: DataFrame, typed: str) -> DataFrame:
    """Findings switched off by a list such as ``org_1, [PHONE_2]``; unknown names have no effect."""
    names = F.transform(F.split(F.lit(typed), r"[\s,;]+"), lambda x: S.placeholder(x))
    return table.withColumn("enabled", F.col("enabled") & ~F.coalesce(F.array_contains(F.filter(names, lambda x: x.isNotNull()), F.col("placeholder")), F.lit(False)))


def parse_rejects(typed: Column, valid: Column) -> Column:
    """Struct (known, unknown) of the names in a typed list."""
    parts = F.array_distinct(F.filter(F.split(F.trim(typed), r"[\s,;]+"), lambda x: x != ""))
    names = F.transform(parts, lambda x: F.coalesce(S.placeholder(x), x))
    return F.struct(F.array_distinct(F.filter(names, lambda x: F.array_contains(valid, x))).alias("known"), F.array_distinct(F.filter(names, lambda x: ~F.array_contains(valid, x))).alias("unknown"))


def add(table: DataFrame, new: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Findings with those of ``new`` (id, original, entity_type, label). One that is there already (same label
    and normal form) is switched on again; others get the next free number of their label."""
    norm, label = S.entity_norm(F.col("original")), S.placeholder_label(F.col("placeholder"))
    fresh = new.withColumn("_norm", norm).dropDuplicates([id_col, "label", "_norm"])
    keyed = table.withColumn("_norm", norm).withColumn("_label", label)
    known = fresh.select(id_col, F.col("label").alias("_label"), "_norm", F.lit(True).alias("_on"))
    kept = keyed.join(known, [id_col, "_label", "_norm"], "left").withColumn("enabled", F.col("enabled") | F.coalesce("_on", F.lit(False)))
    missing = fresh.join(keyed.select(id_col, F.col("_label").alias("label"), "_norm"), [id_col, "label", "_norm"], "left_anti")
    used = keyed.groupBy(id_col, F.col("_label").alias("label")).agg(F.collect_set(F.regexp_extract("placeholder", "_([0-9]+)\\]$", 1).cast("int")).alias("_used"))
    rank = Window.partitionBy(id_col, "label").orderBy("_norm")
    free = missing.join(used, [id_col, "label"], "left").withColumn("_r", F.row_number().over(rank))
    holes = F.array_except(F.sequence(F.lit(1), F.size(F.coalesce("_used", F.array().cast("array<int>"))) + F.col("_r")), F.coalesce("_used", F.array().cast("array<int>")))
    rows = free.select(id_col, F.concat(F.lit("["), "label", F.lit("_"), F.element_at(holes, F.col("_r")).cast("string"), F.lit("]")).alias("placeholder"), "original", "entity_type", F.lit(True).alias("enabled"), F.lit("user").alias("source"), F.lit(0).alias("occurrences"))
    return kept.select(*table.columns).unionByName(rows.select(*table.columns))


def summary(table: DataFrame) -> DataFrame:
    return table.agg(F.count_if("enabled").alias("redact"), F.count_if(~F.col("enabled")).alias("keep_clear"), F.count_if(F.col("source") == "user").alias("user_added"), F.count("*").alias("total"))


def apply(docs: DataFrame, table: DataFrame, id_col: str = "doc_id", style: str = "placeholder") -> DataFrame:
    """Documents rewritten by the findings that are on, by span: other spellings of an entity go with it, and
    nothing inside other words changes. What users added is replaced wherever it stands."""
    on = table.where("enabled").groupBy(id_col).agg(F.collect_set("placeholder").alias("_on"), F.collect_list(F.when(F.col("source") == "user", F.struct("placeholder", "original"))).alias("_user"))
    joined = docs.join(on, id_col, "left")
    own = F.filter(F.col("hits"), lambda h: F.coalesce(F.array_contains(F.col("_on"), h["placeholder"]), F.lit(False)))
    text = W.rewritten(F.col("clean_text"), own, style)
    user = F.coalesce("_user", F.array().cast("array<struct<placeholder:string,original:string>>"))
    done = joined.withColumn("anonymized_text", text).withColumn("_user", user)
    return done.withColumn("anonymized_text", W.apply_mapping(F.col("anonymized_text"), F.col("_user"), style)).drop("_on", "_user")


def teach(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(allow, deny) lists from a review: what was switched off, and what users added."""
    allow = table.where("NOT enabled").select(F.col("original").alias("text")).distinct()
    deny = table.where("enabled AND source = 'user'").select(F.col("original").alias("text"), "entity_type").distinct()
    return allow, deny


#: Fixed value: types by labels that differ from them.
TYPES = {"EMAIL": "EMAIL_ADDRESS", "PHONE": "PHONE_NUMBER", "IBAN": "IBAN_CODE", "IP": "IP_ADDRESS", "POSTAL": "FI_POSTAL_CODE", "PLATE_FI": "FI_LICENSE_PLATE", "VAT_FI": "FI_VAT", "VIN": "VEHICLE_VIN"}


def recount(docs: DataFrame, id_col: str = "doc_id", text_col: str = "anonymized_text") -> DataFrame:
    """(id, entity_type, n): how many different placeholders of each type are left in a text."""
    tags = F.array_distinct(F.regexp_extract_all(F.col(text_col), F.lit(r"(\[[A-Z][A-Z0-9_]*_[0-9]+\])"), F.lit(1)))
    left = docs.select(id_col, F.explode(tags).alias("tag")).withColumn("label", S.placeholder_label(F.col("tag")))
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair]), F.col("label")), F.col("label"))
    return left.groupBy(id_col, kind.alias("entity_type")).agg(F.count("*").alias("n"))


def sorted_placeholders(tags: Column) -> Column:
    """An array of placeholders by label, then by number."""
    keyed = F.transform(tags, lambda t: F.struct(F.regexp_extract(t, r"^\[?(.*?)(?:_[0-9]+)?\]?$", 1), F.coalesce(F.regexp_extract(t, r"_([0-9]+)\]?$", 1).try_cast("int"), F.lit(0)), t.alias("tag")))
    return F.transform(F.array_sort(keyed), lambda k: k["tag"])


def resolved_surface(text: Column, typed: Column) -> Column:
    """What a user marked, as it stands in the text: without the white space around it, or collapsed; null if neither does."""
    bare = F.regexp_replace(typed, r"(?U)^\s+|\s+$", "")
    flat = S.collapse(typed)
    return F.when((bare != "") & text.contains(bare), bare).when((flat != "") & text.contains(flat), flat)
