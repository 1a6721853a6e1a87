"""A corpus pipeline of five stages; each takes the documents that the one before it kept.

A stage is a function of (spark, docs, sf_dir). All but the last return the columns of documents, so any
of them can be left out or run alone. Nulls, empty texts, repeated rows and empty tables are dealt with
as the operators state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilflow.llm import linededup, mixing, packing, quality, simhash
from veilflow.llm.common import cut
from veilflow.llm.queries import byte_bpe

ORACLE_SQL = None  # the stages hold models, tokens and searches that SQL can't express


def _aside(docs: DataFrame, *names: str) -> DataFrame:
    """``docs`` with its own columns of these names, which an operator uses too, under other ones."""
    return docs.withColumnsRenamed({c: f"__own_{c}" for c in names if c in docs.columns})


def _back(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col(f"`__own_{c}`" if f"__own_{c}" in rows.columns else f"`{c}`").alias(c) for c in columns])


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the rule ensemble holds for low quality (score under 0.5). Labels are
    learned as in the query of its own: rows with crc32(doc_id) mod 3 = 1 are held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    scored = quality.classify(_aside(docs, "held_out", "score", "predicted"), labels)
    return _back(scored.where("predicted = 1"), docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out lines that ten documents or more hold; n_chars is counted again."""
    return _back(linededup.rewrite(_aside(docs, "__gone", "__line_id", "__line_th"), min_documents=10, min_chars=1), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave one document of each group of near copies, the one with the smallest id. Linked are texts with a
    5-word shingle similarity of 0.8 or more, and those that the operator's own query links: 3-word
    shingles, at most three differing bits."""
    return _back(simhash.keep_one(_aside(docs, "__kept", "__fp", "__of"), width=3, similarity=0.8), docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as the mix of its source asks: none to three times, as rows."""
    own = _aside(docs, "copies", "_copy")
    copies = mixing.mix(own, weights=(5, 2, 1), most=3, carry=tuple(own.columns))
    return _back(copies.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2048 tokens."""
    return packing.pack_documents(docs, byte_bpe(), capacity=2048, end_id=0)


STAGES = [("quality_filter", quality_filter), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix", mix), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, from the table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs
