"""The pipeline over documents of any length: a text is cut into chunks with a halo on both sides, so that one huge
document is many rows for many cores.

What detectors, overlaps and filters look at lies near a span, so each chunk settles its own spans: those that begin in
it, seen with HALO characters before and after it. What concerns a whole document is joined by its id: stems of
companies go to all of its chunks, entities are numbered by first appearance with a window over entities (not spans), and a span
that runs over the end of its chunk is taken off the next one. No text is shuffled but the chunks that a join with stems moves."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.spans import SPANS
from ..operators import blocks as B
from ..operators import filters as X
from ..operators import recognizers as R
from ..operators import rewriting as W
from .config import Config
from .pipeline import detected, settled
from .tables import written

#: Characters of a chunk, about, and of the halo: no span, and nothing that a filter looks at, may be longer.
SIZE, HALO = 1 << 17, 1 << 12
_CHUNK = "chunk int, left string, own string, right string, broken boolean"


def cuts(text: str, size: int) -> list[int]:
    """Where the chunks of a text begin, and its end: after white space that isn't next to a word with ``@``, which
    repairs might join across it. Where a stretch of ``size`` has no such place it is cut where it must be."""
    out, at = [0], 0
    while len(text) - at > size:
        end = at + size
        for k in range(end, at + size // 2, -1):
            if text[k - 1].isspace() and not text[k].isspace():
                before, after = text[max(k - 330, at) : k].split(), text[k : k + 330].split(None, 1)
                if not (before and "@" in before[-1]) and not (after and "@" in after[0]):
                    end = k
                    break
        out.append(end)
        at = end
    return [*out, len(text)]


def _cutter(id_type: pa.DataType, size: int, halo: int):
    def run(batches):
        for batch in batches:
            for i, text in zip(batch.column("id"), batch.column("text").to_pylist()):
                text = text or ""
                places = cuts(text, size)
                broken = "\n" in text and "@" in text
                for k, (a, b) in enumerate(zip(places, places[1:])):
                    row = [i.as_py()], [k], [text[max(a - halo, 0) : a]], [text[a:b]], [text[b : b + halo]], [broken]
                    kinds = id_type, pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_()
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds)], ["id", "chunk", "left", "own", "right", "broken"])

    return run


def chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, halo: int = HALO) -> DataFrame:
    """(id, chunk, clean_text, first, last): each chunk's repaired text with its halo, and where its own part lies in it.

    An empty or null text is one empty chunk. Ids must be unique; rows are spread over all cores by id and chunk."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    made = rows.mapInArrow(_cutter(to_arrow_type(kind), size, halo), f"id {kind.simpleString()}, {_CHUNK}")
    cores = docs.sparkSession.sparkContext.defaultParallelism
    spread = made.repartition(max(4 * cores, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "id", "chunk")
    clean = {c: F.when(F.col("broken"), B.rejoined(F.col(c))).otherwise(F.col(c)) for c in ("left", "own", "right")}
    fixed = spread.withColumns(clean)
    first = F.length("left")
    return fixed.select("id", "chunk", F.concat("left", "own", "right").alias("clean_text"), first.alias("first"), (first + F.length("own")).alias("last"))


def _own(spans, first, last):
    return F.filter(spans, lambda x: (x["start"] >= first) & (x["start"] < last))


def analyze_chunks(docs: DataFrame, cfg: Config = Config(), id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, halo: int = HALO) -> DataFrame:
    """(id, chunk, clean_text, first, last, spans): the chunks of ``docs`` with the spans that begin in each, in the
    chunk's offsets. The result is that of ``analyze`` on the whole text for spans shorter than the halo. It is a
    table in the shared folder."""
    chunks = chunked(docs, id_col, text_col, size, halo)
    wanted = cfg.effective_entities()
    if not wanted:
        return chunks.withColumn("spans", F.array().cast(SPANS))
    out = written(detected(chunks, cfg))
    if "ORG" in wanted:
        names = out.select("id", _own(F.col("spans"), F.col("first"), F.col("last")).alias("spans")).withColumn("stems", R.stems(F.col("spans"), cfg.lexicon))
        stems = names.select("id", F.explode("stems").alias("s")).distinct().groupBy("id").agg(F.sort_array(F.collect_list("s")).alias("_names"))
        named = out.join(stems, "id", "left").withColumn("_names", F.coalesce("_names", F.array().cast("array<string>")))
        out = settled(named.withColumn("_stems", R.mentions(F.col("clean_text"), F.col("_names"), cfg.lexicon)).drop("_names"), "_stems", cfg)
    kept = X.drop_allowed(F.col("spans"), list(cfg.allow)).cast(SPANS)
    return written(out.withColumn("spans", _own(kept, F.col("first"), F.col("last"))))


def entities(chunks: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(id, label, norm, number, placeholder, original): what spans name, numbered by first appearance within a label. The
    window is over the entities of one label of a document, each one row."""
    spans = chunks.select("id", "chunk", F.explode("spans").alias("x"))
    rows = spans.select("id", F.struct("chunk", "x.start").alias("at"), "x.surface", cfg.registry.label_column(F.col("x.entity_type")).alias("label"), S.entity_norm(F.col("x.surface")).alias("norm"))
    firsts = rows.groupBy("id", "label", "norm").agg(F.min(F.struct("at", "surface")).alias("first"))
    number = F.row_number().over(Window.partitionBy("id", "label").orderBy("first.at"))
    named = firsts.withColumn("number", number)
    tag = F.concat(F.lit("["), F.col("label"), F.lit("_"), F.col("number").cast("string"), F.lit("]"))
    return named.select("id", "label", "norm", "number", tag.alias("placeholder"), F.col("first.surface").alias("original"))


def anonymize_chunks(docs: DataFrame, cfg: Config = Config(), id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, halo: int = HALO) -> tuple[DataFrame, DataFrame]:
    """((id, chunk, text), entities): rewritten chunks, whose texts in order are the rewritten document, and the map.

    Style and modes are those of ``anonymize``; ``remove`` closes gaps within chunks. Spans and entities are tables in
    the shared folder; the rewritten chunks are worked out from them when they are read."""
    chunks = analyze_chunks(docs, cfg, id_col, text_col, size, halo)
    names = written(entities(chunks, cfg))
    spans = chunks.select("id", "chunk", "last", F.explode("spans").alias("x"))
    keyed = spans.withColumn("label", cfg.registry.label_column(F.col("x.entity_type"))).withColumn("norm", S.entity_norm(F.col("x.surface")))
    hits = keyed.join(names.select("id", "label", "norm", "placeholder"), ["id", "label", "norm"])
    own = hits.groupBy("id", "chunk").agg(F.sort_array(F.collect_list(F.struct("x.start", "x.end", "placeholder"))).alias("_hits"), F.max(F.greatest(F.col("x.end") - F.col("last"), F.lit(0))).alias("_over"))
    over = own.where("_over > 0").select("id", (F.col("chunk") + 1).alias("chunk"), F.col("_over").alias("_skip"))
    joined = chunks.drop("spans").join(own.drop("_over"), ["id", "chunk"], "left").join(over, ["id", "chunk"], "left")
    none = F.array().cast("array<struct<start:int,end:int,placeholder:string>>")
    begin = F.col("first") + F.coalesce("_skip", F.lit(0))
    # the last span of a chunk may end beyond it: the text goes on to there, and the next chunk begins later
    ends = joined.withColumn("_hits", F.coalesce("_hits", none)).withColumn("_begin", begin).withColumn("_end", F.greatest("last", F.coalesce(F.array_max(F.transform("_hits", lambda h: h["end"])), F.lit(0))))
    local = ends.withColumn("_own", F.expr("substring(clean_text, _begin + 1, greatest(_end - _begin, 0))")).withColumn("_hits", F.transform("_hits", lambda h: F.struct((h["start"] - F.col("_begin")).alias("start"), (h["end"] - F.col("_begin")).alias("end"), h["placeholder"].alias("placeholder"))))
    return local.select("id", "chunk", W.rewritten(F.col("_own"), F.col("_hits"), cfg.redact_style).alias("text")), names


def whole(pieces: DataFrame) -> DataFrame:
    """(id, text): the pieces of each document put together."""
    return pieces.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "text"))), lambda p: p["text"]), "").alias("text"))
