"""The pipeline over a stream of documents. It is stateless - numbers are per document - so any trigger and
append output do; checkpoints of the sink alone make it exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.config import Config
from ..plans.pipeline import anonymize


def read_stream(spark: SparkSession, path: str, schema: str = "doc_id long, text string", files_per_trigger: int = 64) -> DataFrame:
    """New Parquet files of a folder as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def write_stream(docs: DataFrame, folder: str, checkpoint: str, cfg: Config = Config()) -> StreamingQuery:
    """Anonymized documents as Parquet, until the input there is now is worked off."""
    out = anonymize(docs, cfg).select("doc_id", "anonymized_text", "mapping")
    return out.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
