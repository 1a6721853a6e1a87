"""Tables that a plan writes to the folder that driver and executors share, so that later steps start from there."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` names it. On one machine a temporary folder stands in where it is unset; on a cluster
    that is an error."""
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not known:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        known = sc.getCheckpointDir()
    return known.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table of Parquet files: lineage ends here, and a lost executor costs its own tasks only."""
    path = f"{shared_folder(df.sparkSession)}/plans/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Remove a table that ``written`` made and that nothing reads any more."""
    sc = df.sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/plans/" in folder:
            path = sc._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
