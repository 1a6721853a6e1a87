import pytest


@pytest.fixture
def docs(spark):
    def make(rows, extra=False):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        if extra:  # clashing names of columns that operators use themselves
            from pyspark.sql import functions as F

            df = df.select("*", *[F.lit(1).alias(c) for c in ("fp", "th", "u", "v", "part", "size", "h", "_id", "score", "piece")])
        return df

    return make


#: Nulls, empty texts, repeated rows, a null id, ties and a long text.
EDGE = [(1, None), (2, ""), (3, "The end"), (3, "The end"), (None, "the  END "), (4, "x " * 30_000), (5, "A b c\nD e f\n\nA b c")]
