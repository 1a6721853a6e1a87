from pyspark.sql import functions as F

from veilflow.operators import external as E


def test_answers(spark):
    raw = 'Sure:\n```json\n[{"text": "acme oy", "type": "company"}, {"text": "Bob", "type": "name"}, {"text": "x", "type": "colour"}]\n```'
    df = spark.createDataFrame([("ACME Oy met Bob, then Bob left", raw), ("none", "no list"), ("none", None)], "t string, r string")
    rows = [r["x"] for r in df.select(E.answer_spans(F.col("t"), F.col("r"), ["ORG", "PERSON"]).alias("x")).collect()]
    assert sorted((s["entity_type"], s["start"], s["surface"]) for s in rows[0]) == [("ORG", 0, "ACME Oy"), ("PERSON", 12, "Bob"), ("PERSON", 22, "Bob")]
    assert rows[1] == [] and rows[2] == []


def test_model_output(spark):
    df = spark.createDataFrame([("Anna\nLives in Rome", [("PER", 0, 10), ("GPE", 14, 18), ("DATE", 0, 4)])], "t string, e array<struct<label:string,start:int,end:int>>")
    got = df.select(E.model_spans(F.col("e"), F.col("t")).alias("x")).first()["x"]
    assert [(s["entity_type"], s["surface"]) for s in got] == [("PERSON", "Anna"), ("LOCATION", "Rome")]
