import corpus_pipeline


def test_stages_follow_one_another(spark, tmp_path):
    good = [(i, f"The {i} small stones lay by river number {i * 7} and wind {i * 3} moved over tree {i * 11}.\nFoot of the page", "en", f"s{i % 3}", 80) for i in range(60)]
    copy = [(100, good[0][1], "en", "s0", 80)]
    spark.createDataFrame(good + copy + [(200, None, "en", None, None), (201, "", "en", "s1", 0)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut(stage(spark, docs, str(tmp_path)))
        assert docs.columns == names, name
        assert name != "line_dedup" or not docs.where("text LIKE '%Foot of%'").count()
        assert name != "near_dedup" or not docs.where("doc_id = 100").count()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


NAMES = ("fp", "th", "u", "v", "part", "size", "h", "score", "predicted", "held_out", "copies", "rid", "cell", "members", "__gone")


def test_stages_of_an_empty_table_and_clashing_names(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = [(i, f"word{i} and some {i * 3} others that stand {i * 7} here for row {i * 11} of it", "en", "s", 60) for i in range(12)] + [(3, "equal rows of text", "en", None, 18)] * 3 + [(None, None, None, "s", None)]
    full = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select("*", *[F.lit(f"own {c}").alias(c) for c in NAMES])
    spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (full, full.where("false")):
        empty = docs is not full
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != "pack":
                assert out.columns == docs.columns, name
                got = out.collect()
                assert all(r[c] == f"own {c}" for r in got for c in NAMES), name
                assert not empty or not got
            else:
                assert bool(out.count()) == (not empty)
