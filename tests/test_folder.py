from veilflow.plans.config import Config
from veilflow.plans.folder import anonymize_together


def test_names_of_one_file_are_found_in_another(spark):
    rows = [
        (1, "a", "Nimi: Matti Meikäläinen\nMail x@y.fi"),
        (2, "a", "we met MATTI MEIKÄLÄINEN and matti meikäläinens dog; X@Y.fi, z@y.fi"),
        (3, "b", "we met Matti Meikäläinen; z@y.fi"),
        (4, None, "x@y.fi"),
        (5, "a", None),
        (6, "b", ""),
    ]
    df = spark.createDataFrame(rows, "doc_id long, folder string, text string")
    docs, names = anonymize_together(df, Config(entities=("PERSON", "EMAIL_ADDRESS")))
    got = {r["doc_id"]: r["anonymized_text"] for r in docs.collect()}
    assert got == {
        1: "Nimi: [PERSON_1]\nMail [EMAIL_1]", 2: "we met [PERSON_1] and matti meikäläinens dog; [EMAIL_1], [EMAIL_2]",
        3: "we met Matti Meikäläinen; [EMAIL_1]", 4: "[EMAIL_1]", 5: "", 6: "",
    }
    table = {(r["folder"], r["placeholder"]): r["original"] for r in names.collect()}
    assert table == {("a", "[PERSON_1]"): "Matti Meikäläinen", ("a", "[EMAIL_1]"): "x@y.fi", ("a", "[EMAIL_2]"): "z@y.fi", ("b", "[EMAIL_1]"): "z@y.fi", (None, "[EMAIL_1]"): "x@y.fi"}
    assert docs.columns[:3] == df.columns and anonymize_together(df.where("false"))[0].count() == 0
