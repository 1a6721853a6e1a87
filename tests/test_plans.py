import json

import pytest
from pyspark.sql import functions as F

from veilflow.entities import Registry
from veilflow.plans import review, templates
from veilflow.plans.config import Config, load_config, with_packs
from veilflow.plans.pipeline import anonymize, anonymize_blocks

TEXT = "Supplier ACME Widgets Oy, 0737546-2. Mail a@b.fi or call 040 123 4567. Acme widgets oy again: c@d.fi, a@b.fi"


MAIL = Config(entities=("EMAIL_ADDRESS",))  # fewer types make a smaller plan


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def test_strict_and_standard(spark):
    strict = anonymize(docs(spark, TEXT)).first()
    assert "a@b.fi" not in strict["anonymized_text"] and "[EMAIL_1]" in strict["anonymized_text"] and "0737546-2" not in strict["anonymized_text"]
    standard = anonymize(docs(spark, TEXT), Config(mode="standard")).first()["anonymized_text"]
    assert "0737546-2" in standard and "ACME Widgets Oy" in standard and "040 123" not in standard
    assert anonymize(docs(spark, TEXT), Config(mode="extract")).first()["anonymized_text"] == TEXT


def test_nulls_empty_and_empty_table(spark):
    rows = anonymize(docs(spark, None, ""), MAIL).orderBy("doc_id").collect()
    assert [r["anonymized_text"] for r in rows] == ["", ""] and all(not r["hits"] for r in rows)
    assert anonymize(docs(spark, "x").where("false"), MAIL).count() == 0


def test_allow_wins_last_and_deny_adds(spark):
    cfg = Config(entities=("EMAIL_ADDRESS",), allow=("a@b.fi",), deny=(("again", "CUSTOM"),))
    out = anonymize(docs(spark, TEXT), cfg).first()["anonymized_text"]
    assert "a@b.fi" in out and "[CUSTOM_1]" in out and "c@d.fi" not in out


def test_blocks_share_one_map(spark):
    df = spark.createDataFrame([(1, [("heading", 1, "Mail a@b.fi"), ("paragraph", None, "c@d.fi and a@b.fi")])], "doc_id int, blocks array<struct<kind:string,level:int,text:string>>")
    got = anonymize_blocks(df, MAIL).first()["anonymized_blocks"]
    assert [b["text"] for b in got] == ["Mail [EMAIL_1]", "[EMAIL_2] and [EMAIL_1]"]


def test_plugins_and_config(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"mode": "standard", "entities": ["EMPLOYEE_ID"], "plugins": [{"entity_type": "EMPLOYEE_ID", "patterns": [{"regex": "EMP-[0-9]{6}"}]}], "denylist": ["Foo"]}))
    cfg = load_config(path)
    assert cfg.mode == "standard" and cfg.deny == (("Foo", "ORG"),)
    assert "[EMPLOYEE_ID_1]" in anonymize(docs(spark, "Badge EMP-123456 and EMP-12."), cfg).first()["anonymized_text"]
    path.write_text(json.dumps({"plugins": [{"entity_type": "X"}]}))
    with pytest.raises(ValueError):
        load_config(path)
    reg = Registry()
    assert reg.label_for("SE_LICENSE_PLATE") == "PLATE_SE"
    with pytest.raises(ValueError):
        reg.register("PERSON", "HUMAN")


def test_review(spark):
    out = anonymize(docs(spark, TEXT), MAIL)
    table = review.findings(out)
    off = review.reject(table, "email_1")
    text = review.apply(out, off).first()["anonymized_text"]
    assert "a@b.fi" in text and "c@d.fi" not in text
    new = spark.createDataFrame([(0, "Bob", "PERSON", "PERSON"), (0, "a@b.fi", "EMAIL_ADDRESS", "EMAIL")], "doc_id int, original string, entity_type string, label string")
    added = review.add(off, new)
    rows = {r["placeholder"]: r for r in added.collect()}
    assert rows["[EMAIL_1]"]["enabled"] and rows["[PERSON_1]"]["source"] == "user"
    allow, deny = review.teach(off)
    assert [r[0] for r in allow.collect()] == ["a@b.fi"] and deny.count() == 0
    parsed = spark.range(1).select(review.parse_rejects(F.lit("org_1, X_9 foo"), F.array(F.lit("[ORG_1]")))).first()[0]
    assert parsed["known"] == ["[ORG_1]"] and parsed["unknown"] == ["[X_9]", "foo"]


def test_templates(spark, tmp_path):
    packs = [templates.Template("a", allow=("Acme", "acme", "Foo")), templates.Template("b", deny=(("ACME", "ORG"), ("Beta", "ORG")))]
    enabled = spark.createDataFrame([(0, "a"), (1, "b"), (2, "zzz")], "pos int, id string")
    allow, deny, conflicts = templates.union(templates.as_table(spark, packs), enabled)
    assert sorted(r["text"] for r in allow.collect()) == ["Acme", "Foo"]
    assert [r["text"] for r in deny.collect()] == ["Beta"] and [r["text"] for r in conflicts.collect()] == ["ACME"]
    t = templates.merged(packs[0], ["FOO", "Baz"], [("Qux", "ORG")])
    assert t.allow == ("Acme", "acme", "Foo", "Baz") and t.deny == (("Qux", "ORG"),)
    path = templates.save(t, tmp_path / "a.json")
    assert path.stat().st_mode & 0o77 == 0 and templates.load(path).allow == t.allow
    assert [x.id for x in templates.discover(tmp_path)][-1] == "a"
    assert templates.enabled_ids(packs, flag="") == [] and templates.lines("# no\n a \n\n") == ["a"]


def test_packs_in_a_run(spark, tmp_path):
    templates.save(templates.Template("own", allow=("A@b.fi",), deny=(("again", "CUSTOM"), ("a@B.fi", "ORG"))), tmp_path / "own.json")
    cfg = with_packs(Config(entities=("EMAIL_ADDRESS",)), "own", (tmp_path,))
    assert cfg.allow == ("A@b.fi",) and cfg.deny == (("again", "CUSTOM"),)
    out = anonymize(docs(spark, TEXT), cfg).first()["anonymized_text"]
    assert "a@b.fi" in out and "[CUSTOM_1]" in out
    assert "Y-tunnus" in with_packs(Config()).allow and with_packs(Config(), "").allow == ()
    with pytest.raises(ValueError):
        with_packs(Config(), "nothing")
    assert templates.migrated({"allowlist_extra": ["x"], "denylist": ["y"]}).deny == (("y", "ORG"),) and templates.migrated({}) is None


def test_configuration_is_checked(tmp_path):
    path = tmp_path / "c.json"
    for wrong in ({"modus": "strict"}, {"score_threshold": "high"}, {"include_dates": 1}, {"plugins": {}}):
        path.write_text(json.dumps(wrong))
        with pytest.raises(ValueError):
            load_config(path)
    path.write_text(json.dumps({"templates": ["own"], "output_format": "native", "languages": ["en"]}))
    cfg = load_config(path)
    assert (cfg.templates, cfg.output_format, cfg.languages) == (("own",), "source", ("en",))


def test_row_plugin_from_a_file(spark, tmp_path):
    (tmp_path / "badge.py").write_text("import re\n\ndef find(text):\n    return [(m.start(), m.end(), 0.9) for m in re.finditer('EMP-[0-9]+', text)]\n")
    (tmp_path / "c.json").write_text(json.dumps({"entities": ["BADGE"], "plugins": [{"python": "badge.py:find", "rows": True, "entity_type": "BADGE"}]}))
    cfg = load_config(tmp_path / "c.json")
    rows = anonymize(docs(spark, "é EMP-12 here", None, ""), cfg).orderBy("doc_id").collect()
    assert [r["anonymized_text"] for r in rows] == ["é [BADGE_1] here", "", ""]


def test_recount_sorting_and_surfaces(spark):
    df = spark.createDataFrame([(1, "[EMAIL_2] and [EMAIL_1], [EMAIL_2] [PLATE_FI_10] [PLATE_FI_9] [x]"), (2, None)], "doc_id int, anonymized_text string")
    assert {(r["doc_id"], r["entity_type"], r["n"]) for r in review.recount(df).collect()} == {(1, "EMAIL_ADDRESS", 2), (1, "FI_LICENSE_PLATE", 2)}
    row = spark.range(1).select(
        review.sorted_placeholders(F.array(*[F.lit(x) for x in ("[PLATE_FI_10]", "[EMAIL_2]", "[PLATE_FI_9]", "[A]")])),
        review.resolved_surface(F.lit("met Jane Doe once"), F.lit(" Jane \n Doe ")), review.resolved_surface(F.lit("met Jane"), F.lit(" Jane ")), review.resolved_surface(F.lit("met Jane"), F.lit("Bob")),
    ).first()
    assert list(row) == [["[A]", "[EMAIL_2]", "[PLATE_FI_9]", "[PLATE_FI_10]"], "Jane Doe", "Jane", None]
