import io
import zipfile

import pytest
from pyspark.sql import functions as F

from veilflow.cli import main
from veilflow.plans.config import Config
from veilflow.plans.pipeline import anonymize_blocks
from veilflow.sources import files, sinks
from veilflow.streaming.stream import read_stream, write_stream

MAIL = Config(entities=("EMAIL_ADDRESS",))


def docx(*paragraphs):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr>' + "".join(f"<w:r><w:t>{t}</w:t></w:r>" for t in runs) + "</w:p>" for s, runs in paragraphs)
    table = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}{table}</w:body></w:document>")
        z.writestr("docProps/core.xml", "<x><dc:creator>Jane</dc:creator></x>")
    return out.getvalue()


def test_reads_text_and_docx(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Head\n\nMail a@b.fi\n", encoding="utf-8")
    (tmp_path / "b.txt").write_bytes("Käyttäjä c@d.fi".encode("latin-1"))
    (tmp_path / "c.docx").write_bytes(docx(("Heading2", ["Title"]), ("ListBullet", ["mail ", "e@", "f.fi"])))
    (tmp_path / "d.docx").write_bytes(b"no zip")
    (tmp_path / "skip.bin").write_bytes(b"x")
    assert [p.name for p in files.collect_inputs(tmp_path)] == ["a.md", "b.txt", "c.docx", "d.docx"]
    with pytest.raises(FileNotFoundError):
        files.collect_inputs(tmp_path / "none")
    docs = files.read_documents(spark, str(tmp_path))
    rows = {r["source"].rsplit("/", 1)[1]: r for r in docs.collect()}
    assert [b["text"] for b in rows["b.txt"]["blocks"]] == ["Käyttäjä c@d.fi"] and rows["d.docx"]["error"]
    assert [tuple(b) for b in rows["c.docx"]["blocks"]] == [("heading", 2, "Title"), ("list_item", None, "mail e@f.fi"), ("table_cell", None, "a | b")]
    made = sinks.markdown_document(anonymize_blocks(docs.where("error IS NULL"), MAIL)).collect()
    text = next(r["markdown"] for r in made if r["source"].endswith("a.md"))
    assert text.startswith("---\n") and text.endswith("# Head\n\nMail [EMAIL_1]\n") and '"EMAIL_ADDRESS":1' in text


def test_docx_redaction():
    new, hits = sinks.redact_docx(docx(("Normal", ["mail ", "e@", "f.fi now"])), [("[EMAIL_1]", "e@f.fi"), ("[ORG_1]", "none")])
    assert [b["text"] for b in files.docx_blocks(new)][0] == "mail [EMAIL_1] now" and hits == {"e@f.fi": 1, "none": 0}
    assert b"Jane" not in zipfile.ZipFile(io.BytesIO(new)).read("docProps/core.xml")


def test_names_and_stats(spark, tmp_path):
    row = spark.range(1).select(sinks.output_name(F.lit("/x/a.b.docx")), sinks.output_name(F.lit("/x/a.md"), "extract"), sinks.native_name(F.lit("a.PDF")), sinks.native_name(F.lit("a.txt"))).first()
    assert list(row) == ["a.b.anonymized.md", "a.extracted.md", "a.anonymized.pdf", None]
    stats = sinks.match_stats(spark.createDataFrame([("d", "x", 2), ("d", "y", 0)], "document string, surface string, n int")).first()
    assert (stats["total"], stats["found"], stats["hit_count"], stats["match_rate"]) == (2, 1, 2, 0.5)
    sinks.write_map({"[A_1]": "x"}, tmp_path / "m.json")
    assert (tmp_path / "m.json").stat().st_mode & 0o77 == 0


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "a@b.fi"), (2, "none")], "doc_id long, text string").write.parquet(f"{tmp_path}/in")
    query = write_stream(read_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp", MAIL)
    query.awaitTermination(120)
    assert sorted(r["anonymized_text"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["[EMAIL_1]", "none"]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.txt").write_text("Mail a@b.fi", encoding="utf-8")
    assert main([str(tmp_path), "--entities", "EMAIL_ADDRESS"]) == 0
    assert "Mail [EMAIL_1]" in capsys.readouterr().out
    assert main(["--list-entities"]) == 0 and "FI_HETU" in capsys.readouterr().out


def test_outline_levels():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document {w}><w:body><w:p><w:pPr><w:outlineLvl w:val="1"/></w:pPr><w:r><w:t>A</w:t></w:r></w:p><w:p><w:pPr><w:outlineLvl w:val="9"/></w:pPr><w:r><w:t>b</w:t></w:r></w:p></w:body></w:document>')
    assert [(b["kind"], b["level"]) for b in files.docx_blocks(out.getvalue())] == [("heading", 2), ("paragraph", None)]


def fake_pages(content):
    """Stands in for a PDF reader: one page a form feed, one block a blank line."""
    pages = content.decode().split("\f")
    return [{"kind": "paragraph", "level": None, "text": b, "page": i} for i, page in enumerate(pages, 1) for b in page.split("\n\n") if b.strip()]


def test_pdf_chain(spark, tmp_path):
    page = "ACME OY, Testikatu 1, 02330 Espoo\n\nsoft\nwrap number {0} of a text that is long enough\n\n{0} (3)"
    (tmp_path / "a.pdf").write_bytes("\f".join(page.format(i) for i in (1, 2, 3)).encode() + b"\n\nMail to user@example.\nfi please")
    (tmp_path / "thin.pdf").write_bytes(b"x")
    (tmp_path / "b.txt").write_text("left out", encoding="utf-8")
    inputs = [tmp_path / "a.pdf", tmp_path / "thin.pdf"]
    rows = {r["source"].rsplit("/", 1)[1]: r for r in files.read_documents(spark, str(tmp_path), inputs, extract=fake_pages, ocr=lambda c: b"A text layer made by recognition, long enough to count").collect()}
    assert set(rows) == {"a.pdf", "thin.pdf"}
    texts = [b["text"] for b in rows["a.pdf"]["blocks"]]
    assert texts == [f"soft wrap number {i} of a text that is long enough" for i in (1, 2, 3)] + ["Mail to user@example. fi please"] or texts[-1].startswith("Mail to user@example")
    assert rows["thin.pdf"]["used_ocr"] and "recognition" in rows["thin.pdf"]["blocks"][0]["text"]
    kept = files.read_documents(spark, str(tmp_path), inputs[:1], keep_headers=True, extract=fake_pages, no_ocr=True).first()
    assert len(kept["blocks"]) == 10 and not kept["used_ocr"]
    assert files.pdf_document(b"x", fake_pages, no_ocr=True) == (fake_pages(b"x"), False)
    with pytest.raises(RuntimeError):
        files.pdf_document(b"x", fake_pages, ocr=files.recognized, force_ocr=True)


def test_native_and_files_by_folder(spark, tmp_path):
    for d in ("one", "two"):
        (tmp_path / "in" / d).mkdir(parents=True)
        (tmp_path / "in" / d / "same.docx").write_bytes(docx(("Normal", [f"mail {d}@f.fi"])))
    docs = files.read_documents(spark, str(tmp_path / "in"))
    out = anonymize_blocks(docs, MAIL)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path / "in")).select(F.col("path").alias("source"), "content")
    native = sinks.native_documents(out, raw)
    rows = native.select(sinks.relative(F.col("source"), str(tmp_path / "in"), sinks.native_name(F.col("source"))).alias("path"), "content")
    assert sinks.write_files(rows, str(tmp_path / "out")) == 2
    for d in ("one", "two"):
        text = files.docx_blocks((tmp_path / "out" / d / "same.anonymized.docx").read_bytes())[0]["text"]
        assert text == "mail [EMAIL_1]"
    assert sinks.write_maps(out, str(tmp_path / "maps"), str(tmp_path / "in")) == 2
    made = tmp_path / "maps" / "two" / "same.anonymized.map.json"
    assert "two@f.fi" in made.read_text() and made.stat().st_mode & 0o77 == 0
    assert [r["stats"][0]["n"] for r in native.collect()] == [1, 1]
    with pytest.raises(ValueError):
        sinks.write_files(rows, "hdfs://x/y")


def test_command_line_options(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Mail a@b.fi and c@d.fi", encoding="utf-8")
    packs = str(tmp_path / "packs")
    common = ["--entities", "EMAIL_ADDRESS", "--template-dir", packs, "-q"]
    assert main(["strict", str(tmp_path / "in"), "--out-dir", str(tmp_path / "out"), "--map", str(tmp_path / "maps"), "--reject", "email_1", "--learn-to", "mine", *common]) == 0
    text = (tmp_path / "out" / "a.anonymized.md").read_text()
    assert "Mail a@b.fi and [EMAIL_2]" in text and "anonymized_at:" in text and 'tool: "veilflow"' in text and "used_ocr: false" in text
    assert "a@b.fi" not in (tmp_path / "maps" / "a.anonymized.map.json").read_text()
    # what was learnt is allowed from now on
    assert main(["strict", str(tmp_path / "in"), "-o", str(tmp_path / "one.md"), "--template", "mine", *common]) == 0
    assert "Mail a@b.fi and [EMAIL_1]" in (tmp_path / "one.md").read_text()
    capsys.readouterr()
    assert main(["templates", "get", "mine", "--dir", packs]) == 0 and "a@b.fi" in capsys.readouterr().out
    assert main(["templates", "fork", "en-field-labels", "--dir", packs]) == 0 and main(["templates", "new", "x", "--allow", "Foo", "--dir", packs]) == 0
    assert main(["templates", "new", "x", "--dir", packs]) == 2 and main(["templates", "delete", "en-field-labels", "--dir", packs]) == 2
    assert main(["templates", "set-enabled", "x,mine", "--dir", packs]) == 0
    capsys.readouterr()
    assert main(["templates", "print-enabled", "--dir", packs]) == 0 and capsys.readouterr().out.strip() == "x,mine"
    assert main(["templates", "delete", "x", "--dir", packs]) == 0 and main(["templates", "get", "x", "--dir", packs]) == 2


def test_lists_verbs(tmp_path, capsys):
    from veilflow.plans.config import load_config, load_lists

    path = tmp_path / "c" / "config.json"
    assert main(["lists", "print", "--config", str(path)]) == 0 and capsys.readouterr().out.startswith("---ALLOW---\n")
    (tmp_path / "allow").write_text("# mine\nFoo Oy\n\n Bar \n", encoding="utf-8")
    (tmp_path / "deny").write_text("Secret\n", encoding="utf-8")
    path.parent.mkdir()
    path.write_text('{"mode": "standard"}', encoding="utf-8")
    assert main(["lists", "save", "--config", str(path), "--allow-file", str(tmp_path / "allow"), "--deny-file", str(tmp_path / "deny")]) == 0
    assert load_lists(path) == (["Foo Oy", "Bar"], ["Secret"]) and load_config(path).mode == "standard" and path.stat().st_mode & 0o77 == 0
    capsys.readouterr()
    assert main(["lists", "print", "--config", str(path)]) == 0 and capsys.readouterr().out == "---ALLOW---\nFoo Oy\nBar\n---DENY---\nSecret\n"
    assert main(["lists", "migrate", "--config", str(path), "--dir", str(tmp_path)]) == 0
    assert main(["lists", "migrate", "--config", str(tmp_path / "none.json"), "--dir", str(tmp_path)]) == 2
    (tmp_path / "empty").write_text("", encoding="utf-8")
    assert main(["lists", "save", "--config", str(path), "--allow-file", str(tmp_path / "empty")]) == 0 and load_lists(path) == ([], ["Secret"])


def test_doctor(capsys):
    assert main(["doctor"]) == 0 and "pyspark" in capsys.readouterr().out


def test_match_statistics_of_a_run(spark):
    native = spark.createDataFrame([("a", b"", [("x", 2), ("y", 0)], None), ("b", None, [], "bad")], "source string, content binary, stats array<struct<surface:string,n:int>>, error string")
    (r,) = sinks.native_stats(native).collect()
    assert (r["document"], r["total"], r["found"], r["missed"], r["hit_count"], r["match_rate"], r["missing"]) == ("a", 2, 1, 1, 2, 0.5, ["y"])


def test_package_is_sent_where_workers_lack_it(spark, monkeypatch, tmp_path):
    from veilflow import shipping

    sent = []

    class Context:
        master = "spark://x:1"

        def addPyFile(self, path):
            sent.append(path)

    class Session:
        sparkContext = Context()

    monkeypatch.setenv("PYTHONPATH", str(tmp_path))
    shipping.ship(Session)
    shipping.ship(Session)
    assert len(sent) == 1 and "veilflow/shipping.py" in zipfile.ZipFile(sent[0]).namelist()
    Session.sparkContext = Context()
    monkeypatch.setenv("PYTHONPATH", str(shipping.HERE.parent))
    shipping.ship(Session)
    assert len(sent) == 1
