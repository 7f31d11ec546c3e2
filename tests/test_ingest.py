import bz2
import email.message
import gzip
import io
import tarfile
import zipfile

from pyspark.sql import functions as F

from textloom.sources import extract as E
from textloom.sources import incremental, kinds
from textloom.streaming import alerts


def zipped(files: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def texts(data, name):
    return [(d.inner, d.text) for d in E.extract(data, name)]


def reason(data, name):
    try:
        list(E.extract(data, name))
    except E.Skipped as why:
        return str(why)


def test_text_encodings():
    assert texts("é⟦x⟧".encode(), "a.txt") == [(None, "éx")]
    assert texts("é".encode("cp1252") * 40, "a.txt")[0][1][0] == "é" and texts(b"\xff\xfe" + "ü".encode("utf-16-le"), "a.md") == [(None, "ü")]
    assert reason(b"a\0b", "a.txt") == "binary" and reason(b"x", "a.xyz") == "unsupported" and reason(b"x", "a.docx") == "corrupt" and reason(b"%PDF", "a.pdf") == "unsupported"


def test_office_formats():
    w = '<w:document xmlns:w="w"><w:p><w:t>one</w:t><w:tab/><w:t>two &amp; x</w:t></w:p><w:p><w:t>three</w:t></w:p></w:document>'
    assert texts(zipped({"word/document.xml": w.encode()}), "a.docx") == [(None, "one\ttwo & x\nthree")]
    slide = '<p:s xmlns:p="p" xmlns:a="a"><a:p><a:t>T{}</a:t></a:p></p:s>'
    assert texts(zipped({f"ppt/slides/slide{i}.xml": slide.format(i).encode() for i in (10, 2)}), "a.pptx") == [(None, "— 1 —\nT2\n— 2 —\nT10")]
    book = {
        "xl/workbook.xml": b'<w xmlns:r="r"><sheet name="S1" r:id="r1"/></w>', "xl/_rels/workbook.xml.rels": b'<R><Relationship Id="r1" Target="worksheets/s.xml"/></R>',
        "xl/sharedStrings.xml": b"<s><si><t>hello</t></si></s>", "xl/styles.xml": b'<s><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></s>',
        "xl/worksheets/s.xml": b'<w><row><c r="B1" t="s"><v>0</v></c><c r="C1" s="1"><v>45292</v></c><c r="D1"/></row></w>',
    }
    assert texts(zipped(book), "a.xlsx") == [(None, "— S1 —\n\thello\t2024-01-01")]
    odt = '<o xmlns:t="t"><t:h>Head</t:h><t:p>a<t:s t:c="3"/>b<t:tab/>c<t:note>no</t:note></t:p></o>'
    assert texts(zipped({"content.xml": odt.encode()}), "a.odt") == [(None, "Head\na   b\tc")]
    assert texts(rb"{\rtf1\ansi\ansicpg1252{\fonttbl x}caf\'e9\par \u8364? x{\*\gen y}}", "a.rtf") == [(None, "café\n€ x")]
    epub = {"META-INF/container.xml": b'<c><rootfile full-path="o/p.opf"/></c>', "o/p.opf": b'<p><item id="a" href="c%201.xhtml"/><itemref idref="a"/></p>', "o/c 1.xhtml": b"<html><head><title>no</title></head><body><p>Hi &eacute;</p></body></html>"}
    assert texts(zipped(epub), "a.epub") == [(None, "Hi é")]


def test_archives_and_limits(monkeypatch):
    inner = zipped({"deep.txt": b"deep"})
    assert texts(zipped({"x/a.txt": b"A", "b.zip": inner, "c.bin": b"no"}), "a.zip") == [("x/a.txt", "A"), ("b.zip › deep.txt", "deep")]
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        info = tarfile.TarInfo("t.txt")
        info.size = 1
        t.addfile(info, io.BytesIO(b"T"))
    assert texts(out.getvalue(), "a.tar.gz") == [("t.txt", "T")]
    assert texts(gzip.compress(b"log"), "a.log.gz") == [("a.log", "log")] and texts(bz2.compress(b"log"), "a.log.bz2") == [("a.log", "log")]
    assert texts(zipped({"bomb.txt": b"0" * (4 << 20)}), "a.zip") == [] and reason(b"no", "a.zip") == "corrupt"
    monkeypatch.setattr(E, "MAX_ENTRIES", 1)
    assert len(texts(zipped({"a.txt": b"A", "b.txt": b"B"}), "a.zip")) == 1
    assert E.extract_raw(zipped({"a.txt": b"A"}), "a.zip", "a.txt") == b"A"


def message(subject):
    m = email.message.EmailMessage()
    m["Subject"], m["From"], m["To"], m["Date"] = subject, "a@x.org", "b@x.org", "Thu, 01 Jan 1970 00:01:00 +0000"
    m.set_content("body text")
    m.add_attachment(zipped({"in.txt": b"inside"}), maintype="application", subtype="zip", filename="z.zip")
    return m


def test_mail():
    docs = list(E.extract(message("Hello").as_bytes(), "a.eml"))
    assert docs[0].text == "Hello\na@x.org\nb@x.org\n\nbody text\n📎 z.zip" and docs[0].modified == 60
    assert (docs[1].inner, docs[1].text, docs[1].kind) == ("z.zip › in.txt", "inside", "email")
    box = b"".join(b"From a\n" + message("Same").as_bytes() + b"\n" for _ in range(2))
    assert [d.inner for d in E.extract(box, "a.mbox")] == ["Same", "Same › z.zip › in.txt", "Same (2)", "Same (2) › z.zip › in.txt"]


def test_crawl_and_extract(spark, tmp_path):
    for name, data in {"a.txt": b"A", "sub/b.md": b"B", "node_modules/x.js": b"no", "c.xyz": b"no", "bad.docx": b"no", "Dockerfile": b"FROM x", "tmp/d.txt": b"D"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    rows = {r["path"].rpartition("/")[2]: r for r in E.extract_files(spark, str(tmp_path), ["tmp"]).collect()}
    assert set(rows) == {"a.txt", "b.md", "bad.docx", "Dockerfile"} and rows["bad.docx"]["skipped"] == "corrupt" and rows["Dockerfile"]["kind"] == "code"


def test_kinds(spark):
    names = ["a.PDF", "x/Makefile", "y.tar.gz", "n.o.thing", ".env", "b.jpeg", "q"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(kinds.kind_of(F.col("n"))).collect()]
    assert got == ["pdf", "code", "archive", None, None, "image", None]
    assert [kinds.kind_of_name(n) for n in ("a.PDF", "Makefile", "q")] == ["pdf", "code", None]


def test_manifest(spark):
    schema = "site_id string, path string, size long, modified long"
    crawl = spark.createDataFrame([("s", "a", 1, 1), ("s", "b", 2, 2), ("s", "n", 1, 1)], schema)
    manifest = spark.createDataFrame([("s", "a", 1, 1), ("s", "b", 9, 2), ("s", "gone", 1, 1), ("lost", "x", 1, 1)], schema)
    assert sorted(r["path"] for r in incremental.changed(crawl, manifest).collect()) == ["b", "n"]
    assert sorted(r["path"] for r in incremental.removed(crawl, manifest, ["lost"]).collect()) == ["gone"]
    docs = spark.createDataFrame([("s", "a", 1), ("s", "b", 1), ("s", "c", 1)], "site_id string, file string, v int")
    fresh, gone = spark.createDataFrame([("s", "b", 2)], docs.schema), spark.createDataFrame([("s", "c")], "site_id string, file string")
    assert sorted(map(tuple, incremental.upsert(docs, fresh, gone).collect())) == [("s", "a", 1), ("s", "b", 2)]
    moved = incremental.remap_paths(spark.createDataFrame([("E:\\x\\y",), ("e:/z",), ("EE:/z",)], "path string"), "E:", "F:")
    assert [r[0] for r in moved.collect()] == ["F:\\x\\y", "F:/z", "EE:/z"]


def test_upsert_stream_equals_batch(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    schema = "path string, modified long, v int"
    for k, rows in enumerate([[("a", 1, 1), ("b", 1, 1)], [("a", 2, 2), ("c", 1, 1)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        alerts.upsert_stream(alerts.watch(spark, source, schema), table, str(tmp_path / "check")).awaitTermination(120)
        assert alerts.current_version(spark, table) == k
    assert sorted(map(tuple, alerts.read_current(spark, table).collect())) == [("a", 2, 2), ("b", 1, 1), ("c", 1, 1)]


def test_alerts(spark):
    found = spark.createDataFrame([("a",), ("a",), ("b",)], "path string")
    seen = spark.createDataFrame([("b",)], "path string")
    assert [r[0] for r in alerts.fresh_alerts(found, seen, ["path"]).collect()] == ["a"]
    assert alerts.forget_removed(seen, found, ["path"]).count() == 0
