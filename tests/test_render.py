"""Rendering and the conversion service."""

from pyspark.sql import functions as F

from sparkfolio.operators.convert import convert, health, tally
from sparkfolio.operators.extract import blocks_of, cells_of, document_text, images_of, runs_of
from sparkfolio.operators.render import render_document
from sparkfolio.plans import fixtures as X
from sparkfolio.sources.formats import FORMATS
from sparkfolio.sources.parse import parse_files


def files(spark, rows):
    return spark.createDataFrame([(n, bytearray(b), len(b)) for n, b in rows], "name string, content binary, length long")


def test_documents(spark):
    rows = [(n, bytearray(b), FORMATS[k][0]) for n, k, b in X.packages()]
    parsed = parse_files(spark.createDataFrame(rows, "name string, content binary, mime_type string")).withColumnRenamed("name", "doc_id").cache()
    html = {r.doc_id: r.h for r in parsed.select("doc_id", render_document(F.col("document")).alias("h")).collect()}
    assert all(h.startswith("<!DOCTYPE html>") for h in html.values())
    assert "<strong><" not in html["a.docx"] and '<span style="font-size: 15pt; color: #FF0000"><em><strong>One &amp; </strong></em></span>' in html["a.docx"]
    assert '<td colspan="2">ab</td>' in html["a.docx"] and "Page 1<" in html["a.docx"]
    assert "background-image: url('data:image/png;base64," in html["a.pptx"] and "Page 2<" in html["a.pptx"]
    assert "transform: rotate(90deg)" in html["a.pptx"] and "border: 2pt solid 0000FF;" in html["a.pptx"] and 'alt="a &amp;quot;b&amp;quot;"' in html["a.pptx"]
    assert 'class="page"' not in html["a.png"] and "width: 2pt; height: 1pt;" in html["a.png"]
    assert 'class="page"' not in html["a.msg"] and "<strong>From: Ann\n</strong>" in html["a.msg"]
    assert "pdf-viewer-container" in html["a.pdf"] and "Untitled" not in html["a.pdf"] and "T)x" in html["a.pdf"]
    text = {r.doc_id: r.t for r in parsed.select("doc_id", document_text(F.col("document")).alias("t")).collect()}
    assert text["a.docx"] == "One & two\na b\t" and text["a.xls"] == "name\tvalue\t\n2.5\t7\t\ntrue\t\t"
    assert cells_of(parsed.where("doc_id = 'a.xlsx'")).count() == 8 and images_of(parsed.where("doc_id = 'a.tif'")).count() == 2
    assert runs_of(parsed.where("doc_id = 'a.docx'")).count() == 2 and blocks_of(parsed.where("doc_id = 'a.pptx'")).count() == 4


def test_convert(spark):
    rows = [("a.txt", b"hello"), ("x.zip", X.zipped({"a": b"b"})), ("none.xyz", b"?"), ("bad.docx", b"PK\x03\x04 [Content_Types].xml word"), ("bad.png", b"\x89PNG\r\n\x1a\n"), ("ctl.txt", b"\0\1\2"), ("big.txt", b"y" * 100)]
    got = {r.name: r for r in convert(files(spark, rows), limit=99).collect() if r.name != "x.zip"} | {"x.zip": convert(files(spark, rows[1:2])).first()}
    assert {n: r.status for n, r in got.items()} == {"a.txt": 200, "x.zip": 200, "none.xyz": 415, "bad.docx": 200, "bad.png": 500, "ctl.txt": 200, "big.txt": 400}
    assert "hello" in got["a.txt"].body and got["a.txt"].content_type.startswith("text/html")
    assert '"mime_type":"application/zip"' in got["x.zip"].body and '"method":"MagicBytes"' in got["x.zip"].body and '"confidence":0.99' in got["x.zip"].body
    assert got["none.xyz"].body == '{"error":"415 Unsupported Media Type","message":"Unable to detect file format"}'
    strict = {r.status: r.n for r in tally(convert(files(spark, rows[1:2]), fallback=False)).collect()}
    assert strict == {501: 1} and health(spark).first().status == "healthy"


def test_stream_equals_batch(spark, tmp_path):
    from sparkfolio.sources.files import read_files, within_limit
    from sparkfolio.streaming.documents import convert_stream

    source = tmp_path / "in" / "deep"
    source.mkdir(parents=True)
    for n, _, b in X.packages():
        (source / n).write_bytes(b)
    batch = convert(read_files(spark, str(tmp_path / "in")))
    convert_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    key = lambda df: sorted((r.name, r.status, r.body) for r in df.select("name", "status", "body").collect())
    assert key(batch) == key(spark.read.parquet(str(tmp_path / "out")))
    small, large = within_limit(read_files(spark, str(tmp_path / "in")), 1000)
    assert small.count() + large.count() == len(X.packages()) and large.count() > 0


def test_own_parsers(spark):
    from sparkfolio.sources.udm import document, page, run, text_block

    def upper(data, name):
        return document([page(1, [text_block([run(data.decode().upper())])])], title=name)

    df = spark.createDataFrame([("a", bytearray(b"abc"), "application/own"), ("b", bytearray(b"abc"), "text/plain"), ("c", bytearray(b""), "no/parser")], "name string, content binary, mime_type string")
    got = {r.name: (r.t, r.e) for r in parse_files(df, own={"application/own": upper}).select("name", document_text(F.col("document")).alias("t"), F.col("document.error.kind").alias("e")).collect()}
    assert got == {"a": ("ABC", None), "b": ("abc", None), "c": ("", "UnsupportedFormat")}
