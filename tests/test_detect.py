"""Detection golden vectors and gates."""

import pytest
from pyspark.sql import functions as F

from sparkfolio.functions import text as T
from sparkfolio.operators.detect import detect, format_by_extension, summary_line
from sparkfolio.plans import fixtures
from sparkfolio.sources import formats as S


def test_magic_vectors(spark):
    rows = [(n, bytearray(b)) for n, b, *_ in fixtures.MAGIC]
    got = {r.name: (r.format, r.confidence, r.method) for r in detect(spark.createDataFrame(rows, "name string, content binary")).collect()}
    assert got == {n: (k, c, m) for n, _, k, c, m in fixtures.MAGIC}


def test_one_stage_and_no_python(spark):
    plan = detect(spark.createDataFrame([("a", bytearray(b""))], "name string, content binary"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("extension,mime", [("PDF", "application/pdf"), ("..Htm", "text/html"), ("pdf.", None), ("", None)])
def test_extension(spark, extension, mime):
    key = spark.range(1).select(format_by_extension(F.lit(extension)).alias("k")).first().k
    assert (S.FORMATS[key][0] if key else None) == mime


GATES = [
    (T.is_likely_text, b"Hello, World!", True),
    (T.is_likely_text, b'{"key": "value"}', True),
    (T.is_likely_text, bytes([0, 1, 2, 3, 255]), False),
    (T.is_likely_text, bytes([255, 254, 253]), False),
    (T.is_likely_text, bytes([0, 1, 2]), False),
    (T.is_likely_text, b"", False),
    (T.is_likely_html, b"  <!DOCTYPE html><html>", True),
    (T.is_likely_html, b"<HTML>", True),
    (T.is_likely_html, b"<p>x</p><head></head><body>", True),
    (T.is_likely_html, b"plain text", False),
    (T.is_likely_html, b"a" * 1023 + "é".encode() + b"<html", False),
    (T.is_eml, b"From: a\nSubject: b", True),
    (T.is_eml, b"from: a\nto: b", False),
    (T.is_mbox, b"From x", True),
    (T.is_mbox, b"From: x", False),
    (T.is_vcard, b"BEGIN:VCARD", True),
    (T.is_calendar, b" " * 600 + b"BEGIN:VCALENDAR", False),
]


def test_gates(spark):
    for f, data, want in GATES:
        df = spark.createDataFrame([(bytearray(data),)], "c binary")
        assert df.select(f(F.col("c")).alias("x")).first().x is want, (f.__name__, data[:20])


def test_tables(spark):
    assert len(S.EXTENSIONS) == 31 and len(S.SIGNATURES) == 13 and len(S.PARSERS) == 22
    line = spark.range(1).select(summary_line(F.lit("PDF"), F.lit("application/pdf"), F.lit(0.99)).alias("x")).first().x
    assert line.endswith("99.00%")
