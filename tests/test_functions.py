"""Scalar functions against plain Python."""

import random
from decimal import ROUND_HALF_EVEN, Decimal

from pyspark.sql import functions as F

from sparkfolio.functions import numbers as N
from sparkfolio.functions import text as T
from sparkfolio.operators.lookup import page_count, split_mailbox
from sparkfolio.sources.legacy import printable_text
from sparkfolio.sources.mail import split_mailbox as split_in_python
from sparkfolio.sources.office import number_text


def one(spark, column, value, kind):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


def many(spark, column, values, kind):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r.y for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_sizes(spark):
    def want(n):
        q = lambda d: str((Decimal(n) / d).quantize(Decimal("0.1"), ROUND_HALF_EVEN))
        return f"{n} B" if n < 1024 else f"{q(1024)} KB" if n < 1024**2 else f"{q(1024**2)} MB"

    values = [0, 1023, 1024, 1280, 1792, 1048575, 1048576, 5 * 2**30, *(random.Random(1).randrange(2**34) for _ in range(300))]
    assert many(spark, N.format_size, values, "long") == [want(n) for n in values]
    assert want(1280) == "1.2 KB"


def test_css_numbers(spark):
    values = [612.0, 595.28, 0.0, -0.0, 1e10, 1.5e-7, 123456789.25, 0.1, 1e-4, 12345678.9, -2.5]
    assert many(spark, N.css_number, values, "double") == [number_text(v) for v in values]
    assert many(spark, N.css_number, [float("nan"), float("inf"), float("-inf")], "double") == ["NaN", "inf", "-inf"]


def test_columns(spark):
    for letters, index in {"A": 0, "Z": 25, "AA": 26, "AB": 27, "AZ": 51, "BA": 52}.items():
        assert one(spark, N.column_index, letters, "string") == index and one(spark, N.column_letters, index, "long") == letters
    assert many(spark, N.column_index, ["", "1", "a"], "string") == [None] * 3
    letters = many(spark, N.column_letters, list(range(1000)), "long")
    assert many(spark, N.column_index, letters, "string") == list(range(1000))
    got = many(spark, N.cell_reference, ["A1", "B5", "Z99", "AA10", "A0", "", "123", "ABC"], "string")
    assert [r and tuple(r) for r in got] == [(0, 0), (4, 1), (98, 25), (9, 26), (0, 0), None, None, None]


def test_text(spark):
    assert one(spark, T.html_escape, "<a href=\"x\">'&'</a>", "string") == "&lt;a href=&quot;x&quot;&gt;&#x27;&amp;&#x27;&lt;/a&gt;"
    assert many(spark, T.html_title, ["<title>My Page Title</title>", "<title>  My Page\n</title>x", "<p>", "<title>open", "<TITLE>x</TITLE>"], "string") == ["My Page Title", "My Page", None, None, None]
    texts = ["Hello\0\0\0World\x01\x02Test", "abc", "a\tb\nc d", "", "é" + "long enough" + "é" + "abc"]
    assert many(spark, T.printable_text, texts, "string") == [printable_text(t.encode()) for t in texts]
    words = ["a b", " a　b c ", "", " ", "a\x1cb"]
    assert many(spark, T.word_count, words, "string") == [2, 3, 0, 0, 1]
    assert many(spark, T.base64_plain, [bytearray(b"x" * 200)], "binary")[0].count("\n") == 0
    assert many(spark, T.utf16_until_null, [bytearray("hé\0z".encode("utf-16-le")), bytearray(b"abc"), bytearray(b"a")], "binary") == ["hé", "abc", "a"]


def test_rect(spark):
    rect = F.struct(F.lit(10.0).alias("x"), F.lit(10.0).alias("y"), F.lit(100.0).alias("width"), F.lit(50.0).alias("height"))
    for x, y, want in ((50, 30, True), (10, 10, True), (110, 60, True), (5, 30, False), (50, 100, False)):
        assert spark.range(1).select(N.rect_contains(rect, F.lit(float(x)), F.lit(float(y))).alias("z")).first().z is want
    assert spark.range(1).select(N.inches(F.lit(8.5)).alias("w"), N.inches(F.lit(11)).alias("h")).first()[:] == (612.0, 792.0)


def test_pagination(spark):
    def want(paragraphs):
        pages = count = held = 0
        for p in paragraphs:
            count += 1
            if p:
                held += 1
                if count >= 50:
                    pages, count, held = pages + 1, 0, 0
        return max(1, pages + (held > 0))

    r = random.Random(3)
    values = [[r.choice(["", "x"]) for _ in range(r.randint(0, 300))] for _ in range(60)]
    assert many(spark, page_count, values, "array<string>") == [want(v) for v in values]


def test_mailbox(spark):
    texts = ["From a\nb\nFrom c\nd", "x\nFrom c\nd", "From only", "", "From a\n\nFrom b"]
    got = many(spark, split_mailbox, texts, "string")
    assert [[m.body for m in g] for g in got] == [[p.partition("\n")[2] for p in split_in_python(t) if "\n" in p] for t in texts]
