"""Which parser takes which content: registrations by MIME type, the last one wins, then the parser's own gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfolio.functions import text as T
from sparkfolio.sources.formats import FORMATS

from .lookup import last_of_each

ZIP_GATE = ("504B0304", "504B0504")


def winners(registrations: DataFrame) -> DataFrame:
    """One parser for each MIME type."""
    return last_of_each(registrations, ["mime_type"], "ordinal")


def gate(content: Column, mime: Column) -> Column:
    """The gates that are expressions; those that open a container are applied by the parsers."""
    starts = lambda *magic: F.substring(content, 1, len(bytes.fromhex(magic[0]))).isin(*(bytes.fromhex(m) for m in magic))
    tests = {
        ("text", "json", "xml", "csv", "markdown", "log"): T.is_likely_text(content) | (F.octet_length(content) == 0),  # an empty file is an empty text
        ("html",): T.is_likely_html(content),
        ("eml",): T.is_eml(content),
        ("mbox",): T.is_mbox(content),
        ("vcf",): T.is_vcard(content),
        ("ics",): T.is_calendar(content),
        ("pdf",): F.substring(content, 1, 5) == F.lit(b"%PDF-"),
        ("png",): starts("89504E470D0A1A0A"),
        ("jpeg",): starts("FFD8FF"),
        ("tiff",): starts("49492A00", "4D4D002A"),
        ("xlsx",): starts(*ZIP_GATE),
        ("docx", "pptx"): starts("504B0304"),
        ("doc", "xls", "ppt", "msg"): starts("D0CF11E0A1B11AE1"),
    }
    out = F
    for keys, test in tests.items():
        out = out.when(mime.isin(*sorted({FORMATS[k][0] for k in keys})), F.coalesce(test, F.lit(False)))
    return out.otherwise(F.lit(True))


def dispatch(files: DataFrame, registrations: DataFrame, trusted: Column | None = None) -> DataFrame:
    """files (mime_type, content) with `parser`, null where none is registered or its gate refuses. The registry has one
    row for each format, so it is broadcast. trusted: a boolean; where it is true no gate is asked."""
    joined = files.join(F.broadcast(winners(registrations).select("mime_type", "parser")), "mime_type", "left")
    taken = gate(F.col("content"), F.col("mime_type"))
    taken = taken if trusted is None else F.coalesce(trusted, F.lit(False)) | taken
    return joined.withColumn("parser", F.when(taken, F.col("parser")))


def unparsed(files: DataFrame, registrations: DataFrame) -> DataFrame:
    return files.join(F.broadcast(winners(registrations)), "mime_type", "left_anti")
