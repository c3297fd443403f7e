"""Format detection: magic bytes, then containers, then the extension; expressions and one broadcast join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfolio.functions.text import file_extension
from sparkfolio.sources.formats import BY_MIME, EXTENSIONS, FORMATS, SIGNATURES

MAGIC, CONTAINER, EXTENSION = 0.99, 0.95, 0.7


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def magic_format(content: Column) -> Column:
    """Key of the first signature that fits, or null."""
    out = F
    for key, offset, magic in SIGNATURES:
        raw = bytes.fromhex(magic)
        out = out.when(F.substring(content, offset + 1, len(raw)) == F.lit(raw), F.lit(key))
    return out


def _holds(content: Column, word: str) -> Column:
    return F.contains(content, F.lit(word.encode()))


def office_in_zip(content: Column) -> Column:
    found = F.when(_holds(content, "ppt"), "pptx").when(_holds(content, "xl/worksheets"), "xlsx").when(_holds(content, "word"), "docx")
    return F.when(_holds(content, "[Content_Types].xml"), found)


def office_in_compound(content: Column, name: Column) -> Column:
    book = _holds(content, "Workbook") | _holds(content, "Book")
    return F.when(_holds(content, "WordDocument"), "doc").when(book, "xls").when(_holds(content, "Current User"), "ppt").when(F.lower(file_extension(name)) == "msg", "msg")


def extension_format(name: Column) -> Column:
    return F.try_element_at(_map(EXTENSIONS), F.lower(file_extension(name)))


def format_by_extension(extension: Column) -> Column:
    """Key of a format by extension; leading dots don't count."""
    return F.try_element_at(_map(EXTENSIONS), F.lower(F.ltrim(extension, F.lit("."))))


def format_by_mime(mime: Column) -> Column:
    return F.try_element_at(_map({FORMATS[k][0]: k for k in BY_MIME}), mime)


def detection(content: Column, name: Column, signatures: bool = True) -> Column:
    """struct(format, confidence, method), or null. Later tests only run where earlier ones fail. Without signatures only the
    name counts, for content that is known to be text and may begin like anything."""
    magic = magic_format(content) if signatures else F.lit(None).cast("string")
    inside = F.when(magic == "zip", office_in_zip(content)).when(magic == "cfb", office_in_compound(content, name))
    by_name = extension_format(name)

    def found(key: Column, confidence: float, method: str) -> Column:
        return F.struct(key.alias("format"), F.lit(confidence).alias("confidence"), F.lit(method).alias("method"))

    return F.when(inside.isNotNull(), found(inside, CONTAINER, "ContainerInspection")).when(magic.isNotNull(), found(magic, MAGIC, "MagicBytes")).when(by_name.isNotNull(), found(by_name, EXTENSION, "Extension"))


def format_info(key: Column) -> Column:
    """struct(mime_type, extension, family, name, is_container) of a format key."""
    table = F.create_map(*(x for k, v in FORMATS.items() for x in (F.lit(k), F.struct(*(F.lit(a).alias(n) for a, n in zip(v, ("mime_type", "extension", "family", "name", "is_container")))))))
    return F.try_element_at(table, key)


def detect(files: DataFrame, content: str = "content", name: str = "name", signatures: bool = True) -> DataFrame:
    """files with format, mime_type, family, confidence and method; null where nothing fits. No shuffle."""
    found = files.withColumn("__d", detection(F.col(content), F.col(name), signatures)).withColumn("__f", format_info(F.col("__d.format")))
    return found.withColumns({"format": F.col("__d.format"), "mime_type": F.col("__f.mime_type"), "family": F.col("__f.family"), "confidence": F.col("__d.confidence"), "method": F.col("__d.method")}).drop("__d", "__f")


def summary_line(name: Column, mime: Column, confidence: Column) -> Column:
    return F.concat(F.lit("Format: "), name, F.lit("\nMIME type: "), mime, F.lit("\nConfidence: "), F.format_string("%.2f%%", confidence * 100))
