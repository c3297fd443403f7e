"""The known formats, their signatures and extensions, as literal tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_OOXML = "application/vnd.openxmlformats-officedocument"
#: key: MIME type, usual extension, family, name, is a container (fixed values).
FORMATS = {
    "pdf": ("application/pdf", "pdf", "Document", "PDF", False),
    "docx": (f"{_OOXML}.wordprocessingml.document", "docx", "Office", "Microsoft Word (DOCX)", True),
    "xlsx": (f"{_OOXML}.spreadsheetml.sheet", "xlsx", "Office", "Microsoft Excel (XLSX)", True),
    "pptx": (f"{_OOXML}.presentationml.presentation", "pptx", "Office", "Microsoft PowerPoint (PPTX)", True),
    "png": ("image/png", "png", "Image", "PNG Image", False),
    "jpeg": ("image/jpeg", "jpg", "Image", "JPEG Image", False),
    "tiff": ("image/tiff", "tif", "Image", "TIFF Image", False),
    "gif": ("image/gif", "gif", "Image", "GIF Image", False),
    "text": ("text/plain", "txt", "Text", "Plain Text", False),
    "json": ("application/json", "json", "Text", "JSON", False),
    "xml": ("application/xml", "xml", "Text", "XML", False),
    "csv": ("text/csv", "csv", "Text", "CSV", False),
    "markdown": ("text/markdown", "md", "Text", "Markdown", False),
    "log": ("text/plain", "log", "Text", "Log File", False),
    "html": ("text/html", "html", "Text", "HTML", False),
    "doc": ("application/msword", "doc", "Office", "Microsoft Word 97-2003", True),
    "xls": ("application/vnd.ms-excel", "xls", "Office", "Microsoft Excel 97-2003", True),
    "ppt": ("application/vnd.ms-powerpoint", "ppt", "Office", "Microsoft PowerPoint 97-2003", True),
    "eml": ("message/rfc822", "eml", "Email", "Email Message", False),
    "msg": ("application/vnd.ms-outlook", "msg", "Email", "Outlook Message", False),
    "mbox": ("application/mbox", "mbox", "Email", "Email Mailbox", True),
    "vcf": ("text/vcard", "vcf", "Contact", "vCard Contact", False),
    "ics": ("text/calendar", "ics", "Email", "iCalendar", False),
    "zip": ("application/zip", "zip", "Archive", "ZIP Archive", True),
    "tar": ("application/x-tar", "tar", "Archive", "TAR Archive", True),
    "gzip": ("application/gzip", "gz", "Archive", "GZIP Compressed File", False),
    "cfb": ("application/x-cfb", "", "Office", "OLE Compound File", True),
    "rar": ("application/vnd.rar", "rar", "Archive", "RAR Archive", True),
    "7z": ("application/x-7z-compressed", "7z", "Archive", "7-Zip Archive", True),
}
#: Signatures in the order they are tried: format, offset, bytes in hexadecimal (fixed values).
SIGNATURES = (
    ("pdf", 0, "25504446"),
    ("png", 0, "89504E470D0A1A0A"),
    ("jpeg", 0, "FFD8FF"),
    ("zip", 0, "504B0304"),
    ("tar", 257, "7573746172"),
    ("gzip", 0, "1F8B"),
    ("gif", 0, "474946383761"),
    ("gif", 0, "474946383961"),
    ("tiff", 0, "49492A00"),
    ("tiff", 0, "4D4D002A"),
    ("cfb", 0, "D0CF11E0A1B11AE1"),
    ("rar", 0, "526172211A07"),
    ("7z", 0, "377ABCAF271C"),
)
#: Extension to format (fixed values).
EXTENSIONS = {
    "pdf": "pdf", "docx": "docx", "xlsx": "xlsx", "pptx": "pptx", "doc": "doc", "xls": "xls", "ppt": "ppt", "png": "png",
    "jpg": "jpeg", "jpeg": "jpeg", "tif": "tiff", "tiff": "tiff", "txt": "text", "json": "json", "xml": "xml", "csv": "csv",
    "md": "markdown", "log": "log", "html": "html", "htm": "html", "eml": "eml", "msg": "msg", "mbox": "mbox", "vcf": "vcf",
    "vcard": "vcf", "ics": "ics", "zip": "zip", "tar": "tar", "gz": "gzip", "gzip": "gzip", "tgz": "gzip",
}
#: The formats that can be looked up by MIME type (fixed values).
BY_MIME = ("pdf", "docx", "xlsx", "pptx", "png", "jpeg", "tiff", "html")
#: Display names of families that differ from their key.
FAMILY_NAMES = {"Cad": "CAD"}
#: Service parsers in registration order: parser, format (fixed values). Of one MIME type the last one stays.
PARSERS = (
    ("PdfParser", "pdf"), ("PngParser", "png"), ("JpegParser", "jpeg"), ("TiffParser", "tiff"), ("DocxParser", "docx"),
    ("PptxParser", "pptx"), ("XlsxParser", "xlsx"), ("DocParser", "doc"), ("PptParser", "ppt"), ("XlsParser", "xls"),
    ("TextParser", "text"), ("HtmlParser", "html"), ("JsonParser", "json"), ("XmlParser", "xml"), ("CsvParser", "csv"),
    ("MarkdownParser", "markdown"), ("LogParser", "log"), ("EmlParser", "eml"), ("MsgParser", "msg"), ("MboxParser", "mbox"),
    ("VcfParser", "vcf"), ("IcsParser", "ics"),
)
#: The library's own registry starts with these instead.
ARCHIVE_PARSERS = (("ZipParser", "zip"), ("TarParser", "tar"), ("GzipParser", "gzip"))
#: What the formats' parsers can do, by feature; text and metadata are what most do (fixed values).
PARSER_FEATURES = ("TextExtraction", "ImageExtraction", "TableExtraction", "StructureExtraction", "MetadataExtraction", "EncryptionSupport", "StreamingSupport")
IMAGE_FORMATS, TABLE_FORMATS, TEXTLESS_FORMATS = ("png", "jpeg", "tiff"), ("xlsx", "xls", "zip", "tar", "gzip"), ("pdf", "png", "jpeg", "tiff", "zip", "tar", "gzip")
#: What the renderer can do, of these (fixed values).
RENDER_FEATURES = ("TextRendering", "ImageRendering", "TableRendering", "VectorRendering", "PageRangeSupport", "StreamingSupport")
RENDERED = ("TextRendering", "ImageRendering", "TableRendering")
FORMAT_COLUMNS = "format string, mime_type string, extension string, family string, name string, is_container boolean"


def formats(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in FORMATS.items()], FORMAT_COLUMNS)


def extensions(spark: SparkSession) -> DataFrame:
    """One row for each known extension with its format's columns."""
    return spark.createDataFrame([(e, k, *FORMATS[k]) for e, k in EXTENSIONS.items()], f"ext string, {FORMAT_COLUMNS}")


def registrations(spark: SparkSession, parsers=PARSERS) -> DataFrame:
    return spark.createDataFrame([(i, p, FORMATS[k][0]) for i, (p, k) in enumerate(parsers)], "ordinal int, parser string, mime_type string")


def can(key: str) -> tuple[str, ...]:
    """The features of a format's parser."""
    able = {"TextExtraction": key not in TEXTLESS_FORMATS, "ImageExtraction": key in IMAGE_FORMATS, "TableExtraction": key in TABLE_FORMATS, "MetadataExtraction": True}
    return tuple(f for f in PARSER_FEATURES if able.get(f))


def capabilities(spark: SparkSession, parsers=PARSERS + ARCHIVE_PARSERS) -> DataFrame:
    """One row for each parser, and one for the renderer: name, role, mime_type, features, requires_sandbox."""
    rows = [(p, "parser", FORMATS[k][0], list(can(k)), False) for p, k in parsers]
    return spark.createDataFrame([*rows, ("HtmlRenderer", "renderer", FORMATS["html"][0], list(RENDERED), False)], "name string, role string, mime_type string, features array<string>, requires_sandbox boolean")
