"""Binary content to the unified model, by MIME type, one Arrow batch at a time."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from sparkfolio.schemas import DOCUMENT
from sparkfolio.shipping import ship

from . import archives, cards, compound, images, legacy, mail, office, pdf, text
from .formats import FORMATS
from .udm import ParseError, failed

#: Parser of each format key.
PARSERS: dict[str, Callable[[bytes, str | None], dict]] = {
    "pdf": pdf.parse_pdf, "docx": office.parse_docx, "xlsx": office.parse_xlsx, "pptx": office.parse_pptx,
    "png": images.parse_png, "jpeg": images.parse_jpeg, "tiff": images.parse_tiff,
    "text": text.parse_text, "json": text.parse_text, "xml": text.parse_text, "csv": text.parse_text, "markdown": text.parse_text, "log": text.parse_text,
    "html": text.parse_html, "doc": legacy.parse_doc, "xls": legacy.parse_xls, "ppt": legacy.parse_ppt,
    "eml": mail.parse_eml, "msg": mail.parse_msg, "mbox": mail.parse_mbox, "vcf": cards.parse_vcf, "ics": cards.parse_ics,
    "zip": archives.parse_zip, "tar": archives.parse_tar, "gzip": archives.parse_gzip,
}
#: Gates that need a container's directory; the others are expressions (operators.registry).
CONTAINER_GATES: dict[str, Callable[[bytes], bool]] = {
    "docx": lambda d: office.holds_part(d, "word/document.xml"),
    "pptx": lambda d: office.holds_part(d, "ppt/presentation.xml"),
    "doc": lambda d: compound.holds_stream(d, "WordDocument"),
    "xls": lambda d: compound.holds_stream(d, "Workbook", "Book"),
    "ppt": lambda d: compound.holds_stream(d, "PowerPoint Document"),
}
#: Error kind of content that its parser's gate refuses.
REFUSED = "UnsupportedFormat"
_BY_MIME = {FORMATS[k][0]: k for k in PARSERS}


Parser = Callable[[bytes, str | None], dict]


def parse_content(mime: str | None, data: bytes, name: str | None, gated: bool = True, own: dict[str, Parser] | None = None) -> dict:
    key = _BY_MIME.get(mime)
    parser = (own or {}).get(mime) or PARSERS.get(key)
    if parser is None or (gated and key in CONTAINER_GATES and mime not in (own or {}) and not CONTAINER_GATES[key](data)):
        return failed(f"No parser for {mime}", REFUSED)
    try:
        return parser(data, name)
    except ParseError as e:
        return failed(str(e))
    except (ValueError, KeyError, IndexError, TypeError, OverflowError, RecursionError, OSError, EOFError, struct.error) as e:
        return failed(f"{type(e).__name__}: {e}", "Corrupted")


def parse_files(files: DataFrame, gated: bool = True, own: dict[str, Parser] | None = None, wanted: str | None = None, keep_content: bool = True) -> DataFrame:
    """files (name, content, mime_type and more) with the column `document`; a row that fails carries its error.
    own: further parsers by MIME type, functions of content and name that return what udm.document makes; of one type the
    one given here wins. wanted: a boolean column; where it is false nothing is parsed and the document is null.
    keep_content: whether the content comes back."""
    ship(files.sparkSession)
    kind = to_arrow_type(_parse_datatype_string(DOCUMENT))
    columns = [c for c in files.columns if keep_content or c != "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 16):  # rendered content may be large
                batch = whole.slice(at, 16)
                which = batch.column(wanted).to_pylist() if wanted else [True] * batch.num_rows
                rows = zip(which, batch.column("mime_type").to_pylist(), batch.column("content").to_pylist(), batch.column("name").to_pylist())
                documents = [parse_content(m, c or b"", n, gated, own) if w else None for w, m, c, n in rows]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(documents, type=kind)], [*columns, "document"])

    schema = files.select(*columns, F.lit(None).cast(DOCUMENT).alias("document")).schema
    return files.mapInArrow(run, schema)
