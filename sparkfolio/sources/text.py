"""Text-family and HTML content: in Python for mixed files, and as expressions for tables of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkfolio.functions import text as T
from sparkfolio.schemas import WEB

from .udm import ParseError, document, page, run, text_block


def _string(data: bytes) -> str:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError as e:
        raise ParseError(f"Invalid UTF-8: {e}") from e


def parse_text(data: bytes, name: str | None = None) -> dict:
    """One page, one block, one run; counts as custom metadata (characters are bytes)."""
    text = _string(data)
    custom = {"file_extension": name.rsplit(".", 1)[-1]} if name else {}
    custom |= {"character_count": len(data), "line_count": text.count("\n")}
    return document([page(1, [text_block([run(text)])])], custom, title=name)


def html_title(text: str) -> str | None:
    start = text.find("<title>")
    end = text.find("</title>", start)
    return text[start + 7 : end].strip() if 0 <= start < end else None


def parse_html(data: bytes, name: str | None = None) -> dict:
    """The markup itself is the text."""
    text = _string(data)
    title = html_title(text)
    return document([page(1, [text_block([run(text)])], WEB)], {}, title=name if title is None else title)


def stats(text: Column, name: Column) -> dict[str, Column]:
    """Columns of the text parser's metadata."""
    return {"title": name, "file_extension": T.file_extension(name), "character_count": T.byte_count(text), "line_count": T.line_feeds(text), "word_count": T.word_count(text)}


def gate(content: Column) -> Column:
    return F.coalesce(T.is_likely_text(content), F.lit(False))
