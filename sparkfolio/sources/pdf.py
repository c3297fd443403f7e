"""PDF for a client-side viewer: the content embedded as base64, its page count and directly written metadata."""

from __future__ import annotations

import base64
import re
import zlib

from .udm import ParseError, document, page, run, text_block

MARKER = "__PDF_DATA__:"
_PAGE = re.compile(rb"/Type\s*/Page(?![A-Za-z])")
_COUNT = re.compile(rb"/Count\s+(\d+)")
_STREAM = re.compile(rb"stream\r?\n(.*?)endstream", re.S)


def page_count(data: bytes) -> int:
    """Page objects, also inside compressed object streams; 1 where none can be read, 0 where the tree says so."""
    plain = [data]
    for m in _STREAM.finditer(data):
        try:
            plain.append(zlib.decompressobj().decompress(m[1]))
        except zlib.error:
            continue
    found = sum(len(_PAGE.findall(p)) for p in plain)
    counts = [int(c) for p in plain for c in _COUNT.findall(p)]
    return found or max(counts, default=1)


def _direct_info(data: bytes) -> dict[str, str]:
    """Title and author, where the trailer holds the information dictionary itself."""
    info = re.search(rb"trailer.*?/Info\s*<<(.*?)>>", data, re.S)
    out = {}
    for key, raw in re.findall(rb"/(Title|Author)\s*\(((?:\\.|[^\\)])*)\)", info[1] if info else b"", re.S):
        try:
            out[key.decode().lower()] = re.sub(r"\\(.)", r"\1", raw.decode("utf-8"), flags=re.S)
        except UnicodeDecodeError:
            continue
    return out


def parse_pdf(data: bytes, name: str | None = None) -> dict:
    if not data.startswith(b"%PDF-"):
        raise ParseError("Invalid PDF signature")
    n = page_count(data)
    if n == 0:
        raise ParseError("PDF has no pages")
    info = _direct_info(data)
    text = MARKER + base64.b64encode(data).decode()
    return document([page(1, [text_block([run(text)])])], {"page_count": n}, title=info.get("title") or name, author=info.get("author"))
