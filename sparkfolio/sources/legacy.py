"""Binary Word, Excel and PowerPoint files: streams of a compound file, as far as plain text goes."""

from __future__ import annotations

import re
import struct

from .compound import CompoundFile
from .office import number_text
from .udm import ParseError, document, page, run, text_block

_PRINTABLE = re.compile(rb"[\t\n\r\x20-\x7e]{4,}")
NOTHING = "Unable to extract text from {} file. Legacy format requires full parser."
_ERROR = {0x00: "#NULL!", 0x07: "#DIV/0!", 0x0F: "#VALUE!", 0x17: "#REF!", 0x1D: "#NAME?", 0x24: "#NUM!", 0x2A: "#N/A"}


def printable_text(data: bytes) -> str:
    """Runs of four or more printable ASCII bytes, single-spaced."""
    return " ".join(b" ".join(_PRINTABLE.findall(data)).decode("ascii").split())


def _scraped(data: bytes, streams: tuple[str, ...], kind: str, label: str | None, name: str | None) -> dict:
    file = CompoundFile(data)
    parts = [t for s in streams if (raw := file.stream(s)) is not None and (t := printable_text(raw))] or [NOTHING.format(kind)]
    return document([page(1, [text_block([run(t)]) for t in parts], label=label)], {"format": kind, "legacy_format": True}, title=name)


def parse_doc(data: bytes, name: str | None = None) -> dict:
    return _scraped(data, ("WordDocument", "0Table", "1Table"), "DOC", None, name)


def parse_ppt(data: bytes, name: str | None = None) -> dict:
    return _scraped(data, ("PowerPoint Document",), "PPT", "Slide 1", name)


def _records(data: bytes, at: int = 0):
    while at + 4 <= len(data):
        kind, size = struct.unpack_from("<HH", data, at)
        yield at, kind, data[at + 4 : at + 4 + size]
        at += 4 + size


def _string(raw: bytes, at: int, wide: bool) -> str:
    """A string with a length of one or two bytes and a flag byte, uncompressed or Latin."""
    n = struct.unpack_from("<H" if wide else "<B", raw, at)[0]
    at += 2 if wide else 1
    flags = raw[at] if at < len(raw) else 0
    at += 1
    return raw[at : at + 2 * n].decode("utf-16-le", "replace") if flags & 1 else raw[at : at + n].decode("latin-1")


def _shared(chunks: list[bytes]) -> list[str]:
    """Strings of the shared table, which may go on in the next record, even within a string."""
    out: list[str] = []
    total = struct.unpack_from("<I", chunks[0], 4)[0]
    part, at = 0, 8
    try:
        while len(out) < total:
            if at >= len(chunks[part]):
                part, at = part + 1, 0
            n, flags = struct.unpack_from("<HB", chunks[part], at)
            at += 3
            rich = struct.unpack_from("<H", chunks[part], at)[0] if flags & 8 else 0
            at += 2 * bool(flags & 8)
            extra = struct.unpack_from("<I", chunks[part], at)[0] if flags & 4 else 0
            at += 4 * bool(flags & 4)
            text, wide = "", flags & 1
            while n:
                if at >= len(chunks[part]):
                    part, at = part + 1, 1
                    wide = chunks[part][0] & 1
                take = min(n, (len(chunks[part]) - at) // (2 if wide else 1))
                raw = chunks[part][at : at + take * (2 if wide else 1)]
                text += raw.decode("utf-16-le" if wide else "latin-1", "replace")
                at, n = at + len(raw), n - take
            skip = 4 * rich + extra
            while skip > len(chunks[part]) - at and part + 1 < len(chunks):
                skip -= len(chunks[part]) - at
                part, at = part + 1, 0
            at += skip
            out.append(text)
    except (struct.error, IndexError):
        pass
    return out


def _rk(raw: int) -> float:
    x = float(struct.unpack("<i", struct.pack("<I", raw))[0] >> 2) if raw & 2 else struct.unpack("<d", struct.pack("<Q", (raw & 0xFFFFFFFC) << 32))[0]
    return x / 100 if raw & 1 else x


def _sheet(data: bytes, at: int, strings: list[str]) -> dict[tuple[int, int], str]:
    cells: dict[tuple[int, int], str] = {}
    pending = None
    for _, kind, raw in _records(data, at):
        if kind == 0x000A:
            break
        if kind == 0x0207 and pending:
            cells[pending] = _string(raw, 0, True)
        if kind not in (0x00FD, 0x0203, 0x027E, 0x00BD, 0x0204, 0x0205, 0x0006):
            continue
        row, column = struct.unpack_from("<HH", raw)
        if kind == 0x00FD:
            i = struct.unpack_from("<I", raw, 6)[0]
            cells[row, column] = strings[i] if i < len(strings) else ""
        elif kind == 0x0203:
            cells[row, column] = number_text(struct.unpack_from("<d", raw, 6)[0])
        elif kind == 0x027E:
            cells[row, column] = number_text(_rk(struct.unpack_from("<I", raw, 6)[0]))
        elif kind == 0x00BD:
            for k in range((len(raw) - 6) // 6):
                cells[row, column + k] = number_text(_rk(struct.unpack_from("<I", raw, 6 + 6 * k)[0]))
        elif kind == 0x0204:
            cells[row, column] = _string(raw, 6, True)
        elif kind == 0x0205:
            cells[row, column] = _ERROR.get(raw[6], "#ERR") if raw[7] else str(bool(raw[6])).lower()
        elif raw[12:14] != b"\xff\xff":
            cells[row, column] = number_text(struct.unpack_from("<d", raw, 6)[0])
        else:
            pending = (row, column)
            if raw[6] in (1, 2):
                cells[row, column] = _ERROR.get(raw[8], "#ERR") if raw[6] == 2 else str(bool(raw[8])).lower()
    return cells


def parse_xls(data: bytes, name: str | None = None) -> dict:
    file = CompoundFile(data)
    book = file.stream("Workbook") or file.stream("Book")
    if book is None:
        raise ParseError("Failed to parse XLS: no workbook stream")
    sheets, chunks, last = [], [], None
    for _, kind, raw in _records(book):
        if kind == 0x0085:
            sheets.append((struct.unpack_from("<I", raw)[0], _string(raw, 6, False)))
        elif kind == 0x00FC or (kind == 0x003C and last in (0x00FC, 0x003C) and chunks):
            chunks.append(raw)
        elif kind == 0x000A:
            break
        last = kind
    strings = _shared(chunks) if chunks else []
    pages = []
    for i, (at, label) in enumerate(sheets, 1):
        cells = _sheet(book, at, strings)
        rows = []
        if cells:
            (top, left), (bottom, right) = ((f(r for r, _ in cells), f(k for _, k in cells)) for f in (min, max))
            rows = ["".join(cells.get((r, k), "") + "\t" for k in range(left, right + 1)) for r in range(top, bottom + 1)]
        pages.append(page(i, [text_block([run(r)]) for r in rows if r.strip()], label=label))
    pages = pages or [page(1, [])]
    return document(pages, {"format": "XLS", "legacy_format": True, "sheet_count": len(pages)}, title=name)
