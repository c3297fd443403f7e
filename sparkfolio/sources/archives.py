"""Listings of ZIP, TAR and GZIP content as one table block."""

from __future__ import annotations

import datetime
import gzip
import io
import tarfile
import zipfile
import zlib

from .udm import ParseError, block, cell, document, page, rect, run

#: Colour of heading cells, and the wording of listings below: headings, property names and sizes (fixed values).
_HEAD = "#CCCCCC"
#: Bytes that a GZIP file may unpack to; beyond that the file's row is an error, so a worker's memory stays bounded.
MOST = 1 << 30
#: Seconds of 400 years of the calendar, and the last year that a listing shows (fixed values).
_CYCLE, _LAST_YEAR = 146_097 * 86_400, 262_142


def size_text(n: int) -> str:
    return f"{n} B" if n < 1024 else f"{n / 1024:.1f} KB" if n < 1024**2 else f"{n / 1024**2:.1f} MB"


def _listing(head: list[str], rows: list[list[str]], height: float | None = None) -> dict:
    table = [[cell([[run(t, bold=True)]], _HEAD) for t in head]] + [[cell([[run(t)]]) for t in r] for r in rows]
    return document([page(1, [block("Table", rect(50.0, 50.0, 500.0, len(table) * 20.0 if height is None else height), rows=table)])])


def parse_zip(data: bytes, name: str | None = None) -> dict:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            entries = z.infolist()
    except (zipfile.BadZipFile, ValueError, OSError) as e:
        raise ParseError(str(e)) from e
    dates = ["{}-{}-{} {}:{}:{}".format(*i.date_time) for i in entries]
    return _listing(["Path", "Size", "Compressed", "Modified"], [[i.filename, size_text(i.file_size), size_text(i.compress_size), d] for i, d in zip(entries, dates)])


def _moment(seconds: float) -> str:
    """datetime ends at year 9999, so whole cycles of 400 years are counted apart."""
    try:
        cycles, rest = divmod(int(seconds), _CYCLE)
    except (OverflowError, ValueError):
        return "-"
    d = datetime.datetime.fromtimestamp(rest, datetime.timezone.utc)
    year = d.year + 400 * cycles
    return f"{year:04d}-{d:%m-%d %H:%M:%S}" if abs(year) <= _LAST_YEAR else "-"


def parse_tar(data: bytes, name: str | None = None) -> dict:
    try:
        with tarfile.open(fileobj=io.BytesIO(data), mode="r:") as t:
            rows = [[m.name + ("/" if m.isdir() else ""), size_text(m.size), _moment(m.mtime)] for m in t]
    except tarfile.TarError as e:
        raise ParseError(str(e)) from e
    return _listing(["Path", "Size", "Modified"], rows)


def is_tar(data: bytes) -> bool:
    return len(data) >= 512 and data[257:263] in (b"ustar\0", b"ustar ")


def parse_gzip(data: bytes, name: str | None = None) -> dict:
    try:
        with gzip.GzipFile(fileobj=io.BytesIO(data)) as f:
            plain = f.read(MOST + 1)
    except (OSError, EOFError, zlib.error) as e:
        raise ParseError(f"Gzip decompression failed: {e}") from e
    if len(plain) > MOST:
        raise ParseError(f"Gzip decompression failed: more than {MOST} bytes")
    if is_tar(plain):
        return parse_tar(plain, name)
    ratio = f"{len(data) / len(plain) * 100:.1f}%" if plain else "inf%"
    facts = {"Type": "GZIP Compressed File", "Original Size": size_text(len(data)), "Decompressed Size": size_text(len(plain)), "Ratio": ratio}
    out = _listing(["Properties", "Value"], [list(x) for x in facts.items()], 200.0)
    return out
