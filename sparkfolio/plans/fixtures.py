"""Small files of every format, built here; used by queries that need binary content."""

from __future__ import annotations

import gzip
import io
import struct
import tarfile
import zipfile
import zlib

from sparkfolio.schemas import IMAGE

NO_IMAGES = f"array<{IMAGE}>"
_CFB = bytes.fromhex("D0CF11E0A1B11AE1")
_ZIP = b"PK\x03\x04"
_TYPES = b"[Content_Types].xml"
#: name, content, format found, confidence, method.
MAGIC = (
    ("a.pdf", b"%PDF-1.4 test", "pdf", 0.99, "MagicBytes"),
    ("wrong.txt", b"\x89PNG\r\n\x1a\n\0\0", "png", 0.99, "MagicBytes"),
    ("jpeg", b"\xff\xd8\xff\xe0", "jpeg", 0.99, "MagicBytes"),
    ("tar", b"\0" * 257 + b"ustar", "tar", 0.99, "MagicBytes"),
    ("gz", b"\x1f\x8b\x08", "gzip", 0.99, "MagicBytes"),
    ("gif7", b"GIF87a", "gif", 0.99, "MagicBytes"),
    ("gif9", b"GIF89a", "gif", 0.99, "MagicBytes"),
    ("tif1", b"II*\0", "tiff", 0.99, "MagicBytes"),
    ("tif2", b"MM\0*", "tiff", 0.99, "MagicBytes"),
    ("rar", b"Rar!\x1a\x07\0", "rar", 0.99, "MagicBytes"),
    ("7z", b"7z\xbc\xaf\x27\x1c", "7z", 0.99, "MagicBytes"),
    ("zip", _ZIP + b"word/document.xml", "zip", 0.99, "MagicBytes"),
    ("docx", _ZIP + _TYPES + b"word/document.xml", "docx", 0.95, "ContainerInspection"),
    ("xlsx", _ZIP + _TYPES + b"xl/worksheets/sheet1.xml word", "xlsx", 0.95, "ContainerInspection"),
    ("pptx", _ZIP + _TYPES + b"xl/worksheets ppt", "pptx", 0.95, "ContainerInspection"),
    ("cfb.bin", _CFB + b"\0" * 9, "cfb", 0.99, "MagicBytes"),
    ("old.MSG", _CFB + b"\0" * 9, "msg", 0.95, "ContainerInspection"),
    ("doc", _CFB + b"WordDocument Workbook", "doc", 0.95, "ContainerInspection"),
    ("xls", _CFB + b"Book", "xls", 0.95, "ContainerInspection"),
    ("ppt", _CFB + b"Current User", "ppt", 0.95, "ContainerInspection"),
    ("document.PDF", b"unknown", "pdf", 0.7, "Extension"),
    ("txt", b"no dot", "text", 0.7, "Extension"),
    ("nothing.xyz", b"random", None, None, None),
    ("empty", b"", None, None, None),
)


def zipped(parts: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in parts.items():
            z.writestr(zipfile.ZipInfo(name, (2024, 3, 5, 7, 8, 10)), content)
    return out.getvalue()


def png(w: int = 2, h: int = 1) -> bytes:
    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = b"".join(b"\0" + b"\x40" * w for _ in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def tiff(pages: list[tuple[int, int, bytes]]) -> bytes:
    """8-bit grey pages, uncompressed: width, height, samples."""
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for w, h, raw in pages:
        at = len(out)
        out += raw + b"\0" * (len(raw) % 2)
        struct.pack_into("<I", out, link, len(out))
        tags = ((256, w), (257, h), (258, 8), (259, 1), (262, 1), (273, at), (277, 1), (278, h), (279, len(raw)))
        out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in tags)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def compound(streams: dict[str, bytes]) -> bytes:
    """A compound file with 512-byte sectors whose streams all are in whole sectors; names with a slash make a folder."""
    sectors: list[bytes] = []
    fat: list[int] = []

    def put(data: bytes) -> int:
        parts = [data[i : i + 512].ljust(512, b"\0") for i in range(0, len(data), 512)]
        start = len(sectors)
        sectors.extend(parts)
        fat.extend([*range(start + 1, start + len(parts)), 0xFFFFFFFE])
        return start

    folders = sorted({n.split("/")[0] for n in streams if "/" in n})
    entries = [["Root Entry", 5, 0xFFFFFFFF, 0xFFFFFFFE, 0]]
    index = {}
    for f in folders:
        index[f] = len(entries)
        entries.append([f, 1, 0xFFFFFFFF, 0, 0])
    members: dict[int, list[int]] = {0: list(index.values())}
    for name, data in streams.items():
        folder, _, leaf = name.rpartition("/")
        members.setdefault(index.get(folder, 0), []).append(len(entries))
        size = max(len(data), 4096)
        entries.append([leaf, 2, 0xFFFFFFFF, put(data.ljust(size, b"\0")), len(data) if len(data) >= 4096 else size])
    right = {}
    for parent, kids in members.items():
        if kids:
            entries[parent][2] = kids[0]
            right |= dict(zip(kids, kids[1:]))
    raw = b""
    for i, (name, kind, child, start, size) in enumerate(entries):
        wide = name.encode("utf-16-le") + b"\0\0"
        raw += wide.ljust(64, b"\0") + struct.pack("<HBB", len(wide), kind, 1) + struct.pack("<3I", 0xFFFFFFFF, right.get(i, 0xFFFFFFFF), child) + b"\0" * 36 + struct.pack("<IQ", start, size)
    directory = put(raw.ljust(-(-len(raw) // 512) * 512, b"\0"))
    need = 1
    while need * 128 < len(fat) + need:
        need += 1
    first = len(sectors)
    table = fat + [0xFFFFFFFD] * need
    table += [0xFFFFFFFF] * (need * 128 - len(table))
    head = _CFB + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 6 + struct.pack("<8I", 0, need, directory, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE)[4:]
    head = head[:44] + struct.pack("<8I", need, directory, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    head += struct.pack("<109I", *range(first, first + need), *[0xFFFFFFFF] * (109 - need))
    return head + b"".join(sectors) + struct.pack(f"<{len(table)}I", *table)


def workbook_stream() -> bytes:
    """A BIFF8 stream with one sheet: strings, a number, a packed number and a truth value."""

    def record(kind: int, body: bytes = b"") -> bytes:
        return struct.pack("<HH", kind, len(body)) + body

    def text(s: str) -> bytes:
        return struct.pack("<HB", len(s), 0) + s.encode("latin-1")

    strings = record(0x00FC, struct.pack("<II", 2, 2) + text("name") + text("value"))
    end = record(0x000A)
    begin = record(0x0809, struct.pack("<HH", 0x600, 5) + b"\0" * 12)
    sheet_name = b"Data"
    head_size = len(begin) + 4 + 6 + 2 + len(sheet_name) + len(strings) + len(end)
    head = begin + record(0x0085, struct.pack("<IH", head_size, 0) + struct.pack("<BB", len(sheet_name), 0) + sheet_name) + strings + end
    cells = b"".join(record(0x00FD, struct.pack("<HHHI", 0, c, 0, c)) for c in (0, 1))
    cells += record(0x0203, struct.pack("<HHHd", 1, 0, 0, 2.5)) + record(0x027E, struct.pack("<HHHI", 1, 1, 0, (7 << 2) | 2)) + record(0x0205, struct.pack("<HHHBB", 3, 0, 0, 1, 0))
    return head + begin + cells + end


_W = 'xmlns:w="urn:w"'
_RELATION = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/"


def docx() -> bytes:
    paragraph = "<w:p><w:pPr><w:pStyle w:val='Head'/></w:pPr><w:r><w:rPr><w:b/><w:sz w:val='40'/><w:color w:val='FF0000'></w:color></w:rPr><w:t>One &amp; </w:t></w:r><w:r><w:t>two</w:t></w:r></w:p>"
    table = "<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val='2'></w:gridSpan></w:tcPr><w:p><w:r><w:t>a</w:t><w:t>b</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl>"
    styles = f"<w:styles {_W}><w:style w:type='paragraph' w:styleId='Head'><w:name w:val='heading'/><w:rPr><w:i/><w:u/><w:sz w:val='30'></w:sz></w:rPr></w:style></w:styles>"
    return zipped({"[Content_Types].xml": "<Types/>", "word/document.xml": f"<?xml version='1.0'?><w:document {_W}><w:body>{paragraph}<w:p/>{table}</w:body></w:document>", "word/styles.xml": styles})


def xlsx() -> bytes:
    relations = f"<Relationships><Relationship Id='r1' Type='{_RELATION}worksheet' Target='worksheets/sheet1.xml'/><Relationship Id='r2' Type='{_RELATION}worksheet' Target='worksheets/sheet2.xml'/><Relationship Id='r3' Type='{_RELATION}worksheet' Target='/xl/worksheets/sheet3.xml'/></Relationships>"
    book = "<workbook><sheets><sheet name='Data' sheetId='1' r:id='r1'/><sheet name='Empty' sheetId='2' r:id='r2'/><sheet name='More' sheetId='3' r:id='r3'/></sheets></workbook>"
    one = "<worksheet><sheetData><row r='1'><c r='A1' t='s'><v>0</v></c><c r='B1'><v>3</v></c></row><row r='3'><c r='A3' t='b'><v>1</v></c><c r='B3' t='e'><v>#DIV/0!</v></c></row></sheetData></worksheet>"
    three = "<worksheet><sheetData><row r='2'><c r='C2' t='inlineStr'><is><t>in&lt;</t></is></c><c r='D2'><v>1.5E-7</v></c></row></sheetData></worksheet>"
    return zipped({"[Content_Types].xml": "<Types/>", "xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": relations, "xl/sharedStrings.xml": "<sst><si><t>sha</t><r><t>red</t></r></si></sst>", "xl/worksheets/sheet1.xml": one, "xl/worksheets/sheet2.xml": "<worksheet><sheetData/></worksheet>", "xl/worksheets/sheet3.xml": three})


def pptx() -> bytes:
    show = "<p:presentation><p:sldSz cx='9144000' cy='6858000'/><p:sldIdLst><p:sldId id='1' r:id='r2'/><p:sldId id='2' r:id='r9'/><p:sldId id='3' r:id='r1'/></p:sldIdLst></p:presentation>"
    relations = f"<Relationships><Relationship Id='r1' Type='{_RELATION}slide' Target='slides/slide1.xml'/><Relationship Id='r2' Type='{_RELATION}slide' Target='slides/slide2.xml'/><Relationship Id='r3' Type='{_RELATION}theme' Target='theme/theme1.xml'/></Relationships>"
    text = "<p:sp><p:spPr><a:xfrm rot='5400000'><a:off x='12700' y='25400'></a:off><a:ext cx='127000' cy='127000'></a:ext></a:xfrm><a:solidFill><a:srgbClr val='00FF00'/></a:solidFill><a:ln w='25400'><a:srgbClr val='0000FF'/></a:ln></p:spPr><p:txBody><a:p><a:r><a:rPr sz='1800' b='1'></a:rPr><a:t> Title </a:t></a:r></a:p></p:txBody></p:sp>"
    picture = "<p:pic><p:nvPicPr><p:cNvPr descr='a &quot;b&quot;'></p:cNvPr></p:nvPicPr><p:blipFill><a:blip r:embed='r5'></a:blip></p:blipFill></p:pic>"
    table = "<p:graphicFrame><a:tbl><a:tr><a:tc><a:txBody><a:p><a:r><a:t>cell</a:t></a:r></a:p></a:txBody></a:tc></a:tr></a:tbl></p:graphicFrame>"
    slides = {
        "ppt/slides/slide1.xml": f"<p:sld><p:cSld><p:spTree>{text}{picture}{table}</p:spTree></p:cSld></p:sld>",
        "ppt/slides/slide2.xml": "<p:sld><p:cSld><p:bg><a:blip r:embed='r5'/></p:bg></p:cSld></p:sld>",
    }
    images = f"<Relationships><Relationship Id='r5' Type='{_RELATION}image' Target='../media/i.png'/></Relationships>"
    theme = "<a:theme name='Plain'><a:majorFont><a:latin typeface='Serif'></a:latin></a:majorFont><a:minorFont><a:latin typeface='Sans'/></a:minorFont></a:theme>"
    return zipped({"[Content_Types].xml": "<Types/>", "ppt/presentation.xml": show, "ppt/_rels/presentation.xml.rels": relations, "ppt/theme/theme1.xml": theme, "ppt/media/i.png": png(3, 2), "ppt/slides/_rels/slide1.xml.rels": images, "ppt/slides/_rels/slide2.xml.rels": images, **slides})


def msg() -> bytes:
    wide = lambda s: s.encode("utf-16-le")
    return compound({"__substg1.0_0C1A001F": wide("Ann"), "__substg1.0_0E04001F": wide("Bob"), "__substg1.0_0037001F": wide("Hi"), "__substg1.0_1000001F": wide("Body text"), "__attach_version1.0_00000000/__substg1.0_3707001F": wide("a.txt"), "__attach_version1.0_00000000/__substg1.0_37010102": b"data"})


def tar(names: tuple[str, ...] = ("hello.txt",)) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as t:
        for n in names:
            info = tarfile.TarInfo(n)
            info.size, info.mtime = 11, 86400
            t.addfile(info, io.BytesIO(b"Hello World"))
    return out.getvalue()


def packages() -> list[tuple[str, str, bytes]]:
    """name, format, content."""
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08\x00\x05\x00\x07\x01\x01\x11\x00\xff\xd9"
    mail = b"From x\nFrom: a@b.c\nSubject: s\n\nfirst\nFrom y\nTo: z@b.c\n\nsecond\n"
    return [
        ("a.docx", "docx", docx()), ("a.xlsx", "xlsx", xlsx()), ("a.pptx", "pptx", pptx()), ("a.png", "png", png()), ("a.jpg", "jpeg", jpeg),
        ("a.tif", "tiff", tiff([(2, 2, b"\0\x40\x80\xff"), (1, 1, b"\x10")])), ("a.pdf", "pdf", b"%PDF-1.4\n1 0 obj <</Type /Pages /Count 2>>\n2 0 obj <</Type /Page>> 3 0 obj <</Type/Page>>\ntrailer <</Info <</Title (T\\)x) /Author (Me)>> >>"),
        ("a.doc", "doc", compound({"WordDocument": b"\0\x01Hello\0World wide\x02ab\0", "1Table": b"more text\0"})), ("a.ppt", "ppt", compound({"PowerPoint Document": b"\x01\x02\x03"})), ("a.xls", "xls", compound({"Workbook": workbook_stream()})),
        ("a.msg", "msg", msg()), ("a.mbox", "mbox", mail), ("a.zip", "zip", zipped({"d/": b"", "d/x.txt": b"x" * 2000})), ("a.tar", "tar", tar()), ("a.gz", "gzip", gzip.compress(b"y" * 100, mtime=0)), ("a.tgz", "gzip", gzip.compress(tar(), mtime=0)),
        ("bad.docx", "docx", b"PK\x03\x04 no archive"), ("bad.png", "png", b"\x89PNG\r\n\x1a\n"), ("bad.mbox", "mbox", b"nothing"),
    ]
