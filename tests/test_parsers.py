"""Parsers of binary formats on small files, and what they do with broken ones."""

import struct

import numpy as np
import pytest

from sparkfolio.plans import fixtures as X
from sparkfolio.sources import archives, cards, images, mail, office
from sparkfolio.sources.compound import CompoundFile
from sparkfolio.sources.parse import parse_content
from sparkfolio.sources.formats import FORMATS
from sparkfolio.sources.udm import ParseError


def texts(document):
    return [["".join(r["text"] for r in b["runs"]) if b["kind"] == "Text" else b["kind"] for b in p["blocks"]] for p in document["pages"]]


def cells(block):
    return [[" ".join("".join(r["text"] for r in runs) for runs in c["content"]) for c in row] for row in block["rows"]]


def test_docx():
    d = office.parse_docx(X.docx(), "a.docx")
    first, table = d["pages"][0]["blocks"]
    assert [r["text"] for r in first["runs"]] == ["One & ", "two"] and first["paragraph_style"] == "Head"
    one, two = (r["style"] for r in first["runs"])
    assert one["bold"] and one["italic"] and not one["underline"] and one["color"] == "#FF0000"
    assert one["font_size"] == 15.0 and two["font_size"] == 15.0  # a self-closing size doesn't count, the named one does
    assert cells(table) == [["a b", ""]] and table["rows"][0][0]["col_span"] == 2
    assert d["metadata"]["title"] == "a.docx"


def test_docx_pages():
    body = "".join(f"<w:p><w:r><w:t>{i}</w:t></w:r></w:p>" for i in range(101))
    d = office.parse_docx(X.zipped({"word/document.xml": f"<w:document><w:body>{body}</w:body></w:document>"}))
    assert [len(p["blocks"]) for p in d["pages"]] == [50, 50, 1]
    assert len(office.parse_docx(X.zipped({"word/document.xml": "<w:document/>"}))["pages"]) == 1


def test_xlsx():
    d = office.parse_xlsx(X.xlsx(), "a.xlsx")
    assert [(p["number"], p["label"]) for p in d["pages"]] == [(1, "Data"), (3, "More")]
    assert cells(d["pages"][0]["blocks"][0]) == [["shared", "3"], ["", ""], ["true", "#Div0"]]
    assert cells(d["pages"][1]["blocks"][0]) == [["in<", "0.00000015"]]
    assert d["pages"][0]["blocks"][0]["bounds"] == {"x": 0.0, "y": 0.0, "width": 144.0, "height": 60.0}


def test_pptx():
    d = office.parse_pptx(X.pptx(), "a.pptx")
    assert [(p["number"], p["label"], p["width"]) for p in d["pages"]] == [(1, "Slide 1", 720.0), (3, "Slide 3", 720.0)]
    back = d["pages"][0]["blocks"][0]
    assert back["kind"] == "Image" and back["resource_id"] == "../media/i.png" and back["bounds"]["width"] == 720.0
    shape, picture, table = d["pages"][1]["blocks"]
    assert [r["text"] for r in shape["runs"]] == ["Title", "\n"] and shape["runs"][0]["style"]["font_size"] == 18.0 and shape["runs"][0]["style"]["bold"]
    assert shape["bounds"] == {"x": 1.0, "y": 2.0, "width": 0.0, "height": 0.0} and shape["rotation"] == 90.0
    assert (shape["fill_color"], shape["stroke_color"], shape["stroke_width"]) == ("00FF00", "0000FF", 2.0)
    assert picture["resource_id"] == "../media/i.png" and picture["alt_text"] == "a &quot;b&quot;" and picture["format"] == "image/png"
    assert cells(table) == [["cell\n"]]
    assert [(i["id"], i["width"], i["height"]) for i in d["images"]] == [("../media/i.png", 3, 2)]
    assert {k for k, _ in d["metadata"]["custom"]} == {"format", "slide_count", "theme_name", "theme_font_major"}


def test_images():
    d = images.parse_png(X.png(5, 4), "x.png")
    assert (d["pages"][0]["width"], d["pages"][0]["height"], len(d["images"])) == (5.0, 4.0, 1)
    d = images.parse_tiff(X.tiff([(2, 2, b"\0\x40\x80\xff"), (1, 1, b"\x10")]))
    assert [i["id"] for i in d["images"]] == ["img_page_1", "img_page_2"]
    assert images.png_size(d["images"][0]["data"]) == (2, 2)
    kinds = {np.uint16: (0x12FF, 0x12), np.uint32: (0xAB000000, 0xAB), np.int8: (0, 128), np.int16: (-32768, 128), np.float32: (2.0, 255)}
    for kind, (value, want) in kinds.items():
        assert images.to_byte(np.array([value], dtype=kind))[0] == want
    with pytest.raises(ParseError):
        images.parse_png(b"\x89PNG\r\n\x1a\n")


def test_mail():
    d = mail.parse_eml(b"From: Ann <a@b.c>\r\nTo: x@y.z, Bob <b@b.c>\r\nSubject: =?utf-8?q?H=C3=A9?=\r\nDate: Mon, 01 Jan 2024 10:00:00 +0200\r\n\r\nBody\r\n")
    assert texts(d) == [["From: Ann <a@b.c>\nSent: 2024-01-01T10:00:00+02:00\nTo: x@y.z, Bob <b@b.c>\nSubject: Hé\n\nBody\r\n"]]
    assert d["metadata"]["author"] == "Ann" and d["metadata"]["created"].hour == 8
    html = mail.parse_eml(b"From: a@b.c\nSubject: s\nContent-Type: text/html\n\n<b>x</b>")
    assert texts(html)[0][0].endswith("<b>x</b>")
    assert texts(mail.parse_mbox(b"From x\nFrom: a@b.c\n\none\nFrom y\nTo: z@b.c\n\ntwo\n")) == [["From: a@b.c\n\none"], ["To: z@b.c\n\ntwo\n"]]
    with pytest.raises(ParseError):
        mail.parse_mbox(b"nothing here")
    d = mail.parse_msg(X.msg())
    assert texts(d) == [["From: Ann\nTo: Bob\nSubject: Hi\n\nBody text"]] and d["attachments"][0]["filename"] == "a.txt" and d["attachments"][0]["data"].startswith(b"data")


def test_cards():
    card = b"BEGIN:VCARD\r\nFN;X=\"a:b\":Ann\r\nTEL:1\r\nADR:;;Street 1;Town;;;\r\nADR:;;\r\nNOTE:a\r\n b\r\nEND:VCARD\r\n"
    assert texts(cards.parse_vcf(card)) == [["Name: Ann\nPhone: 1\nAddress: Street 1, Town\n\nNote:\nab\n"]]
    cal = b"BEGIN:VCALENDAR\nX-WR-CALNAME:Cal\nBEGIN:VEVENT\nSUMMARY:S\nDTSTART:1\nEND:VEVENT\nBEGIN:VEVENT\nLOCATION:L\nEND:VEVENT\nEND:VCALENDAR"
    d = cards.parse_ics(cal)
    assert texts(d) == [["Event: S\nStart: 1\n\n---\n\nLocation: L\n\n---\n\n"]] and d["metadata"]["title"] == "Cal"


def test_archives():
    d = archives.parse_zip(X.zipped({"d/": b"", "d/x.txt": b"x" * 2000}))
    rows = cells(d["pages"][0]["blocks"][0])
    assert rows[0] == ["Path", "Size", "Compressed", "Modified"] and rows[2][0::3] == ["d/x.txt", "2024-3-5 7:8:10"] and rows[2][1] == "2.0 KB"
    assert cells(archives.parse_tar(X.tar())["pages"][0]["blocks"][0])[1] == ["hello.txt", "11 B", "1970-01-02 00:00:00"]
    import gzip

    facts = dict(cells(archives.parse_gzip(gzip.compress(b""))["pages"][0]["blocks"][0])[1:])
    assert facts["Decompressed Size"] == "0 B" and facts["Ratio"] == "inf%"
    assert len(cells(archives.parse_gzip(gzip.compress(X.tar()))["pages"][0]["blocks"][0])) == 2


def test_compound_and_workbook():
    big = bytes(range(256)) * 40
    file = CompoundFile(X.compound({"Big": big, "folder/leaf": b"x" * 4096}))
    assert file.stream("big") == big and file.has_storage("folder") and file.stream("folder/leaf") == b"x" * 4096
    d = parse_content(FORMATS["xls"][0], X.compound({"Workbook": X.workbook_stream()}), "a.xls")
    assert texts(d) == [["name\tvalue\t", "2.5\t7\t", "true\t\t"]] and d["pages"][0]["label"] == "Data"


def test_broken_content_is_an_error_row():
    for name, key, data in X.packages():
        d = parse_content(FORMATS[key][0], data, name)
        assert (d["error"] is not None) == name.startswith("bad"), (name, d["error"])
        for cut in range(0, len(data), max(1, len(data) // 23)):
            parse_content(FORMATS[key][0], data[:cut], name, gated=False)
    assert struct.calcsize("<I") == 4


def test_style_sheets():
    sheet = office.parse("<styleSheet><fonts><font><b/><sz val='11'/><name val='A'/><color rgb='FF112233'/></font></fonts><fills><fill><patternFill><fgColor rgb='FFAABBCC'/></patternFill></fill></fills><cellXfs><xf numFmtId='14' fontId='0' fillId='0'/></cellXfs></styleSheet>")
    got = office.cell_styles(sheet)
    assert got["fonts"][0]["bold"] and got["fonts"][0]["size"] == 11.0 and got["fonts"][0]["color"] == "#112233" and got["fills"] == [{"color": "#AABBCC"}]
    assert got["formats"] == [{"font": 0, "fill": 0, "number_format": 14}]
    theme = office.parse("<a:theme><a:clrScheme><a:dk1><a:srgbClr val='000000'></a:srgbClr></a:dk1><a:lt1><a:srgbClr val='FFFFFF'/></a:lt1></a:clrScheme></a:theme>")
    assert office.theme_colours(theme) == {"dk1": "000000"}
