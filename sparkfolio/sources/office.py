"""Word, Excel and PowerPoint packages.

Some properties only count where they are written with a separate end tag (see xml_tree): that is how the formats'
existing output is defined, and `self_closing` tells the two forms apart.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from decimal import Decimal

from sparkfolio.schemas import LETTER

from .images import any_size
from .udm import ParseError, block, cell, document, page, rect, run, style, text_block
from .xml_tree import Node, parse

PARAGRAPHS_PER_PAGE = 50
SLIDE = (960.0, 540.0)
EMU = 12700.0
_TYPE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/"
#: Error values of cells (fixed values).
ERRORS = {"#DIV/0!": "Div0", "#N/A": "NA", "#NAME?": "Name", "#NULL!": "Null", "#NUM!": "Num", "#REF!": "Ref", "#VALUE!": "Value", "#GETTING_DATA": "GettingData"}
#: Image types by the end of a part's name (fixed values).
IMAGE_TYPES = {".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".svg": "image/svg+xml"}


def number_text(x: float) -> str:
    """Shortest decimal form without exponent or trailing .0."""
    text = repr(float(x))
    if "e" in text:
        text = format(Decimal(text), "f")
    return text[:-2] if text.endswith(".0") else text


class Package:
    def __init__(self, data: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except (zipfile.BadZipFile, ValueError, OSError) as e:
            raise ParseError(f"Failed to open as ZIP: {e}") from e
        self.names = set(self.zip.namelist())

    def raw(self, part: str) -> bytes | None:
        try:
            return self.zip.read(part) if part in self.names else None
        except (zipfile.BadZipFile, ValueError, OSError, NotImplementedError, RuntimeError):
            return None

    def text(self, part: str) -> str | None:
        raw = self.raw(part)
        try:
            return None if raw is None else raw.decode("utf-8-sig")
        except UnicodeDecodeError:
            return None

    def tree(self, part: str) -> Node | None:
        text = self.text(part)
        return None if text is None else parse(text)

    def relations(self, part: str) -> dict[str, tuple[str, str]]:
        """Id to (target, type); a later row of one id replaces the earlier."""
        folder, _, file = part.rpartition("/")
        try:
            tree = self.tree(f"{folder}/_rels/{file}.rels")
        except ParseError:
            return {}
        rows = (n.attributes for n in tree.all("Relationship")) if tree else ()
        return {a["Id"]: (a["Target"], a["Type"]) for a in rows if {"Id", "Target", "Type"} <= a.keys()}


def holds_part(data: bytes, part: str) -> bool:
    try:
        return part in Package(data).names
    except ParseError:
        return False


# Word


def word_style(properties: list[Node]) -> dict:
    """Style of property elements; colour, size and font count only with an end tag."""
    out = style()
    for n in properties:
        value = n.attributes.get("w:val")
        if n.name in ("w:b", "w:i", "w:u"):
            out[{"w:b": "bold", "w:i": "italic", "w:u": "underline"}[n.name]] = True
        elif n.self_closing:
            continue
        elif n.name == "w:color" and value is not None and value != "auto":
            out["color"] = f"#{value}"
        elif n.name == "w:sz" and n.number("w:val") is not None:
            out["font_size"] = n.number("w:val") / 2
        elif n.name == "w:rFonts" and "w:ascii" in n.attributes:
            out["font_family"] = n.attributes["w:ascii"]
    return out


def overlay(named: dict | None, direct: dict) -> dict:
    """Direct formatting over a named style; a named style's underline is not taken over."""
    named = named or style()
    out = style(bold=named["bold"] or direct["bold"], italic=named["italic"] or direct["italic"], underline=direct["underline"])
    for key in ("color", "font_size", "font_family"):
        out[key] = named[key] if direct[key] is None else direct[key]
    return out


def named_styles(tree: Node | None) -> dict[str, dict]:
    found = [n for n in tree.all("w:style") if not n.self_closing] if tree else []
    return {n.attributes.get("w:styleId", ""): word_style([x for x in n.walk() if x.name != "w:rFonts"]) for n in found}


def _flow(node: Node) -> Iterator[Node]:
    """Paragraphs and tables in order; what is inside a table belongs to it."""
    for n in node.elements():
        if n.name in ("w:p", "w:tbl") and not n.self_closing:
            yield n
        else:
            yield from _flow(n)


def _word_table(table: Node) -> dict:
    rows = []
    for r in (n for n in table.walk() if n.name == "w:tr" and not n.self_closing):
        cells = []
        for c in (n for n in r.elements() if n.name == "w:tc" and not n.self_closing):
            open_ = [n for n in c.walk() if not n.self_closing]
            spans = [int(n.attributes["w:val"]) for n in open_ if n.name == "w:gridSpan" and n.attributes.get("w:val", "").isdigit()]
            fills = [n.attributes["w:fill"] for n in open_ if n.name == "w:shd" and n.attributes.get("w:fill", "auto") != "auto"]
            texts = ["".join(n.texts()) for n in open_ if n.name == "w:t"]
            cells.append(cell([[run(t)] for t in texts if t], f"#{fills[-1]}" if fills else None, spans[-1] if spans else 1))
        rows.append(cells)
    return block("Table", rows=rows)


def _paragraph_runs(paragraph: Node, styles: dict[str, dict]) -> tuple[list[dict], str | None]:
    names = [n.attributes["w:val"] for n in paragraph.all("w:pStyle") if "w:val" in n.attributes]
    name = names[-1] if names else None
    runs = []
    for r in (n for n in paragraph.all("w:r") if not n.self_closing):
        text = "".join(r.texts())
        if text:
            direct = word_style([x for p in r.all("w:rPr") for x in p.walk()])
            runs.append({"text": text, "style": overlay(styles.get(name), direct)})
    return runs, name


def parse_docx(data: bytes, name: str | None = None) -> dict:
    package = Package(data)
    content = package.tree("word/document.xml")
    if content is None:
        raise ParseError("word/document.xml not found")
    try:
        styles = named_styles(package.tree("word/styles.xml"))
    except ParseError:
        styles = {}
    pages, blocks, count = [], [], 0
    for n in _flow(content):
        if n.name == "w:tbl":
            blocks.append(_word_table(n))
            continue
        count += 1
        runs, style_name = _paragraph_runs(n, styles)
        if runs:
            blocks.append(text_block(runs, paragraph_style=style_name))
            if count >= PARAGRAPHS_PER_PAGE:
                pages.append(page(len(pages) + 1, blocks))
                blocks, count = [], 0
    if blocks or not pages:
        pages.append(page(len(pages) + 1, blocks))
    return document(pages, {"format": "DOCX"}, title=name)


# Excel


def _letters(ref: str) -> tuple[int, int]:
    m = re.fullmatch(r"([A-Z]+)([0-9]+)", ref)
    if not m:
        raise ParseError(f"bad cell reference {ref}")
    column = 0
    for c in m[1]:
        column = column * 26 + ord(c) - 64
    return int(m[2]) - 1, column - 1


def _cell_text(c: Node, shared: list[str]) -> str | None:
    kind, v = c.attributes.get("t", "n"), c.first("v")
    if kind == "inlineStr":
        return "".join("".join(t.texts()) for t in c.all("t"))
    raw = "".join(v.texts()) if v else ""
    if not raw:
        return None
    if kind == "s":
        return shared[int(raw)] if raw.isdigit() and int(raw) < len(shared) else ""
    if kind == "b":
        return "false" if raw == "0" else "true"
    if kind == "e":
        return "#" + ERRORS.get(raw, raw.strip("#"))
    if kind in ("str", "d"):
        return raw
    try:
        return number_text(float(raw))
    except ValueError:
        return raw


def cell_styles(tree: Node) -> dict[str, list[dict]]:
    """Fonts, fills and cell formats of a style sheet, each in order."""

    def of(group: str, item: str) -> list[Node]:
        found = tree.first(group)
        return [n for n in found.elements() if n.name == item] if found else []

    def colour(n: Node | None) -> str | None:
        rgb = n.attributes.get("rgb") if n else None
        return f"#{rgb[-6:]}" if rgb else None

    fonts = [
        {"bold": bool(n.all("b")), "italic": bool(n.all("i")), "underline": bool(n.all("u")), "size": s.number("val") if (s := n.first("sz")) else None, "name": x.attributes.get("val") if (x := n.first("name")) else None, "color": colour(n.first("color"))}
        for n in of("fonts", "font")
    ]
    fills = [{"color": colour(n.first("fgColor"))} for n in of("fills", "fill")]
    formats = [{k: int(n.number(a) or 0) for k, a in (("font", "fontId"), ("fill", "fillId"), ("number_format", "numFmtId"))} for n in of("cellXfs", "xf")]
    return {"fonts": fonts, "fills": fills, "formats": formats}


def theme_colours(tree: Node) -> dict[str, str]:
    """Colours of a theme's scheme by name, where they are written with an end tag."""
    scheme = tree.first("a:clrScheme")
    pairs = ((n.name.removeprefix("a:"), c) for n in (scheme.elements() if scheme else ()) for c in n.all("a:srgbClr", "a:sysClr") if not c.self_closing)
    return {name: c.attributes.get("val" if c.name == "a:srgbClr" else "lastClr", "") for name, c in pairs}


def parse_xlsx(data: bytes, name: str | None = None) -> dict:
    package = Package(data)
    book = package.tree("xl/workbook.xml")
    if book is None:
        raise ParseError("Failed to open XLSX workbook: no xl/workbook.xml")
    relations = package.relations("xl/workbook.xml")
    strings = package.tree("xl/sharedStrings.xml")
    shared = ["".join("".join(t.texts()) for t in s.all("t")) for s in strings.all("si")] if strings else []
    sheets = [(n.attributes.get("name", ""), relations.get(n.attributes.get("r:id", ""), (None,))[0]) for n in book.all("sheet")]
    if not sheets:
        return document([], title="Empty Workbook")
    pages = []
    for i, (label, target) in enumerate(sheets, 1):
        part = None if target is None else target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")
        tree = package.tree(part) if part else None
        if tree is None:
            continue
        cells = {}
        for c in tree.all("c"):
            text = _cell_text(c, shared) if "r" in c.attributes else None
            if text is not None:
                cells[_letters(c.attributes["r"])] = text
        if not cells:
            continue
        (top, left), (bottom, right) = ((f(r for r, _ in cells), f(k for _, k in cells)) for f in (min, max))
        rows = [[cell([[run(cells.get((r, k), ""))]]) for k in range(left, right + 1)] for r in range(top, bottom + 1)]
        size = rect(0.0, 0.0, (right - left + 1) * 72.0, (bottom - top + 1) * 20.0)
        pages.append(page(i, [block("Table", size, rows=rows)], LETTER, label))
    return document(pages, {"excel_sheet_count": len(sheets), "excel_sheet_names": ", ".join(n for n, _ in sheets)}, title=name)


# PowerPoint


def _bounds(holder: Node, *names: str) -> tuple[dict, Node | None]:
    """Of the last frame: the first offset or size that has an end tag; the frame ends there."""
    frames = [n for n in holder.all(*names) if not n.self_closing]
    out = rect()
    frame = frames[-1] if frames else None
    for c in frame.elements() if frame else ():
        kind = c.name.removeprefix("a:")
        if c.self_closing or kind not in ("off", "ext"):
            continue
        for key, attribute in (("x", "x"), ("y", "y")) if kind == "off" else (("width", "cx"), ("height", "cy")):
            if c.number(attribute) is not None:
                out[key] = c.number(attribute) / EMU
        break
    return out, frame


def text_body(body: Node) -> list[dict]:
    """Runs of a text body; each paragraph ends in a line feed."""
    out = []
    for n in body.elements():
        if n.name == "a:r" and not n.self_closing:
            text = "".join(s for t in n.texts() if (s := t.strip(" \t\r\n")))
            given = style()
            for p in (x for x in n.walk() if not x.self_closing):
                if p.name == "a:rPr":
                    given |= {"font_size": p.number("sz") / 100} if p.number("sz") is not None else {}
                    given |= {k: p.attributes[a] == yes for k, a, yes in (("bold", "b", "1"), ("italic", "i", "1"), ("underline", "u", "sng")) if a in p.attributes}
                elif p.name == "a:latin" and "typeface" in p.attributes:
                    given["font_family"] = p.attributes["typeface"]
                elif p.name == "a:srgbClr" and "val" in p.attributes:
                    given["color"] = p.attributes["val"]
            if text:
                out.append({"text": text, "style": given})
        else:
            out += text_body(n)
            if n.name == "a:p" and not n.self_closing:
                out.append(run("\n"))
    return out


def _outside(node: Node, stop: str) -> Iterator[Node]:
    """Elements below, not entering elements named stop."""
    for n in node.elements():
        if n.name != stop or n.self_closing:
            yield n
            yield from _outside(n, stop)


def _shape(shape: Node) -> dict | None:
    bodies = [n for n in shape.all("p:txBody") if not n.self_closing]
    runs = text_body(bodies[-1]) if bodies else []
    if not runs:
        return None
    bounds, frame = _bounds(shape, "a:xfrm", "p:xfrm", "xfrm")
    turn = frame.number("rot") if frame else None
    lines = [n for n in _outside(shape, "p:txBody") if n.name == "a:ln"]
    widths = [n.number("w") / EMU for n in lines if n.number("w") is not None]
    in_lines = [n.attributes["val"] for line in lines for n in line.all("a:srgbClr") if "val" in n.attributes]
    line_ids = {id(n) for line in lines for n in line.walk()}
    fills = [n.attributes["val"] for n in _outside(shape, "p:txBody") if n.name == "a:srgbClr" and "val" in n.attributes and id(n) not in line_ids]
    return text_block(runs, bounds, rotation=(turn or 0.0) / 60000, fill_color=fills[-1] if fills else None, stroke_color=in_lines[-1] if in_lines else None, stroke_width=widths[-1] if widths else None)


def _image_format(path: str) -> str | None:
    extension = posixpath.splitext(path)[1]
    return (IMAGE_TYPES.get(extension.lower()) or f"image/{extension[1:]}") if extension else None


def _picture(node: Node, targets: dict[str, str]) -> dict:
    open_ = [n for n in node.walk() if not n.self_closing]
    ids = [n.attributes["r:embed"] for n in open_ if n.name == "a:blip" and "r:embed" in n.attributes]
    alts = [n.attributes["descr"] for n in open_ if n.name == "p:cNvPr" and "descr" in n.attributes]
    key = ids[-1] if ids else ""
    path = targets.get(key)
    return block("Image", _bounds(node, "a:xfrm", "p:xfrm", "xfrm")[0], resource_id=key if path is None else path, alt_text=alts[-1] if alts else None, format=_image_format(path) if path else None)


def _background(node: Node, targets: dict[str, str], size: tuple[float, float]) -> dict | None:
    ids = [n.attributes["r:embed"] for n in node.all("a:blip") if "r:embed" in n.attributes]
    if not ids or not ids[-1]:
        return None
    path = targets.get(ids[-1], ids[-1])
    return block("Image", rect(0.0, 0.0, *size), resource_id=path, alt_text="Background Image", format=_image_format(path))


def _drawing_table(frame: Node) -> dict | None:
    tables = [n for n in frame.all("a:tbl") if not n.self_closing]
    if not tables:
        return None
    rows = []
    for r in (n for n in tables[-1].all("a:tr") if not n.self_closing):
        bodies = [[text_body(b) for b in c.all("a:txBody") if not b.self_closing] for c in r.all("a:tc") if not c.self_closing]
        rows.append([cell([runs for runs in b if runs]) for b in bodies])
    return block("Table", _bounds(frame, "p:xfrm")[0], rows=rows)


def _slide_items(node: Node) -> Iterator[Node]:
    for n in node.elements():
        if n.name in ("p:bg", "p:sp", "p:pic", "p:graphicFrame") and not n.self_closing:
            yield n
        else:
            yield from _slide_items(n)


def slide_blocks(tree: Node, targets: dict[str, str], size: tuple[float, float]) -> list[dict]:
    out = []
    for n in _slide_items(tree):
        if n.name == "p:bg":
            made = _background(n, targets, size)
            out[:0] = [made] if made else []
            continue
        made = _shape(n) if n.name == "p:sp" else _picture(n, targets) if n.name == "p:pic" else _drawing_table(n)
        out += [made] if made else []
    return out


def _theme(tree: Node | None) -> dict[str, str]:
    out = {}
    for n in tree.all("a:theme") if tree else ():
        out["theme_name"] = n.attributes.get("name", "")
        for key, tag in (("theme_font_major", "a:majorFont"), ("theme_font_minor", "a:minorFont")):
            fonts = [x.attributes["typeface"] for f in n.all(tag) for x in f.all("a:latin") if not x.self_closing and "typeface" in x.attributes]
            out |= {key: fonts[-1]} if fonts else {}
    return out


def parse_pptx(data: bytes, name: str | None = None) -> dict:
    package = Package(data)
    show = package.tree("ppt/presentation.xml")
    if show is None:
        raise ParseError("Missing ppt/presentation.xml")
    sized = show.all("p:sldSz")
    size = SLIDE if not sized else tuple((sized[-1].number(a) or d) / EMU for a, d in (("cx", 12192000.0), ("cy", 6858000.0)))
    relations = package.relations("ppt/presentation.xml")
    theme = next((t for t, kind in relations.values() if kind == _TYPE + "theme"), None)
    pages, images = [], {}
    for i, n in enumerate((n for n in show.all("p:sldId") if "r:id" in n.attributes), 1):
        target = relations.get(n.attributes["r:id"], (None,))[0]
        part = None if target is None else f"ppt/{target}".replace("\\", "/")
        text = package.text(part) if part else None
        if not text:
            continue
        targets = {k: t for k, (t, _) in package.relations(part).items()}
        for t in targets.values():
            raw = package.raw(posixpath.normpath(posixpath.join(posixpath.dirname(part), t)).replace("\\", "/"))
            if raw is not None and t not in images:
                kind = IMAGE_TYPES.get(posixpath.splitext(t)[1], "application/octet-stream")
                w, h = (0, 0) if kind == "image/svg+xml" else any_size(raw)
                images[t] = {"id": t, "mime_type": kind, "data": raw, "width": w, "height": h}
        pages.append(page(i, slide_blocks(parse(text), targets, size), size, f"Slide {i}"))
    try:
        extra = _theme(package.tree(f"ppt/{theme}")) if theme else {}
    except ParseError:
        extra = {}
    return document(pages, {"format": "PPTX", "slide_count": len(pages)} | extra, list(images.values()), title=name)
