"""Builders of unified-model values as plain dictionaries, for parsers that run in Python."""

from __future__ import annotations

from sparkfolio.schemas import LETTER


class ParseError(Exception):
    """The content can't be parsed; becomes the row's error."""


def style(**given) -> dict:
    return {"font_family": None, "font_size": None, "bold": False, "italic": False, "underline": False, "strikethrough": False, "color": None, "background_color": None} | given


def run(text: str, **given) -> dict:
    return {"text": text, "style": style(**given)}


def rect(x: float = 0.0, y: float = 0.0, width: float = 0.0, height: float = 0.0) -> dict:
    return {"x": x, "y": y, "width": width, "height": height}


def block(kind: str, bounds: dict | None = None, **given) -> dict:
    empty = dict.fromkeys(("runs", "paragraph_style", "fill_color", "stroke_color", "stroke_width", "rows", "resource_id", "alt_text", "format", "paths", "depth"))
    return {"kind": kind, "bounds": bounds or rect(), "rotation": 0.0} | empty | given


def text_block(runs: list[dict], bounds: dict | None = None, **given) -> dict:
    return block("Text", bounds, runs=runs, **given)


def cell(texts: list[list[dict]], background: str | None = None, col_span: int = 1) -> dict:
    return {"content": texts, "col_span": col_span, "row_span": 1, "background_color": background}


def page(number: int, blocks: list[dict], size: tuple[float, float] = LETTER, label: str | None = None) -> dict:
    return {"number": number, "width": float(size[0]), "height": float(size[1]), "label": label, "rotation": 0, "blocks": blocks}


def value(v) -> dict:
    out = dict.fromkeys("sifbt")
    out["b" if isinstance(v, bool) else "i" if isinstance(v, int) else "f" if isinstance(v, float) else "s" if isinstance(v, str) else "t"] = v
    return out


def document(pages: list[dict], custom: dict | None = None, images: list[dict] | None = None, attachments: list[dict] | None = None, **metadata) -> dict:
    empty = dict.fromkeys(("title", "author", "subject", "creator", "producer", "created", "modified", "language"))
    meta = empty | {"keywords": []} | metadata | {"custom": [(k, value(v)) for k, v in (custom or {}).items()]}
    return {"metadata": meta, "pages": pages, "images": images or [], "attachments": attachments or [], "error": None}


def failed(message: str, kind: str = "ParseError") -> dict:
    return document([]) | {"error": {"kind": kind, "message": message}}
