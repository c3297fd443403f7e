"""A small tolerant XML tree that remembers whether an element was written self-closing.

Several office parsers must tell <w:sz .../> from <w:sz ...></w:sz>, which standard parsers do not report. Prefixes are
kept as written; text is unescaped, attribute values are not.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from .udm import ParseError

_TOKEN = re.compile(r"<!--.*?-->|<\?.*?\?>|<!\[CDATA\[(?P<raw>.*?)\]\]>|<![^>]*>|</(?P<end>[^\s>]+)\s*>|<(?P<name>[^\s/>!?]+)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(?P<empty>/)?>|(?P<text>[^<]+)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", re.S)
_ENTITY = re.compile(r"&(#x[0-9A-Fa-f]+|#[0-9]+|amp|lt|gt|quot|apos);")
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


def unescape(text: str) -> str:
    def one(m: re.Match) -> str:
        e = m[1]
        return _NAMED[e] if e in _NAMED else chr(int(e[2:], 16) if e[1] == "x" else int(e[1:]))

    return _ENTITY.sub(one, text)


@dataclass
class Node:
    name: str
    attributes: dict[str, str] = field(default_factory=dict)
    self_closing: bool = False
    children: list[Node | str] = field(default_factory=list)

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order."""
        for c in self.elements():
            yield c
            yield from c.walk()

    def all(self, *names: str) -> list[Node]:
        return [n for n in self.walk() if n.name in names]

    def first(self, *names: str) -> Node | None:
        return next((n for n in self.walk() if n.name in names), None)

    def texts(self) -> list[str]:
        out: list[str] = []
        for c in self.children:
            out += [c] if isinstance(c, str) else c.texts()
        return out

    def number(self, key: str) -> float | None:
        try:
            return float(self.attributes[key])
        except (KeyError, ValueError):
            return None


def parse(text: str) -> Node:
    """The tree under a nameless root; elements left open end with the text."""
    root = Node("")
    stack = [root]
    for m in _TOKEN.finditer(text):
        if m["name"]:
            node = Node(m["name"], {a: b if b is not None else c for a, b, c in ((x[1], x[2], x[3]) for x in _ATTRIBUTE.finditer(m["attrs"] or ""))}, bool(m["empty"]))
            stack[-1].children.append(node)
            if not node.self_closing:
                stack.append(node)
        elif m["end"]:
            if len(stack) == 1 or stack[-1].name != m["end"]:
                raise ParseError(f"unexpected end tag {m['end']}")
            stack.pop()
        elif m["text"] is not None:
            stack[-1].children.append(unescape(m["text"]))
    return root
