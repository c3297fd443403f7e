"""vCard and iCalendar text as labelled runs, from one line reader and two tables of labels."""

from __future__ import annotations

import re

from .udm import ParseError, document, page, run, text_block

#: Property to label, and whether it is bold (fixed values); a note is a heading and its own text.
CARD = {"FN": ("Name", True), "ORG": ("Organization", False), "TITLE": ("Title", False), "EMAIL": ("Email", False), "TEL": ("Phone", False), "ADR": ("Address", False), "URL": ("Website", False), "NOTE": ("Note", None)}
EVENT = {"SUMMARY": ("Event", True), "DTSTART": ("Start", False), "DTEND": ("End", False), "LOCATION": ("Location", False), "DESCRIPTION": ("Description", None), "ORGANIZER": ("Organizer", False), "ATTENDEE": ("Attendee", False)}
SEPARATOR = "\n---\n\n"


def properties(text: str) -> list[tuple[str, str]]:
    """Unfolded lines as (name, value); parameters are dropped."""
    unfolded = re.sub(r"\r?\n[ \t]", "", text)
    found = (re.match(r"([^:;]+)(?:;(?:\"[^\"]*\"|[^:\"])*)?:(.*)$", line) for line in re.split(r"\r?\n", unfolded))
    return [(m[1].strip().upper(), m[2]) for m in found if m]


def _shown(lines: list[tuple[str, str]], labels: dict) -> list[dict]:
    runs = []
    for name, text in lines:
        label, bold = labels.get(name, (None, None))
        if label is None or not text:
            continue
        if bold is None:
            runs += [run(f"\n{label}:\n", bold=True), run(f"{text}\n")]
        elif name == "ADR":
            parts = [p for p in text.split(";") if p]
            runs += [run(f"{label}: {', '.join(parts)}\n")] if parts else []
        else:
            runs.append(run(f"{label}: {text}\n", bold=bold))
    return runs


def _sections(lines: list[tuple[str, str]], kind: str) -> list[list[tuple[str, str]]]:
    """Lines between BEGIN:kind and its END; a section left open is no section."""
    out, open_ = [], None
    for name, text in lines:
        if name == "BEGIN" and text.strip().upper() == kind and open_ is None:
            open_ = []
        elif name == "END" and text.strip().upper() == kind and open_ is not None:
            out.append(open_)
            open_ = None
        elif open_ is not None:
            open_.append((name, text))
    return out


def parse_vcf(data: bytes, name: str | None = None) -> dict:
    cards = _sections(properties(data.decode("utf-8", "replace")), "VCARD")
    if not cards:
        raise ParseError("No valid vCards found")
    title = next((v for n, v in cards[0] if n == "FN"), None) or name
    pages = [page(i, [text_block(_shown(c, CARD))]) for i, c in enumerate(cards, 1)]
    return document(pages, {"format": "VCF", "contact_count": len(pages)}, title=title)


def parse_ics(data: bytes, name: str | None = None) -> dict:
    calendars = _sections(properties(data.decode("utf-8", "replace")), "VCALENDAR")
    if not calendars:
        raise ParseError("No valid calendars found")
    outside, depth = [], 0
    for n, v in calendars[0]:
        depth += (n == "BEGIN") - (n == "END")
        outside += [v] if depth == 0 and n in ("X-WR-CALNAME", "NAME") else []
    pages = []
    for i, c in enumerate(calendars, 1):
        runs = []
        for event in _sections(c, "VEVENT"):
            runs += [*_shown(event, EVENT), run(SEPARATOR)]
        pages.append(page(i, [text_block(runs)]))
    return document(pages, {"format": "ICS", "calendar_count": len(pages)}, title=outside[0] if outside else name)
