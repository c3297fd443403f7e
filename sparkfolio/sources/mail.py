"""Mail messages (EML, MBOX, MSG) as header and body runs."""

from __future__ import annotations

import datetime
import email
import email.errors
import email.policy
import email.utils
from email.header import decode_header, make_header
from email.message import Message

from sparkfolio.schemas import LETTER

from .compound import CompoundFile
from .udm import ParseError, document, page, rect, run, text_block

#: Labels that are shown bold.
BOLD = ("From", "To", "Subject")
NO_BODY = "[No message body]"
#: MSG properties (fixed values): label and stream names in the order they are tried.
MSG_HEADERS = (("From", ("0C1A001F", "0C1F001F")), ("Sent", ("00390040",)), ("To", ("0E04001F",)), ("Cc", ("0E03001F",)), ("Bcc", ("0E02001F",)), ("Subject", ("0037001F",)))
MSG_BODY, MSG_ATTACHMENTS = ("1000001F", "10130102"), 100


def header(label: str, text: str) -> dict:
    return run(f"{label}: {text}\n", bold=label in BOLD)


def _decoded(value: str | None) -> str | None:
    if value is None:
        return None
    try:
        return str(make_header(decode_header(value))).replace("\r", "").replace("\n", " ").strip()
    except (UnicodeError, LookupError, ValueError, email.errors.MessageError):
        return value


def _addresses(message: Message, field: str) -> list[tuple[str | None, str]]:
    raw = message.get_all(field)
    return [(_decoded(n) or None, a) for n, a in email.utils.getaddresses([str(x) for x in raw])] if raw else []


def _shown(one: tuple[str | None, str]) -> str:
    return f"{one[0]} <{one[1]}>" if one[0] else one[1]


def _date(message: Message) -> datetime.datetime | None:
    try:
        return email.utils.parsedate_to_datetime(str(message["Date"])) if message["Date"] else None
    except (TypeError, ValueError, OverflowError):
        return None


def _utc(date: datetime.datetime | None) -> datetime.datetime | None:
    try:
        return date.astimezone(datetime.timezone.utc) if date else None
    except OverflowError:  # a zone away from the first or the last year
        return None


def _rfc3339(d: datetime.datetime) -> str:
    return d.strftime("%Y-%m-%dT%H:%M:%S") + ("Z" if not d.utcoffset() else d.strftime("%z")[:3] + ":" + d.strftime("%z")[3:])


def _body(message: Message) -> str:
    found: dict[str, str] = {}
    for part in message.walk():
        kind = part.get_content_type()
        if part.is_multipart() or kind not in ("text/plain", "text/html") or kind in found or part.get_content_disposition() == "attachment":
            continue
        raw = part.get_payload(decode=True) or b""
        try:
            found[kind] = raw.decode(part.get_content_charset() or "utf-8", "replace")
        except LookupError:
            found[kind] = raw.decode("utf-8", "replace")
    return found.get("text/plain", found.get("text/html", NO_BODY))


def message_runs(data: bytes, headed: bool = True) -> tuple[Message, list[dict]]:
    """headed: whether a message must have header fields; one without is all body."""
    message = email.message_from_bytes(data, policy=email.policy.compat32)
    if headed and not message.keys():
        raise ParseError("Failed to parse message")
    sender, to, date, subject = _addresses(message, "From"), _addresses(message, "To"), _date(message), _decoded(message["Subject"])
    runs = []
    if message["From"] is not None:
        runs.append(header("From", _shown(sender[0]) if sender else ""))
    if date:
        runs.append(header("Sent", _rfc3339(date)))
    if message["To"] is not None:
        runs.append(header("To", ", ".join(map(_shown, to))))
    if subject is not None:
        runs.append(header("Subject", subject))
    return message, [*runs, run("\n"), run(_body(message))]


def parse_eml(data: bytes, name: str | None = None) -> dict:
    message, runs = message_runs(data, headed=False)
    sender, created = _addresses(message, "From"), _utc(_date(message))
    bounds = rect(0.0, 0.0, *LETTER)
    return document([page(1, [text_block(runs, bounds)])], {"format": "EML"}, title=_decoded(message["Subject"]), author=sender[0][0] if sender else None, created=created)


def split_mailbox(text: str) -> list[str]:
    """Each message from its envelope line on; what comes before the first envelope is no message."""
    first, *rest = text.split("\nFrom ")
    return ([first] if first.startswith("From ") else []) + rest


def parse_mbox(data: bytes, name: str | None = None) -> dict:
    pages = []
    for part in split_mailbox(data.decode("utf-8", "replace")):
        envelope, newline, body = part.partition("\n")
        if newline:
            try:
                pages.append(page(len(pages) + 1, [text_block(message_runs(body.encode())[1])]))
            except ParseError:
                continue
    if not pages:
        raise ParseError("No valid messages found in MBOX")
    return document(pages, {"format": "MBOX", "message_count": len(pages)}, title=name)


def _property(file: CompoundFile, path: str) -> str | None:
    raw = file.stream(path)
    if raw is None:
        return None
    if len(raw) >= 2 and len(raw) % 2 == 0:
        end = next((i for i in range(0, len(raw), 2) if raw[i : i + 2] == b"\0\0"), len(raw))
        try:
            return raw[:end].decode("utf-16-le")
        except UnicodeDecodeError:
            pass
    try:
        return raw.split(b"\0")[0].decode("utf-8")
    except UnicodeDecodeError:
        return None


def _first(file: CompoundFile, tags: tuple[str, ...], folder: str = "") -> str | None:
    return next((v for t in tags if (v := _property(file, f"{folder}__substg1.0_{t}")) is not None), None)


def _attachments(file: CompoundFile) -> list[dict]:
    out = []
    for i in range(MSG_ATTACHMENTS):
        folder = f"__attach_version1.0_{i:08d}"
        if not file.has_storage(folder):
            break
        data = file.stream(f"{folder}/__substg1.0_37010102")
        if data:
            out.append({"filename": _first(file, ("3707001F", "3704001F"), f"{folder}/") or f"attachment_{i}", "mime_type": _first(file, ("370E001F",), f"{folder}/"), "description": None, "data": data})
    return out


def parse_msg(data: bytes, name: str | None = None) -> dict:
    file = CompoundFile(data)
    shown = [(label, _first(file, tags)) for label, tags in MSG_HEADERS]
    body = _first(file, MSG_BODY)
    runs = [header(label, v) for label, v in shown if v is not None] + [run("\n"), run(NO_BODY if body is None else body)]
    attachments = _attachments(file)
    return document([page(1, [text_block(runs)])], {"format": "MSG", "attachment_count": len(attachments)}, attachments=attachments, title=_first(file, ("0037001F",)), author=_first(file, ("0C1A001F",)))
