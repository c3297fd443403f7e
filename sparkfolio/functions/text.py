"""Text functions as Spark expressions: statistics, gates, titles, escaping and printable runs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode White_Space, spelt for Java (fixed value).
WHITESPACE = r"\t-\r \u0085\u00A0\u1680\u2000-\u200A\u2028-\u2029\u202F\u205F\u3000"
_EDGES = f"^[{WHITESPACE}]+|[{WHITESPACE}]+$"


def byte_count(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def line_feeds(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("long")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, f"[{WHITESPACE}]+"), lambda w: w != "")).cast("long")


def unicode_trim(text: Column) -> Column:
    return F.regexp_replace(text, _EDGES, "")


def decoded(content: Column) -> Column:
    """Bytes as text, or null where they are no UTF-8."""
    return F.try_validate_utf8(content.cast("string"))


def lossy(content: Column) -> Column:
    """Bytes as text, with replacement characters."""
    return F.make_valid_utf8(content.cast("string"))


def utf16_until_null(content: Column) -> Column:
    """UTF-16LE up to the first null character; UTF-8 where the length is odd or under two."""
    wide = F.octet_length(content)
    return F.when((wide >= 2) & (wide % 2 == 0), F.substring_index(F.decode(content, "UTF-16LE"), "\0", 1)).otherwise(F.substring_index(lossy(content), "\0", 1))


def is_likely_text(content: Column) -> Column:
    """Valid UTF-8 with under a tenth of control bytes; empty is not text."""
    text = content.cast("string")
    control = F.octet_length(content) - F.octet_length(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""))
    return F.is_valid_utf8(text) & F.coalesce(F.try_divide(control, F.octet_length(content)) < 0.1, F.lit(False))


def _head(content: Column, n: int) -> Column:
    return F.substring(content, 1, n)


def is_likely_html(content: Column) -> Column:
    """Starts like HTML, or its first 1024 bytes (whole characters) hold html, a doctype, or head and body."""
    start = F.lower(F.regexp_replace(F.coalesce(decoded(content), F.lit("")), f"^[{WHITESPACE}]+", ""))
    head = F.lower(F.coalesce(decoded(_head(content, 1024)), F.lit("")))
    inside = F.contains(head, F.lit("<html")) | F.contains(head, F.lit("<!doctype")) | (F.contains(head, F.lit("<head")) & F.contains(head, F.lit("<body")))
    return F.startswith(start, F.lit("<!doctype")) | F.startswith(start, F.lit("<html")) | inside


def is_eml(content: Column) -> Column:
    head = lossy(_head(content, 1024))
    return F.contains(head, F.lit("From:")) & (F.contains(head, F.lit("To:")) | F.contains(head, F.lit("Subject:")))


def is_mbox(content: Column) -> Column:
    return _head(content, 5) == F.lit(b"From ")


def is_vcard(content: Column) -> Column:
    return F.contains(lossy(_head(content, 512)), F.lit("BEGIN:VCARD"))


def is_calendar(content: Column) -> Column:
    return F.contains(lossy(_head(content, 512)), F.lit("BEGIN:VCALENDAR"))


def html_title(html: Column) -> Column:
    """Text of the first literal <title>, trimmed; null without one."""
    start = F.locate("<title>", html)
    rest = F.substring(html, start + F.lit(7), F.length(html))
    end = F.locate("</title>", rest)
    return F.when((start > 0) & (end > 0), unicode_trim(F.substring(rest, F.lit(1), end - F.lit(1))))


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def base64_plain(content: Column) -> Column:
    """Standard base64 without line breaks."""
    return F.regexp_replace(F.base64(content), "[\r\n]", "")


def printable_text(text: Column) -> Column:
    """Runs of four or more printable ASCII characters, single-spaced."""
    runs = F.regexp_extract_all(text, F.lit(r"[\t\n\r\x20-\x7e]{4,}"), F.lit(0))
    return F.array_join(F.filter(F.split(F.array_join(runs, " "), r"[\t\n\r ]+"), lambda w: w != ""), " ")


def file_extension(name: Column) -> Column:
    """After the last dot, case kept; the whole name without one."""
    return F.element_at(F.split(name, r"\.", -1), -1)


def address(name: Column, email: Column) -> Column:
    email = F.coalesce(email, F.lit(""))
    return F.when(name.isNotNull(), F.concat(name, F.lit(" <"), email, F.lit(">"))).otherwise(email)


def header_line(label: Column, value: Column) -> Column:
    return F.concat(label, F.lit(": "), value, F.lit("\n"))


def header_is_bold(label: Column) -> Column:
    return label.isin("From", "To", "Subject")


def with_context(message: Column, inner: Column) -> Column:
    return F.concat(message, F.lit(": "), inner)


def image_mime(extension: Column, unknown: Column | None = None) -> Column:
    low = F.lower(extension)
    other = F.concat(F.lit("image/"), extension) if unknown is None else unknown
    return F.when(low == "png", "image/png").when(low.isin("jpg", "jpeg"), "image/jpeg").when(low == "gif", "image/gif").when(low == "svg", "image/svg+xml").otherwise(other)


def resolve_path(base: Column, target: Column) -> Column:
    """target relative to the folder base: `..` goes up, `.` stays."""
    parts = F.aggregate(
        F.split(target, "/"),
        F.split(base, "/"),
        lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(p == ".", acc).otherwise(F.concat(acc, F.array(p))),
    )
    return F.array_join(parts, "/")
