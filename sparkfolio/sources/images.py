"""PNG, JPEG and TIFF as pages with one image each; sizes come from headers, TIFF pages are written again as PNG."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from .udm import ParseError, block, document, page, rect

PNG = bytes.fromhex("89504E470D0A1A0A")


def png_size(data: bytes) -> tuple[int, int] | None:
    return struct.unpack(">II", data[16:24]) if data.startswith(PNG) and data[12:16] == b"IHDR" and len(data) >= 24 else None


def jpeg_size(data: bytes) -> tuple[int, int] | None:
    """Width and height of the first start-of-frame segment."""
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 <= len(data):
        if data[at] != 0xFF:
            return None
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
        elif marker in (0x01, *range(0xD0, 0xD9)):
            at += 2
        else:
            at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None


def any_size(data: bytes) -> tuple[int, int]:
    """Size by the content's own signature; zeros where it has none."""
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    return png_size(data) or jpeg_size(data) or (0, 0)


def _single(data: bytes, mime: str, size: tuple[int, int] | None, name: str | None, label: str) -> dict:
    if not size or not all(size):
        raise ParseError(f"Failed to decode {label}")
    w, h = size
    picture = block("Image", rect(0.0, 0.0, float(w), float(h)), resource_id="img_1", format=mime)
    return document([page(1, [picture], size)], images=[{"id": "img_1", "mime_type": mime, "data": data, "width": w, "height": h}], title=name)


def parse_png(data: bytes, name: str | None = None) -> dict:
    return _single(data, "image/png", png_size(data), name, "PNG")


def parse_jpeg(data: bytes, name: str | None = None) -> dict:
    return _single(data, "image/jpeg", jpeg_size(data), name, "JPEG")


def write_png(rgba: np.ndarray) -> bytes:
    """rgba: height x width x 4 bytes."""
    h, w, _ = rgba.shape
    raw = np.concatenate((np.zeros((h, 1), np.uint8), rgba.reshape(h, w * 4)), axis=1).tobytes()

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def to_byte(samples: np.ndarray) -> np.ndarray:
    """Samples of any kind as 8 bits: the high byte of whole numbers, signed bytes moved by 128, floats times 255."""
    kind, size = samples.dtype.kind, samples.dtype.itemsize
    if kind == "f":
        return (np.clip(np.nan_to_num(samples), 0, 1) * 255).astype(np.uint8)
    if size == 1:
        return (samples.astype(np.int16) + 128).astype(np.uint8) if kind == "i" else samples
    return (samples >> np.array(8 * (size - 1), dtype=samples.dtype)).astype(np.uint8)


def _unpack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 2
    return bytes(out)


def _unpack_lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, high bits first, one code earlier than the table needs."""
    out, table = [], []
    bits = held = at = 0
    width, last = 9, None
    while True:
        while held < width and at < len(data):
            bits, held, at = bits << 8 | data[at], held + 8, at + 1
        if held < width:
            return b"".join(out)
        held -= width
        code, bits = bits >> held, bits & ((1 << held) - 1)
        if code == 257:
            return b"".join(out)
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
            continue
        if code > len(table) or (last is None and code > 255):
            raise ParseError("bad LZW code")
        entry = table[code] if code < len(table) else last + last[:1]
        if last is not None:
            table.append(last + entry[:1])
        out.append(entry)
        last = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12


#: TIFF compressions that are read (fixed values).
_CODECS = {1: bytes, 5: _unpack_lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: _unpack_bits}
#: TIFF's photometric interpretations that are read (fixed values): white is zero, black is zero, RGB.
_WHITE_ZERO, _BLACK_ZERO, _RGB = 0, 1, 2
_WIDTH = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4)}


def _directories(data: bytes, order: str):
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        tags = {}
        for i in range(struct.unpack_from(order + "H", data, at)[0]):
            tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            if kind in _WIDTH:
                code, size = _WIDTH[kind]
                where = at + 10 + 12 * i
                where = where if n * size <= 4 else struct.unpack_from(order + "I", data, where)[0]
                tags[tag] = struct.unpack_from(f"{order}{n}{code}", data, where)
        yield tags
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * struct.unpack_from(order + "H", data, at)[0])[0]


def _pixels(data: bytes, tags: dict, order: str) -> np.ndarray:
    w, h = tags[256][0], tags[257][0]
    bits, samples = tags.get(258, (1,))[0], tags.get(277, (1,))[0]
    codec, meaning, predictor = _CODECS.get(tags.get(259, (1,))[0]), tags.get(262, (_BLACK_ZERO,))[0], tags.get(317, (1,))[0]
    if codec is None or bits not in (8, 16, 32, 64) or tags.get(284, (1,))[0] != 1 or meaning not in (_WHITE_ZERO, _BLACK_ZERO, _RGB) or predictor not in (1, 2):
        raise ParseError("unsupported TIFF layout")
    raw = b"".join(codec(data[o : o + n]) for o, n in zip(tags[273], tags[279]))
    kind = {1: "u", 2: "i", 3: "f"}.get(tags.get(339, (1,))[0], "u")
    values = np.frombuffer(raw, dtype=f"{order}{kind}{bits // 8}", count=w * h * samples).reshape(h, w, samples)
    values = values.astype(values.dtype.newbyteorder("="))
    if predictor == 2 and kind != "f":
        values = np.cumsum(values, axis=1, dtype=values.dtype)
    if meaning == _WHITE_ZERO and kind == "u":
        values = ~values
    p = to_byte(values)
    if samples == 4 and values.dtype == np.uint8:
        return p
    opaque = np.full((h, w, 1), 255, np.uint8)
    if samples == 3 and values.dtype == np.uint8:
        return np.concatenate((p, opaque), axis=2)
    grey = p.reshape(-1)[: w * h].reshape(h, w, 1)  # wider samples are a pixel each, in order
    return np.concatenate((np.repeat(grey, 3, axis=2), opaque), axis=2)


def parse_tiff(data: bytes, name: str | None = None) -> dict:
    order = "<" if data[:2] == b"II" else ">"
    pages, images = [], []
    try:
        for n, tags in enumerate(_directories(data, order), 1):
            rgba = _pixels(data, tags, order)
            h, w, _ = rgba.shape
            picture = block("Image", rect(0.0, 0.0, float(w), float(h)), resource_id=f"img_page_{n}", format="image/tiff")
            pages.append(page(n, [picture], (w, h)))
            images.append({"id": f"img_page_{n}", "mime_type": "image/png", "data": write_png(rgba), "width": w, "height": h})
    except (struct.error, KeyError, ValueError, zlib.error) as e:
        raise ParseError(f"Failed to decode TIFF: {e}") from e
    if not pages:
        raise ParseError("Failed to decode TIFF: no directory")
    return document(pages, {"format": "TIFF", "page_count": len(pages)}, images, title=name)
