"""Reader of OLE compound files: named streams of a small file system inside a file."""

from __future__ import annotations

import struct

from .udm import ParseError

SIGNATURE = bytes.fromhex("D0CF11E0A1B11AE1")
_FREE, _END, _NONE = 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFF


class CompoundFile:
    """Streams and storages by path, case-insensitively, joined by slashes."""

    def __init__(self, data: bytes):
        if len(data) < 512 or not data.startswith(SIGNATURE):
            raise ParseError("not a compound file")
        self.data = data
        shift, mini_shift = struct.unpack_from("<HH", data, 30)
        if shift not in (9, 12) or mini_shift > shift:
            raise ParseError("bad sector size")
        self.size, self.mini = 1 << shift, 1 << mini_shift
        fat_count, directory, _, self.cutoff, mini_fat, _, more, _ = struct.unpack_from("<8I", data, 44)
        sectors = [s for s in struct.unpack_from("<109I", data, 76) if s < _END]
        seen = set()
        while more < _END and more not in seen:
            seen.add(more)
            entries = struct.unpack(f"<{self.size // 4}I", self._sector(more))
            sectors += [s for s in entries[:-1] if s < _END]
            more = entries[-1]
        self.fat = [x for s in sectors[:fat_count] for x in struct.unpack(f"<{self.size // 4}I", self._sector(s))]
        raw = self._chain(directory)
        entries = []
        for at in range(0, len(raw) - 127, 128):
            length, kind = struct.unpack_from("<HB", raw, at + 64)
            left, right, child = struct.unpack_from("<3I", raw, at + 68)
            start, size = struct.unpack_from("<IQ", raw, at + 116)
            entries.append((raw[at : at + max(0, length - 2)].decode("utf-16-le", "replace"), kind, left, right, child, start, size & (0xFFFFFFFF if shift == 9 else 2**63)))
        if not entries:
            raise ParseError("no directory")
        mini_raw = self._chain(mini_fat) if mini_fat < _END else b""
        self.mini_fat = list(struct.unpack(f"<{len(mini_raw) // 4}I", mini_raw[: len(mini_raw) // 4 * 4]))
        self.mini_data = self._chain(entries[0][5]) if entries[0][5] < _END else b""
        self.entries: dict[str, tuple] = {}
        waiting, visited = [(entries[0][4], "")], set()
        while waiting:
            i, prefix = waiting.pop()
            if i == _NONE or i >= len(entries) or i in visited:
                continue
            visited.add(i)
            name, kind, left, right, child, start, size = entries[i]
            path = f"{prefix}{name}".lower()
            self.entries[path] = (kind, start, size)
            waiting += [(left, prefix), (right, prefix)]
            if kind == 1:
                waiting.append((child, f"{prefix}{name}/"))

    def _sector(self, i: int) -> bytes:
        at = (i + 1) * self.size
        return self.data[at : at + self.size].ljust(self.size, b"\0")

    def _chain(self, start: int) -> bytes:
        out, seen = [], set()
        while start < _END and start not in seen:
            seen.add(start)
            out.append(self._sector(start))
            start = self.fat[start] if start < len(self.fat) else _END
        return b"".join(out)

    def has_stream(self, path: str) -> bool:
        return self.entries.get(path.lower(), (0,))[0] == 2

    def has_storage(self, path: str) -> bool:
        return self.entries.get(path.lower(), (0,))[0] == 1

    def stream(self, path: str) -> bytes | None:
        if not self.has_stream(path):
            return None
        _, start, size = self.entries[path.lower()]
        if size >= self.cutoff:
            return self._chain(start)[:size]
        out, seen = [], set()
        while start < _END and start not in seen:
            seen.add(start)
            out.append(self.mini_data[start * self.mini : (start + 1) * self.mini])
            start = self.mini_fat[start] if start < len(self.mini_fat) else _END
        return b"".join(out)[:size]


def is_compound(data: bytes) -> bool:
    return data.startswith(SIGNATURE)


def holds_stream(data: bytes, *names: str) -> bool:
    try:
        file = CompoundFile(data)
    except (ParseError, struct.error):
        return False
    return any(file.has_stream(n) or file.has_storage(n) for n in names)
