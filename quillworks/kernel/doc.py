"""Plain text of binary Word documents: compound file, file information block, piece table."""

from __future__ import annotations

import struct

from quillworks.kernel import invalid

_FREE, _END = 0xFFFFFFFF, 0xFFFFFFFE
REASON = "Could not parse Microsoft Word document."


class Compound:
    """Streams of a compound file, by name."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != bytes.fromhex("D0CF11E0A1B11AE1") or len(data) < 512:
            raise invalid(REASON)
        self.data = data
        shift, mini = struct.unpack_from("<HH", data, 30)
        if shift not in (9, 12) or not 4 <= mini <= 9:
            raise invalid(REASON)
        self.size, self.mini = 1 << shift, 1 << mini
        n_fat, first_dir = struct.unpack_from("<I", data, 44)[0], struct.unpack_from("<I", data, 48)[0]
        self.cutoff, first_mini, n_mini, first_dif, n_dif = struct.unpack_from("<5I", data, 56)
        fats = [x for x in struct.unpack_from("<109I", data, 76) if x < _END]
        at, seen = first_dif, set()
        while at < _END and at not in seen and len(seen) <= n_dif:
            seen.add(at)
            part = struct.unpack(f"<{self.size // 4}I", self.sector(at))
            fats += [x for x in part[:-1] if x < _END]
            at = part[-1]
        self.fat = [x for s in fats[: n_fat or len(fats)] for x in struct.unpack(f"<{self.size // 4}I", self.sector(s))]
        self.minifat = list(struct.unpack(f"<{len(m) // 4}I", m)) if n_mini and (m := self.chain(first_mini)) else []
        listing = self.chain(first_dir)
        self.entries: dict[str, tuple[int, int]] = {}
        self.ministream = b""
        for i in range(0, len(listing) - 127, 128):
            e = listing[i : i + 128]
            length, kind = struct.unpack_from("<H", e, 64)[0], e[66]
            start, size = struct.unpack_from("<II", e, 116)
            name = e[: max(0, min(length, 64) - 2)].decode("utf-16-le", "replace")
            if kind == 5:
                self.ministream = self.chain(start)[:size] if size else b""
            elif kind == 2:
                self.entries[name] = (start, size)

    def sector(self, n: int) -> bytes:
        at = (n + 1) * self.size
        s = self.data[at : at + self.size]
        if not s:
            raise invalid(REASON)
        return s.ljust(self.size, b"\0")

    def chain(self, at: int) -> bytes:
        out, seen = [], set()
        while at < _END:
            if at in seen or at >= len(self.fat):
                raise invalid(REASON)
            seen.add(at)
            out.append(self.sector(at))
            at = self.fat[at]
        return b"".join(out)

    def stream(self, name: str) -> bytes | None:
        if name not in self.entries:
            return None
        start, size = self.entries[name]
        if size >= self.cutoff:
            return self.chain(start)[:size]
        out, seen = [], set()
        while start < _END:
            if start in seen or start >= len(self.minifat):
                raise invalid(REASON)
            seen.add(start)
            out.append(self.ministream[start * self.mini : (start + 1) * self.mini])
            start = self.minifat[start]
        return b"".join(out)[:size]


def _pieces(word: bytes, table: bytes) -> str:
    at, size = struct.unpack_from("<II", word, 0x1A2)
    clx, out = table[at : at + size], []
    i = 0
    while i < len(clx) and clx[i] == 1:
        i += 3 + struct.unpack_from("<H", clx, i + 1)[0]
    if i >= len(clx) or clx[i] != 2:
        raise invalid(REASON)
    n = (struct.unpack_from("<I", clx, i + 1)[0] - 4) // 12
    ends = struct.unpack_from(f"<{n + 1}I", clx, i + 5)
    for k in range(n):
        fc = struct.unpack_from("<I", clx, i + 5 + 4 * (n + 1) + 8 * k + 2)[0]
        length = ends[k + 1] - ends[k]
        if fc & 0x40000000:
            start = (fc & 0x3FFFFFFF) // 2
            out.append(word[start : start + length].decode("cp1252", "replace"))
        else:
            out.append(word[fc : fc + 2 * length].decode("utf-16-le", "replace"))
    return "".join(out)


def text(data: bytes) -> str:
    try:
        c = Compound(data)
        word = c.stream("WordDocument")
        if word is None or len(word) < 0x1AA or struct.unpack_from("<H", word)[0] != 0xA5EC:
            raise invalid(REASON)
        flags = struct.unpack_from("<H", word, 10)[0]
        if flags & 0x0100:  # encrypted
            raise invalid(REASON)
        table = c.stream("1Table" if flags & 0x0200 else "0Table")
        if table is None:
            raise invalid(REASON)
        raw = _pieces(word, table)[: struct.unpack_from("<I", word, 0x4C)[0]]
    except (struct.error, IndexError, OverflowError, MemoryError):
        raise invalid(REASON) from None
    out, fields = [], []
    for ch in raw:
        if ch == "\x13":
            fields.append(False)
        elif ch == "\x14" and fields:
            fields[-1] = True
        elif ch == "\x15" and fields:
            fields.pop()
        elif all(fields):
            out.append({"\r": "\n", "\x07": "\t", "\x0b": "\n", "\x0c": "\n", "\x0e": "\n", "\x1e": "-", "\x1f": "", "\x01": "", "\x08": ""}.get(ch, ch))
    return "".join(out)
