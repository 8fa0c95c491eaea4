"""Bytes to text: byte order marks, UTF-16 without one, UTF-8, and legacy encodings last."""

from __future__ import annotations

from quillworks.kernel import Unreadable

#: First bytes of formats that are no text.
BINARY = ["89504E47", "FFD8FF", "47494638", "255044462D", "504B0304", "504B0506", "504B0708"]
_BINARY = tuple(bytes.fromhex(x) for x in BINARY)
_BOMS = ((b"\xef\xbb\xbf", "utf-8", "utf-8-bom"), (b"\xff\xfe", "utf-16-le", "utf-16le-bom"), (b"\xfe\xff", "utf-16-be", "utf-16be-bom"))
_ALLOWED_CONTROLS = {0x09, 0x0A, 0x0C, 0x0D}


def _utf16_guess(data: bytes) -> str | None:
    """The byte order that zero bytes give away in the first 2048 bytes."""
    if len(data) < 4 or len(data) % 2:
        return None
    head = data[:2048]
    pairs = len(head) // 2
    strong, weak = max(2, pairs // 3), max(1, pairs // 20)
    even, odd = head[0 : 2 * pairs : 2].count(0), head[1 : 2 * pairs : 2].count(0)
    if odd >= strong and even <= weak:
        return "utf-16-le"
    return "utf-16-be" if even >= strong and odd <= weak else None


def _looks_binary(data: bytes) -> bool:
    if data.startswith(_BINARY):
        return True
    head = data[:4096]
    controls = sum(b < 0x20 and b not in _ALLOWED_CONTROLS for b in head)
    return 0 in head or controls * 10 > len(head)


def decode(data: bytes) -> tuple[str, str, bool]:
    """(text, name of the encoding, whether it was a legacy one)."""
    bad = Unreadable("unreadableTextEncoding", "")
    if not data:
        return "", "empty", False
    for mark, codec, name in _BOMS:
        if data.startswith(mark):
            try:
                return data[len(mark) :].decode(codec), name, False
            except UnicodeDecodeError:
                raise bad from None
    if codec := _utf16_guess(data):
        try:
            return data.decode(codec), codec.replace("16-", "16") + "-inferred", False
        except UnicodeDecodeError:
            pass
    try:
        return data.decode("utf-8"), "utf-8", False
    except UnicodeDecodeError:
        pass
    if _looks_binary(data):
        raise bad
    try:
        return data.decode("cp1252"), "windows-1252", True
    except UnicodeDecodeError:
        return data.decode("latin-1"), "iso-8859-1", True


def decode_web(data: bytes) -> str:
    """Text of a page; raises unreadableArticle for no bytes, unreadableEncoding for what is no text."""
    if not data:
        raise Unreadable("unreadableArticle", "")
    try:
        if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
            text = data.decode("utf-16")
        elif data[:3] == b"\xef\xbb\xbf":
            text = data[3:].decode("utf-8")
        else:
            try:
                text = data.decode("utf-8")
            except UnicodeDecodeError:
                text = data.decode("cp1252")
    except UnicodeDecodeError:
        raise Unreadable("unreadableEncoding", "") from None
    if "\0" in text:
        raise Unreadable("unreadableEncoding", "")
    return text
