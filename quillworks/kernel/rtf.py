"""Plain text of RTF: groups, destinations, code pages and Unicode escapes."""

from __future__ import annotations

import re

from quillworks.kernel import invalid

_TOKEN = re.compile(rb"\\([a-zA-Z]{1,32})(-?\d{1,10})? ?|\\'([0-9a-fA-F]{2})|\\([^a-zA-Z])|([{}])|([^\\{}\r\n]+)|[\r\n]+", re.S)
#: Destinations whose content is no text of the document.
SKIPPED = """fonttbl colortbl stylesheet info pict object header headerl headerr headerf footer footerl footerr footerf footnote annotation
listtable listoverridetable generator themedata colorschememapping latentstyles datastore xmlnstbl rsidtbl revtbl filetbl fldinst bkmkstart
bkmkend nonshppict mmathPr pgptbl sp sn sv""".split()
_SKIPPED = {s.encode() for s in SKIPPED}
_SIGNS = {b"par": "\n", b"sect": "\n", b"page": "\n", b"line": "\n", b"row": "\n", b"tab": "\t", b"cell": "\t", b"nestcell": "\t", b"emdash": "—", b"endash": "–", b"bullet": "•", b"lquote": "‘", b"rquote": "’", b"ldblquote": "“", b"rdblquote": "”", b"emspace": " ", b"enspace": " "}


#: Code pages of the font character sets; those not listed use the document's.
CHARSETS = {77: "mac_roman", 128: "cp932", 129: "cp949", 130: "johab", 134: "cp936", 136: "cp950", 161: "cp1253", 162: "cp1254", 163: "cp1258", 177: "cp1255", 178: "cp1256", 186: "cp1257", 204: "cp1251", 222: "cp874", 238: "cp1250", 255: "cp437"}


def _page(number: int) -> str:
    name = {10000: "mac_roman", 65001: "utf-8"}.get(number, f"cp{number}")
    try:
        b"".decode(name)
    except LookupError:
        return "cp1252"
    return name


class _Text:
    """Text as it comes; bytes wait until all of a character can be there, and are decoded together."""

    def __init__(self) -> None:
        self.done: list[str] = []
        self.waiting, self.page = bytearray(), "cp1252"
        self.high: int | None = None

    def flush(self) -> None:
        if self.waiting:
            self.done.append(self.waiting.decode(self.page, "replace"))
            self.waiting.clear()

    def read(self, data: bytes, page: str) -> None:
        if page != self.page:
            self.flush()
            self.page = page
        self.waiting += data

    def put(self, text: str) -> None:
        self.flush()
        self.done.append(text)

    def unit(self, n: int) -> None:
        """A UTF-16 unit; a high surrogate waits for its low one."""
        if 0xD800 <= n < 0xDC00:
            self.high = n
            return
        if not 0xDC00 <= n < 0xE000:
            self.put(chr(n))
        elif self.high is not None:
            self.put(chr(0x10000 + ((self.high - 0xD800) << 10) + n - 0xDC00))
        self.high = None


def text(data: bytes) -> str:
    """The document's text; group state is (left out, bytes after a Unicode escape, font)."""
    if not data.lstrip(b"\xef\xbb\xbf \t\r\n").startswith(b"{\\rtf"):
        raise invalid("Could not parse RTF document.")
    out, page, fonts, default = _Text(), "cp1252", {}, None
    skip, uc, font, owed, star = False, 1, None, 0, False
    stack: list[tuple] = []
    at = 0
    while at < len(data):
        m = _TOKEN.match(data, at)
        if m is None:
            at += 1
            continue
        at = m.end()
        word, arg, hexed, sign, brace, plain = m.groups()
        n = int(arg) if arg else None
        here = fonts.get(font, page)
        if brace == b"{":
            stack.append((skip, uc, font))
            star, owed = False, 0
        elif brace == b"}":
            if not stack:
                break
            skip, uc, font = stack.pop()
            owed = 0
            if not stack:
                out.flush()
                return "".join(out.done)
        elif word == b"bin":
            at += max(0, n or 0)  # raw bytes, whatever they look like
            owed = max(0, owed - 1)
            star = False
        elif word is not None:
            if word == b"u" and n is not None:
                if not skip:
                    out.unit(n & 0xFFFF)
                owed = uc
            elif word == b"uc":
                uc = max(0, 1 if n is None else n)
            elif word == b"ansicpg" and n is not None:
                page = _page(n)
            elif word == b"mac":
                page = "mac_roman"
            elif word == b"deff":
                default = font = n
            elif word == b"f":
                font = n
            elif word == b"fcharset" and n in CHARSETS:
                fonts[font] = CHARSETS[n]
            elif word == b"plain":
                font = default
            elif star or word in _SKIPPED:
                skip = True
            elif not skip and word in _SIGNS:
                out.put(_SIGNS[word])
            star = False
        elif hexed is not None:
            if owed:
                owed -= 1
            elif not skip:
                out.read(bytes([int(hexed, 16)]), here)
        elif sign is not None:
            if sign == b"*":
                star = True
            elif owed:
                owed -= 1
            elif not skip:
                out.put({b"~": "\xa0", b"_": "-", b"-": "", b"\n": "\n", b"\r": "\n"}.get(sign, sign.decode("latin-1") if sign in b"\\{}" else ""))
        elif plain is not None:
            cut = min(owed, len(plain))
            owed, plain = owed - cut, plain[cut:]
            if not skip and plain:
                out.read(plain, here)
    raise invalid("Could not parse RTF document.")
