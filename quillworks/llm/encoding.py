"""Garbled text from wrong character encoding: round-trip repair.

A line that looks garbled is encoded again under the encodings it may have been read in and decoded
strictly as the encodings it may have been written in.  UTF-8 is tried run by run (a line can hold
good and garbled text side by side) and layer below layer, as long as the round trip is exact; what
lies between need not read well, only the reading with the least garbling cost counts, and is accepted
if it costs less than the line had.  Single-byte encodings are tried on whole lines and must halve the cost.  All is
repeated until no cost drops.  The layers that repaired a text's clear lines are then
tried on its short, unclear ones.  The encoding that the reader reported comes first among the candidates.

Only texts with a suspicious character sequence reach Python.

Defined results: null, empty and plain texts come back as they are, not flagged; a text with
replacement characters, control characters or several UTF-8 sequences that no repair explains is
flagged, with whatever could be repaired; row count, ties and repeated rows stay as in the input.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: (read as, written as), in the order of trial.
PAIRS = [
    *((wrong, "utf-8") for wrong in ("cp1252", "cp1251", "mac_roman", "koi8-r", "cp437", "cp850", "cp1250", "cp932", "gbk")),
    *(("cp1252", right) for right in ("cp1251", "koi8-r", "mac_roman", "cp850", "cp437", "cp866", "cp932", "euc_jp", "gbk", "mac_cyrillic")),
    ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp1251", "cp866"), ("cp866", "cp1251"), ("cp1251", "mac_cyrillic"), ("mac_roman", "cp1252"), ("cp1250", "cp1252"), ("cp850", "cp1252"), ("cp437", "cp1252"),
]
_MULTI = {"utf-8", "cp932", "gbk", "euc_jp"}

_TAIL = "".join(dict.fromkeys(bytes([b]).decode("cp1252", "replace").replace("�", chr(b)) for b in range(0x80, 0xC0)))
_TAIL_1251 = "".join(dict.fromkeys(bytes([b]).decode("cp1251", "replace").replace("�", chr(b)) for b in range(0x80, 0xC0)))
_SYM = "¤¦§¨©¬®¯°±²³´µ¶¸¹º»¼½¾¡¢£¥ª«¿√∂∫≈∑∏◊†‡ˆ‰˜™ƒ€„‚‹›•“”÷×│┤╡╢╖╕╣║╗╝╜╛┐└┴┬├─┼╞╟╚╔╩╦╠═╬╧╨╤╥╙╘╒╓╫╪┘┌█▄▌▐▀░▒▓"
_ODD_CYR = "ЂЃЉЊЌЋЏђѓљњќћџЎўҐґЄєЇїЈЅ"


def _in(chars: str) -> str:
    return "[" + re.escape(chars) + "]"


def _read(codec: str, first: int, last: int) -> str:
    """The characters that bytes from first to last have in an encoding."""
    return "".join(x for b in range(first, last + 1) if (x := bytes([b]).decode(codec, "ignore")))


#: What counts as garbling, with its cost for each occurrence.
SIGNS = [
    ("[\x80-\x84\x86-\x9f�]", 3.0),
    (f"[ÃÂÐÑ]{_in(_TAIL)}", 3.0),
    (f"[âãåæçèéäïàáêëìíîó](?:{_in(_TAIL)}){{2}}", 3.0),
    (f"[РС]{_in(_TAIL_1251)}|{_in(_ODD_CYR)}", 2.0),
    (f"(?<=[^\\W\\d_]){_in(_SYM)}(?=[^\\W\\d_])", 3.0),
    ("(?<=[a-zà-öø-ÿа-яё])[A-ZÀ-ÖØ-ÞŠŽŸŒА-ЯЁ]", 1.0),
    ("[À-ÖØ-öø-ÿ]{3,}", 3.0),
    ("[｡-ﾟ]", 1.0),
    ("[√∂∫≈∑∏◊├┬┴┤]", 1.5),
    ("[縺繧繝荳譁蜿逕謌邱]", 2.0),
    # Signs of punctuation: its first two bytes in UTF-8, read in the encodings where they aren't letters side by side.
    (f"(?:‚[ÄÅÇ]|¬){_in(_read('mac_roman', 0x80, 0xBF))}|ΓÇ{_in(_read('cp437', 0x80, 0xBF))}|ÔÇ{_in(_read('cp850', 0x80, 0xBF))}|Б─{_in(_read('koi8-r', 0x80, 0xBF))}", 3.0),
]
#: Signs that make no text suspicious by themselves: letters of two scripts side by side.
MIXED = [("[A-Za-zÀ-ÿ][Ѐ-ӿ]|[Ѐ-ӿ][A-Za-zÀ-ÿ]", 2.0), ("[A-Za-zÀ-ÿЀ-ӿ][一-鿿]|[一-鿿][A-Za-zÀ-ÿЀ-ӿ]", 3.0)]
_SIGNS = [(re.compile(p), c) for p, c in SIGNS + MIXED]
#: So many UTF-8 sequences read as letters are garbling even where no repair is found; one may be a letter before a closing sign.
CLEAR, _CLOSING = 2, ("»", "›", "”", "’", "…")
#: The same for the JVM; [^\W\d_] is written out there.
_SUSPECT = "|".join(p.replace("[^\\W\\d_]", "\\p{L}") for p, _ in SIGNS if "[a-zà" not in p) + "|(?<=[a-zà-öø-ÿа-яё])[À-ÖØ-ÞА-ЯЁŽŠŸŒ]"
#: Each alternative starts with a character beyond ASCII; the look ahead spares the others.
SUSPECT = f"(?=[^\\x00-\\x7f])(?:{_SUSPECT})"
_RUN = re.compile("[^\x00-\x7f]+")
_PLAUSIBLE = re.compile("[\x00-ſͰ-ϿЀ-ёҐґ‐-⁞€№™←-⋿■-➿　-ヿ一-鿿！-￮\U0001f300-\U0001faff]*")


def cost(text: str) -> float:
    return sum(c * sum(1 for _ in p.finditer(text)) for p, c in _SIGNS)


@lru_cache(maxsize=32)
def _bytes_of(codec: str) -> dict[int, int]:
    """Character to byte for a single-byte encoding; bytes without a character stand for themselves."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            ch = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            ch = chr(b)
        out.setdefault(ord(ch), b)
    # Controls stand for their bytes, as readers pass bytes without a character on; what else lies
    # beyond the encoding must fail, not pass as Latin-1.
    return {c: 0x100 for c in range(0xA0, 0x100)} | {c: c for c in range(0x80, 0xA0)} | out


def plausible(text: str) -> bool:
    return bool(_PLAUSIBLE.fullmatch(text))


def again(text: str, wrong: str, right: str) -> str | None:
    """The text as it reads in the right encoding, None where the round trip isn't exact."""
    try:
        if wrong in _MULTI:
            raw = text.encode(wrong)
        else:
            raw = text.translate(_bytes_of(wrong)).encode("latin-1")
        out = raw.decode(right)
    except UnicodeError:
        return None
    return out if out != text else None


def undone(line: str, wrong: str, right: str) -> str | None:
    """A line with one layer undone: run by run for UTF-8 read in a single-byte encoding, else as a whole."""
    if right != "utf-8" or wrong in _MULTI:
        return again(line, wrong, right)
    out = _RUN.sub(lambda m: again(m.group(), wrong, "utf-8") or m.group(), line)
    return out if out != line else None


def _best(line: str, had: float, pairs: list[tuple[str, str]]) -> tuple[str, float, tuple[tuple[str, str], ...]]:
    """The cheapest reading with its layers.  A strict UTF-8 reading can hardly come about by chance, so any that lowers
    the cost goes first; each layer is shorter than the one above, so the search ends.  Other readings must halve the cost."""
    found, todo, met = (line, had, ()), [(line, ())], {line}
    while todo:
        text, layers = todo.pop()
        for pair in pairs:
            if pair[1] == "utf-8" and (new := undone(text, *pair)) and new not in met:
                met.add(new)
                todo.append((new, (*layers, pair)))
                if plausible(new) and (c := cost(new)) < found[1]:
                    found = (new, c, (*layers, pair))
    if found[2]:
        return found
    found = (line, had / 2 + 1e-9, ())
    for pair in pairs:
        if pair[1] != "utf-8" and (new := again(line, *pair)) and plausible(new) and (c := cost(new)) < found[1]:
            found = (new, c, (pair,))
            if not c:
                break
    return found


#: Names of encodings as readers report them, for those that are candidates.
_NAMES = {"windows-1252": "cp1252", "latin-1": "cp1252", "iso-8859-1": "cp1252", "windows-1251": "cp1251", "windows-1250": "cp1250", "macintosh": "mac_roman", "shift_jis": "cp932", "gb2312": "gbk"}


@lru_cache(maxsize=32)
def _candidates(read_as: str | None) -> list[tuple[str, str]]:
    name = (read_as or "").strip().lower()
    first = _NAMES.get(name, name)
    return sorted(PAIRS, key=lambda pair: pair[0] != first)  # stable: else in the order of trial


def repair(text: str, read_as: str | None = None) -> tuple[str, bool, list[str]]:
    """The repaired text, whether it was garbled, and the layers undone as "read>written"."""
    lines, used, pairs = text.split("\n"), Counter(), _candidates(read_as)
    changed = True
    while changed:  # each round lowers the cost of a line
        changed = False
        ways: Counter = Counter()
        for k, line in enumerate(lines):
            if line.isascii() or not (had := cost(line)):
                continue
            new, c, layers = _best(line, had, pairs)
            if layers:
                lines[k], changed = new, True
                ways[layers] += had - c
        used.update(f"{wrong}>{right}" for layers in ways for wrong, right in layers)
        if ways and ways.most_common(1)[0][1] * 2 > sum(ways.values()):
            layers = ways.most_common(1)[0][0]
            allowed = (layers[-1][1] in ("cp1251", "koi8-r", "cp866", "mac_cyrillic", "cp932", "euc_jp")) * 0.5
            for k, line in enumerate(lines):
                new = None if line.isascii() else line
                for wrong, right in layers:
                    new = new and undone(new, wrong, right)
                if new and plausible(new) and cost(new) < cost(line) + allowed and _same_script(new, lines):
                    lines[k] = new
    out = "\n".join(lines)
    left = bool(re.search("[\x80-\x84\x86-\x9f�]", out))
    left = left or sum(not m.group().endswith(_CLOSING) for p, _ in _SIGNS[1:3] for m in p.finditer(out)) >= CLEAR
    return out, bool(used) or left, list(used)


def _same_script(line: str, lines: list[str]) -> bool:
    """Whether a short line, read anew, is in a script that the repaired text has too."""
    for script in ("[А-яЁё]", "[ぁ-ヿ一-鿿]"):
        if re.search(script, line):
            return any(re.search(script, x) for x in lines)
    return True


def _repair_batches(keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [repair(t, name) for t, name in zip(b.column("text").to_pylist(), b.column("read_as").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.bool_()), pa.array([g[2] for g in got], pa.list_(pa.string()))], [*keys, "text", "garbled", "layers"])

    return run


def suspicious(text: Column) -> Column:
    return text.rlike(SUSPECT)


def repair_texts(df: DataFrame, keys: list[str], text: str, only_suspicious: bool = False, reports: DataFrame | None = None) -> DataFrame:
    """``keys + text, garbled, layers``; only suspicious texts go through Python.

    ``reports``: the keys (or the first of them) with ``read_as``, the encoding that the reader named; only suspicious texts are joined with it.
    """
    if taken := {"text", "garbled", "layers", "read_as"} & set(keys):
        raise ValueError(f"key columns can't be named {sorted(taken)}")
    rows = df.select(*keys, F.col(text).alias("text"))
    types = dict(rows.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "text string, garbled boolean, layers array<string>"])
    odd = rows.filter(suspicious(F.col("text")))
    if reports is None:
        odd = odd.withColumn("read_as", F.lit(None).cast("string"))
    else:
        by = [k for k in keys if k in reports.columns]
        odd = odd.join(reports.groupBy(*by).agg(F.max("read_as").alias("read_as")), by, "left").select(*keys, "text", "read_as")
    mended = odd.mapInArrow(_repair_batches(keys), schema)
    if only_suspicious:
        return mended
    plain = rows.filter(~F.coalesce(suspicious(F.col("text")), F.lit(False)))
    return mended.unionByName(plain.select(*keys, "text", F.lit(False).alias("garbled"), F.array().cast("array<string>").alias("layers")))
