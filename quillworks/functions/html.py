"""Readable text of HTML, without a parser: comments, scripts, breaks, blocks, tags, entities, in this order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F

from quillworks.functions.text import normalize, rx
from quillworks.options import ExtractOptions

#: A private-use character that stands for a block boundary; the same character in the input is set aside meanwhile.
MARK, _ASIDE = "\ue000", "\ue0f1"
#: Named entities and what they stand for.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ndash": "–", "mdash": "—", "hellip": "…", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "copy": "©", "reg": "®", "trade": "™"}
_ENTITY = "&(?:#x[0-9A-Fa-f]++|#[0-9]++|[A-Za-z][A-Za-z0-9]*+);"
#: Elements whose end is a block boundary.
BLOCKS = "p|div|section|article|header|footer|main|aside|nav|h[1-6]|li|tr|blockquote|pre"
_QUOTED = "(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"
_OPENS = "<(?=[\\p{IsAlphabetic}/!?])"


def strip_tags(col: Column) -> Column:
    """Tags become a space; quotes hide an angle bracket; an unended tag drops the rest."""
    return F.when(F.contains(col, F.lit("<")), rx(rx(col, f"{_OPENS}{_QUOTED}>", " "), f"(?s){_OPENS}{_QUOTED}(?:\"[^\"]*+|'[^']*+)?\\z")).otherwise(col)


def _code_point(n: Column) -> Column:
    """The character of a code point; null for what is no scalar value."""
    ok = (n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    return F.when(ok, F.decode(F.unhex(F.lpad(F.hex(F.when(ok, n).otherwise(32)), 8, "0")), "UTF-32"))


def _entity(e: Column) -> Column:
    body = F.substr(e, F.lit(2), F.length(e) - 2)
    named = F.create_map(*(F.lit(x) for kv in ENTITIES.items() for x in kv))
    digits = F.when(body.startswith("#x"), F.conv(F.substr(body, F.lit(3)), 16, 10)).otherwise(F.substr(body, F.lit(2)))
    number = F.when(F.length(digits) <= 10, digits).try_cast("bigint")
    value = F.when(body.startswith("#"), _code_point(number)).otherwise(F.element_at(named, body))
    return F.coalesce(value, e)


def decode_entities(col: Column) -> Column:
    """One pass; unknown and invalid entities stay as they are; nothing is read twice."""
    between = F.split(col, _ENTITY, -1)
    found = F.transform(F.regexp_extract_all(col, F.lit(_ENTITY), F.lit(0)), _entity)
    joined = F.array_join(F.flatten(F.zip_with(between, found, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    return F.when(F.contains(col, F.lit("&")), joined).otherwise(col)


def _place_separators(text: pd.Series, separator: pd.Series) -> pd.Series:
    """For separators that aren't blank: each boundary in turn, from the left."""
    white = " \t\r\n  "

    def one(t: str | None, sep: str) -> str | None:
        if t is None:
            return None
        parts = t.split(MARK)
        out = parts[0]
        for i, part in enumerate(parts[1:], 1):
            out, part = out.rstrip(white), part.lstrip(white)
            rest = part or i + 1 < len(parts)
            out += (sep if out and rest else "") + part
        return out

    return pd.Series([one(t, s) for t, s in zip(text, separator)])


def block_boundaries(col: Column, separator: str) -> Column:
    if separator.strip(" \t\r\n  "):
        return F.pandas_udf(_place_separators, "string")(col, F.lit(separator))
    white = f"[ \\t\\n\\r\\u2028\\u2029{MARK}]"
    edge = f"\\A{white}*{MARK}{white}*+|(?<!{white})(?={white}*{MARK}){white}++\\z"
    return rx(rx(col, edge), f"(?<!{white})(?={white}*?{MARK}){white}++", separator)


#: What markup stands for, in the order in which it is replaced.
STEPS = [
    ("(?s)<!--.*?-->", "\n"),
    ("(?is)<(script|style|noscript)[^>]*+>.*?</\\1>", "\n"),
    ("(?i)<br\\b[^>]*+>", "\n"),
    (f"(?i)<hr\\b[^>]*+>|</(?:{BLOCKS})\\s*+>", MARK),
    ("(?i)<li\\b[^>]*+>", "\n"),
    ("(?i)</t[dh]\\s*+>", "\t"),
]


def _set_aside(col: Column) -> Column:
    both = F.replace(F.replace(col, F.lit(_ASIDE), F.lit(_ASIDE + "1")), F.lit(MARK), F.lit(_ASIDE + "2"))
    return F.when(col.rlike(f"[{MARK}{_ASIDE}]"), both).otherwise(col)


def _put_back(col: Column) -> Column:
    both = F.replace(F.replace(col, F.lit(_ASIDE + "2"), F.lit(MARK)), F.lit(_ASIDE + "1"), F.lit(_ASIDE))
    return F.when(F.contains(col, F.lit(_ASIDE)), both).otherwise(col)


def html_text(col: Column, options: ExtractOptions = ExtractOptions()) -> Column:
    s = _set_aside(col)
    for pattern, to in STEPS:
        s = rx(s, pattern, to)
    s = rx(strip_tags(s), "(?i)&#(?:x0*+e000|0*+57344);", _ASIDE + "2")
    s = block_boundaries(decode_entities(s), options.paragraph_separator if options.preserve_paragraphs else "\n")
    return _put_back(normalize(s, options))
