"""Readable text of Markdown, step by step in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quillworks.functions.html import decode_entities, strip_tags
from quillworks.functions.text import D, S, normalize, rx
from quillworks.options import ExtractOptions


def strip_front_matter(col: Column) -> Column:
    return rx(col, "\\A---\\n(?s:.*?)\\n---\\n")


def strip_fences(col: Column) -> Column:
    """Fenced blocks go, each fence leaves an empty line; an open one drops the rest."""
    opener = "(?md)^[\\p{Zs}\\t]*+(([`~])\\2{2,}+)[^\\n]*+"
    closed = rx(col, opener + "(?:\\n(?![\\p{Zs}\\t]*+\\1)[^\\n]*+)*+(\\n)[\\p{Zs}\\t]*+\\1[^\\n]*+", "$3")
    return rx(closed, opener + "(?s:.*+)\\z")


def _line(col: Column) -> Column:
    not_s = S.replace("[", "[^")
    blank = col.rlike(f"^{S}{{0,3}}\\[[^\\]]+\\]:{S}*{not_s}+") | col.rlike(f"^{S}{{0,3}}(?:=+|-+){S}*$") | col.rlike(f"^{S}*+\\|?{S}*+:?-{{3,}}+:?{S}*+(?:\\|{S}*+:?-{{3,}}+:?{S}*+)++(?:\\|{S}*+)?$")
    s = rx(col, f"^{S}{{0,3}}#{{1,6}}{S}+")
    s = rx(s, f"^{S}*+(?:>{S}*+)++")
    s = rx(s, f"^{S}*+[-*+]{S}++\\[[ xX]\\]{S}++")
    s = rx(s, f"^{S}*+[-*+]{S}++")
    s = rx(s, f"^{S}*+{D}++[.)]{S}++")
    return F.when(blank, "").otherwise(s)


def markdown_text(col: Column, options: ExtractOptions = ExtractOptions()) -> Column:
    if options.markdown_mode == "raw":
        return normalize(col, options)
    s = rx(col, "\\r\\n?", "\n")
    s = strip_front_matter(s)
    if options.drop_markdown_code_blocks:
        s = strip_fences(s)
        s = F.array_join(F.filter(F.split(s, "\n", -1), lambda x: ~x.rlike("^(?: {4}|\\t)")), "\n")
    s = rx(s, "!\\[([^\\]]*+)\\]\\([^\\n)]*+\\)", "$1")
    s = rx(s, "\\[([^\\]]++)\\]\\([^\\n)]*+\\)", "$1")
    s = rx(s, "\\[([^\\]]++)\\]\\[[^\\]]*+\\]", "$1")
    s = rx(s, "(?i)<https?://[^>]++>")
    s = rx(s, "(?i)<mailto:([^>]++)>", "$1")
    s = F.array_join(F.transform(F.split(s, "\n", -1), _line), "\n")
    s = rx(s, "`++([^`\\n]*?)`++", "$1")
    s = rx(s, "(?<!\\\\)(\\*\\*|__)(.*?)(?<!\\\\)\\1", "$2")
    s = rx(s, "(?<!\\\\)(\\*|_)(.*?)(?<!\\\\)\\1", "$2")
    s = rx(s, "~~(.*?)~~", "$1")
    s = rx(s, "\\\\([\\\\`*_{}\\[\\]()#+\\-.!>])", "$1")
    s = F.translate(s, "|", " ")
    return normalize(decode_entities(strip_tags(s)), options)
