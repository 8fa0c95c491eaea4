"""Text normalisation as one chain of expressions.

Regular expressions spell classes out (Java's are ASCII by default) and use possessive or flat
quantifiers only, so that a long line can't overflow the matcher's stack.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quillworks.options import ExtractOptions

_WHITE = "[\\t-\\r\\x85\\p{Z}]"
#: What counts as a space and as a digit in patterns that the contract states with Unicode classes.
S, D = "[\\t\\n\\f\\r\\p{Z}]", "\\p{Nd}"


def rx(col: Column, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(col, F.lit(pattern), F.lit(to))


def trim_all(col: Column) -> Column:
    """Unicode white space and line ends off both ends."""
    return rx(col, f"\\A{_WHITE}++|(?<!{_WHITE}){_WHITE}++\\z")


def unify_lines(col: Column) -> Column:
    return rx(col, "\\r\\n?|[\\u2028\\u2029]", "\n")


def drop_controls(col: Column) -> Column:
    """C0 controls but tab and line feed; DEL and C1 stay."""
    return rx(col, "[\\x00-\\x08\\x0b-\\x1f]")


def normalize(col: Column, options: ExtractOptions = ExtractOptions()) -> Column:
    s = drop_controls(F.translate(unify_lines(col), " ​", " "))
    if not options.normalize_whitespace:
        return trim_all(s)
    s = rx(s, "[ \\t]++", " ")
    s = rx(s, "(?md)^[\\p{Zs}\\t]++|(?<![\\p{Zs}\\t])[\\p{Zs}\\t]++$")
    if options.preserve_paragraphs:
        s = rx(s, "\\n{3,}+", "\n\n")
    else:
        s = rx(rx(s, "\\n", " "), "[\\t\\n\\f\\r\\p{Z}]++", " ")
    return trim_all(s)


def normalize_cells(col: Column, options: ExtractOptions = ExtractOptions()) -> Column:
    """Normalises each tab-parted cell; empty cells at the edges vanish."""
    cells = F.transform(F.split(col, "\t", -1), lambda c: normalize(c, options))
    return F.when(F.contains(col, F.lit("\t")), trim_all(F.array_join(cells, "\t"))).otherwise(normalize(col, options))


def join_paragraphs(parts: Column, separator: str) -> Column:
    kept = F.filter(F.transform(parts, trim_all), lambda p: p != "")
    return F.array_join(kept, separator)
