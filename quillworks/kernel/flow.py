"""Paragraphs and table rows of office XML, one engine for three vocabularies.

A part is read into a tree of elements by local name; blocks are the outermost paragraphs and the rows of
the outermost tables, each rendered from its own subtree.  A vocabulary says which elements are
paragraphs, rows and cells, where text counts, what stands for a tab or a break, and what is left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.parsers import expat


class BadXml(Exception):
    pass


class Element:
    __slots__ = ("name", "attributes", "kids")

    def __init__(self, name: str, attributes: dict[str, str]) -> None:
        self.name, self.attributes, self.kids = name.rpartition(":")[2], attributes, []

    def get(self, name: str) -> str | None:
        """An attribute by its local name."""
        return next((v for k, v in self.attributes.items() if k.rpartition(":")[2] == name), None)

    def below(self, *names: str) -> Iterator[Element]:
        """Descendants of these names, in document order."""
        todo = self.kids[::-1]
        while todo:
            e = todo.pop()
            if isinstance(e, Element):
                if e.name in names:
                    yield e
                todo += e.kids[::-1]


def parse(data: bytes) -> Element:
    """The root of well-formed XML; entity declarations are refused."""
    top = Element("", {})
    open_ = [top]

    def start(name: str, attributes: dict[str, str]) -> None:
        e = Element(name, attributes)
        open_[-1].kids.append(e)
        open_.append(e)

    def refuse(*_) -> None:
        raise BadXml("entity declaration")

    p = expat.ParserCreate()
    p.buffer_text = True
    p.StartElementHandler, p.EndElementHandler, p.EntityDeclHandler = start, lambda _: open_.pop(), refuse
    p.CharacterDataHandler = lambda text: open_[-1].kids.append(text)
    try:
        p.Parse(data, True)
    except (expat.ExpatError, ValueError):
        raise BadXml("not well-formed") from None
    return top


def whole(s: str | None) -> int | None:
    return int(s) if s is not None and re.fullmatch(r"[+-]?\d{1,9}", s) else None


@dataclass(frozen=True)
class Vocabulary:
    paragraphs: frozenset[str]
    table: str
    row: str
    cells: frozenset[str]
    runs: str | None = None  # text counts inside these only; None: anywhere in a paragraph
    signs: dict[str, str] = field(default_factory=dict)
    out: frozenset[str] = frozenset()  # subtrees that are left out
    notes: frozenset[str] = frozenset()  # left out if their id says that they are separators
    spaces: str | None = None  # an element that stands for so many spaces
    item: str | None = None  # paragraphs in these get a bullet
    inner_gap: str = ""  # what parts a paragraph inside a paragraph from the text before


# Element names of the three vocabularies.
WORD = Vocabulary(frozenset({"p"}), "tbl", "tr", frozenset({"tc"}), "t", {"tab": "\t", "br": "\n", "cr": "\n"}, out=frozenset({"del", "delText", "instrText"}), notes=frozenset({"footnote", "endnote"}))
TEXT = Vocabulary(frozenset({"p", "h"}), "table", "table-row", frozenset({"table-cell", "covered-table-cell"}), None, {"tab": "\t", "line-break": "\n"}, out=frozenset({"tracked-changes", "annotation"}), spaces="s", item="list-item", inner_gap=" ")
SLIDE = Vocabulary(frozenset({"p"}), "tbl", "tr", frozenset({"tc"}), "t", {"tab": "\t", "br": "\n"})


@dataclass
class Block:
    text: str
    number: tuple[str, int] | None = None  # numbering id and level
    listed: bool = False
    row: bool = False


class Reader:
    """Renders the blocks of one part; ``frames`` names the placeholders whose shapes are left out."""

    def __init__(self, v: Vocabulary, frames: frozenset[str] = frozenset()) -> None:
        self.v, self.frames = v, frames

    def skipped(self, e: Element) -> bool:
        v = self.v
        if e.name in v.out or e.name in v.notes and e.get("id") in ("-1", "0"):
            return True
        return bool(self.frames) and e.name == "sp" and any((p.get("type") or "").lower() in self.frames for p in e.below("ph"))

    def outermost(self, top: Element, names: frozenset[str], listed: bool = False) -> Iterator[tuple[Element, bool]]:
        """Descendants of these names that aren't inside another, with whether they are in a list item."""
        todo = [(k, listed) for k in top.kids[::-1]]
        while todo:
            e, listed = todo.pop()
            if isinstance(e, str) or self.skipped(e):
                continue
            if e.name in names:
                yield e, listed
            else:
                inside = listed or e.name == self.v.item
                todo += [(k, inside) for k in e.kids[::-1]]

    def text(self, paragraph: Element) -> str:
        v, out = self.v, []
        todo = [(k, v.runs is None) for k in paragraph.kids[::-1]]
        while todo:
            e, counts = todo.pop()
            if isinstance(e, str):
                if counts:
                    out.append(e)
            elif not self.skipped(e):
                if e.name in v.signs:
                    out.append(v.signs[e.name])
                elif e.name == v.spaces:
                    n = whole(e.get("c") or "1")
                    out.append(" " * min(max(1 if n is None else n, 1), 1024))
                elif e.name in v.paragraphs:
                    out.append(v.inner_gap)
                inside = counts or e.name == v.runs
                todo += [(k, inside) for k in e.kids[::-1]]
        return re.sub(r"\n{3,}", "\n\n", re.sub(r" {2,}", " ", "".join(out))).strip()

    def number(self, paragraph: Element) -> tuple[str, int] | None:
        """Numbering id and level, the last of each; an unreadable level counts as none."""
        ids = [e.get("val") for props in paragraph.below("numPr") for e in props.below("numId")]
        levels = [e.get("val") for props in paragraph.below("numPr") for e in props.below("ilvl")]
        named = [x for x in levels if x is not None]
        return (ids[-1], (whole(named[-1]) if named else 0) or 0) if ids and ids[-1] is not None else None

    def paragraph(self, e: Element, listed: bool) -> Iterator[Block]:
        if text := self.text(e):
            yield Block("• " + text if listed else text, self.number(e) if self.v is WORD else None, listed)

    def rows(self, table: Element, listed: bool) -> Iterator[Block]:
        v = self.v
        for row, inside in self.outermost(table, v.paragraphs | {v.row}, listed):
            if row.name != v.row:
                yield from self.paragraph(row, inside)
                continue
            cells = []
            for cell, _ in self.outermost(row, v.cells):
                texts = (self.text(p) for p, _ in self.outermost(cell, v.paragraphs))
                cells.append(" ".join(t for t in texts if t))
            if line := "\t".join(cells).strip():
                yield Block(line, row=True)

    def blocks(self, top: Element) -> Iterator[Block]:
        for e, listed in self.outermost(top, self.v.paragraphs | {self.v.table}):
            yield from self.rows(e, listed) if e.name == self.v.table else self.paragraph(e, listed)


def blocks(data: bytes, v: Vocabulary, frames: frozenset[str] = frozenset()) -> list[Block]:
    return list(Reader(v, frames).blocks(parse(data)))
