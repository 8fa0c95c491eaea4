"""Main content of web pages as typed blocks: a tolerant tree, a choice of the content node, a walk."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html.parser import HTMLParser

from quillworks.kernel import Unreadable

# Element roles.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
IGNORED = set("script style noscript svg nav footer form button input select textarea".split())
INLINE = set("a span em strong b i u small sup sub mark time br wbr".split())
ENDS_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ROLES = {"p": "paragraph", "li": "listItem", "dt": "listItem", "dd": "listItem", "blockquote": "quote", "pre": "code", "table": "table", "figcaption": "caption"} | {f"h{n}": "heading" for n in range(1, 7)}
SILENT = {"script", "style", "noscript"}
BOXED = set("p div li tr td th ul ol blockquote h1 h2 h3 h4 h5 h6".split())
#: Elements whose end tag may be missing: what ends them, and what they are never looked for beyond.
_LEFT_OPEN = [
    (ENDS_P, {"p"}, {"table", "td", "th", "li", "blockquote", "div", "article", "section", "button"}),
    ({"li"}, {"li"}, {"ul", "ol", "menu"}), ({"dt", "dd"}, {"dt", "dd"}, {"dl"}), ({"tr"}, {"tr", "td", "th"}, {"table"}), ({"td", "th"}, {"td", "th"}, {"tr", "table"}), ({"option"}, {"option"}, {"select"}),
]
_ASIDE = re.compile(r"(?:^|[\s_-])(?:nav|menu|sidebar|breadcrumbs?|cookie|consent|share|social|promo|advert\w*|ads?|sponsor\w*|related|recommend\w*|newsletter|subscribe|comments?|footer|masthead|toolbar|pagination|popup|modal|banner)(?:$|[\s_-])", re.I)
_BODY = re.compile(r"(?:^|[\s_-])(?:article|content|post|entry|story|main|body|text)(?:$|[\s_-])", re.I)


class Node:
    __slots__ = ("tag", "attrs", "kids", "up", "open")

    def __init__(self, tag: str, attrs: dict[str, str], up: Node | None) -> None:
        self.tag, self.attrs, self.kids, self.up = tag, attrs, [], up
        #: For each group of _LEFT_OPEN the outermost such element around here, or none.
        before = up.open if up else (None,) * len(_LEFT_OPEN)
        self.open = tuple((b or self) if tag in tags else None if tag in walls else b for b, (_, tags, walls) in zip(before, _LEFT_OPEN)) if tag in _OPENERS else before

    def walk(self):
        """This node and its descendants, in document order."""
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            if isinstance(n, Node):
                todo += reversed(n.kids)

    def elements(self, *tags: str):
        return (n for n in self.walk() if isinstance(n, Node) and (not tags or n.tag in tags))


_OPENERS = {t for _, tags, walls in _LEFT_OPEN for t in tags | walls}


class _Builder(HTMLParser):
    def __init__(self, most: int) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)
        self.n, self.most, self.names = 0, most, Counter()

    def _up_to(self, n: Node) -> None:
        """Close everything inside n, and n."""
        while self.at is not n.up:
            self.names[self.at.tag] -= 1
            self.at = self.at.up

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.n += 1
        if self.n > self.most:
            raise Unreadable("tooManyDOMElements", str(self.most))
        for k, (by, _, _) in enumerate(_LEFT_OPEN):
            if tag in by and (n := self.at.open[k]):
                self._up_to(n)
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node
            self.names[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "path"):
            self._up_to(self.at)

    def handle_endtag(self, tag: str) -> None:
        if self.names[tag] > 0:
            n = self.at
            while n.tag != tag:
                n = n.up
            self._up_to(n)

    def handle_data(self, data: str) -> None:
        self.at.kids.append(data)


def tree(text: str, most: int = 50_000) -> Node:
    b = _Builder(most)
    b.feed(text)
    b.close()
    return b.root


def squeeze(s: str) -> str:
    return " ".join(s.split())


def plain_text(node: Node) -> str:
    """Text of a node in one line."""
    return squeeze("".join(n if isinstance(n, str) else " " for n in node.walk() if isinstance(n, str) or n.tag in BOXED or n.tag == "br"))


@dataclass
class Page:
    title: str | None = None
    site: str | None = None
    author: str | None = None
    language: str | None = None
    published: str | None = None
    drafts: list[tuple[str, int | None, str]] = field(default_factory=list)


class Draft:
    """One block while its text comes in; a table keeps its rows, each a list of cells."""

    def __init__(self, kind: str, level: int | None = None) -> None:
        self.kind, self.level, self.parts = kind, level, []
        self.rows: list[list[list[str]]] = []
        self.within: list[list] = []  # rows and cells that are open

    def add(self, text: str) -> None:
        if self.kind == "table":
            for kind, at in self.within:
                if kind == "cell":
                    at.append(text)
        else:
            self.parts.append(text)

    def gap(self) -> None:
        self.add("\n" if self.kind == "code" else " ")

    def enter(self, tag: str) -> None:
        if self.kind == "table" and tag == "tr":
            self.rows.append([])
            self.within.append(("row", self.rows[-1]))
        elif self.kind == "table" and tag in ("td", "th"):
            cell: list[str] = []
            for kind, at in self.within:
                if kind == "row":
                    at.append(cell)
            self.within.append(("cell", cell))
        elif tag in BOXED and self.parts:
            self.gap()

    def leave(self, tag: str) -> None:
        if self.kind == "table" and tag in ("tr", "td", "th"):
            self.within.pop()
        elif tag in BOXED:
            self.gap()

    def text(self) -> str:
        if self.kind == "table":
            lines = ("\t".join(c for c in (squeeze("".join(cell)) for cell in row) if c) for row in self.rows)
            return "\n".join(line for line in lines if line)
        raw = "".join(self.parts)
        return raw.replace("\r\n", "\n").replace("\r", "\n").strip() if self.kind == "code" else squeeze(raw)


def typed_blocks(top: Node, o) -> list[tuple[str, int | None, str]]:
    """The parts of a content node with their roles, in one pass.

    Text goes to the draft that is open: that of the nearest element with a role, or of loose text in a
    wrapper, which ends where another block starts.  A list item inside another opens its own
    draft; drafts come in the order in which they were opened.
    """
    drafts: list[Draft] = []
    loose = [None]  # the drafts of loose text, one for each wrapper that is open
    todo: list[tuple] = [("visit", top, 0, 0, None)]

    def opened(kind: str, level: int | None = None) -> Draft:
        drafts.append(Draft(kind, level))
        return drafts[-1]

    while todo:
        act, n, depth, inner, draft = todo.pop()
        if act == "leave":
            if draft:
                draft.leave(n.tag)
            else:
                loose.pop()
            continue
        if isinstance(n, str):
            if draft is None:
                loose[-1] = loose[-1] or opened("preservedContent")
            (draft or loose[-1]).add(n)
            continue
        if max(depth, inner) > o.max_dom_depth:
            raise Unreadable("domTooDeep", str(o.max_dom_depth))
        if draft is None and (n.tag in IGNORED or n.tag == "p" and "byline" in n.attrs.get("class", "").split()) or draft and n.tag in SILENT:
            continue
        if draft is None and n.tag in INLINE:
            loose[-1] = draft = loose[-1] or opened("preservedContent")
        if n.tag == "br" and draft:
            draft.add("\n")
        elif draft is None and n.tag in ROLES or draft and draft.kind == "listItem" and n.tag == "li":
            loose[-1] = None
            kind = ROLES[n.tag]
            own = opened(kind, int(n.tag[1]) if kind == "heading" else None)
            todo += [("visit", k, depth + inner + 1, 1, own) for k in reversed(n.kids)]
        elif draft:
            draft.enter(n.tag)
            todo.append(("leave", n, 0, 0, draft))
            todo += [("visit", k, depth, inner + 1, draft) for k in reversed(n.kids)]
        else:
            loose[-1] = None
            loose.append(None)
            todo.append(("leave", n, 0, 0, None))
            todo += [("visit", k, depth + 1, 0, None) for k in reversed(n.kids)]
    out = [(d.kind, d.level, t) for d in drafts if (t := d.text())]
    if len(out) > o.max_blocks:
        raise Unreadable("tooManyBlocks", str(o.max_blocks))
    return out


def _label(n: Node) -> str:
    return f"{n.attrs.get('class', '')} {n.attrs.get('id', '')}"


def _set_aside(n: Node, holds: set[int]) -> bool:
    if n.tag in IGNORED or n.tag == "aside" or n.attrs.get("hidden") is not None and "hidden" in n.attrs or n.attrs.get("aria-hidden") == "true":
        return True
    return n.tag in ("div", "section", "ul", "ol", "header", "p", "span") and bool(_ASIDE.search(_label(n))) and not _BODY.search(_label(n)) and id(n) not in holds


def content_node(root: Node) -> Node | None:
    """The node with the article: article and main first, then the box whose paragraphs score best.

    A paragraph gives a point, one for each comma and up to three for its length, to its parent, and half
    of that to its grandparent; a box's score falls with the share of its text that is links.
    """
    body = next(root.elements("body"), root)
    holds: set[int] = set()  # elements around a main heading, article or main element
    for n in body.elements("h1", "article", "main"):
        while n and id(n) not in holds:
            holds.add(id(n))
            n = n.up
    for n in list(body.elements()):  # furniture goes before anything is scored
        n.kids = [k for k in n.kids if isinstance(k, str) or not _set_aside(k, holds)]
    sums: dict[int, tuple[int, int, int]] = {}  # letters, letters in links, commas
    for e in reversed(list(body.elements())):
        size = linked = commas = 0
        for k in e.kids:
            if isinstance(k, str):
                size, commas = size + len(squeeze(k)), commas + k.count(",") + k.count("、")
            else:
                a, b, c = sums[id(k)]
                size, linked, commas = size + a, linked + b, commas + c
        sums[id(e)] = (size, size if e.tag == "a" else linked, commas)
    own = lambda n: sums[id(n)][0] - sums[id(n)][1]
    scores: dict[int, list] = {}
    for p in body.elements("p", "pre", "blockquote", "td", "li", "div", "section"):
        if p.tag in ("div", "section") and any(isinstance(k, Node) and k.tag not in INLINE for k in p.kids):
            continue
        size, linked, commas = sums[id(p)]
        if size < 25 or linked * 2 > size:
            continue
        points = 1 + (commas if size < 4000 else 0) + min(size / 100, 3)
        for n, share in ((p.up, 1.0), (p.up.up if p.up else None, 0.5)):
            if n:
                scores.setdefault(id(n), [n, 0.0])[1] += points * share
    named = [n for n in body.elements("article", "main") if own(n) >= 40] or [n for n in body.elements() if n.attrs.get("role") == "main"]
    if named:
        most = max(sums[id(n)][0] for n in named)
        return max(named, key=lambda n: (n.tag == "article") * 10_000 * (sums[id(n)][0] * 2 > most) + own(n))
    best, top = None, 0.0
    for n, points in scores.values():
        size, linked, _ = sums.get(id(n), (1, 0, 0))
        points = points * (1 - linked / max(1, size)) + 5 * bool(_BODY.search(_label(n)))
        if best is None or points > top:
            best, top = n, points
    while best and best.up and id(best.up) in sums and best.up.tag not in ("#root", "html", "body") and own(best.up) <= 1.2 * own(best):
        best = best.up
    return best


def _metas(root: Node) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in root.elements("meta"):
        key = (m.attrs.get("property") or m.attrs.get("name") or "").strip().lower()
        if key and m.attrs.get("content", "").strip():
            out.setdefault(key, m.attrs["content"].strip())
    return out


def read(text: str, o) -> Page:
    root = tree(text, o.max_dom_elements)
    metas, page = _metas(root), Page()
    heading = next(root.elements("title"), None)
    page.title = metas.get("og:title") or (plain_text(heading) if heading else None) or None
    page.site = metas.get("og:site_name")
    byline = next((n for n in root.elements() if "byline" in n.attrs.get("class", "").split() or n.attrs.get("rel") == "author" or n.attrs.get("itemprop") == "author"), None)
    page.author = metas.get("author") or metas.get("article:author") or (plain_text(byline) if byline else None)
    html = next(root.elements("html"), None)
    page.language = (html.attrs.get("lang") if html else None) or metas.get("og:locale") or None
    stamp = next((t.attrs["datetime"] for t in root.elements("time") if t.attrs.get("datetime")), None)
    page.published = metas.get("article:published_time") or metas.get("date") or metas.get("datepublished") or stamp
    node = content_node(root)
    if node is None:
        raise Unreadable("unreadableArticle", "")
    page.drafts = typed_blocks(node, o)
    return page
