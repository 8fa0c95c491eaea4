"""Page boilerplate mixed with main content, by a suffix array over the pages of each host.

The token streams of a host's pages are concatenated, line breaks and page ends being tokens too, and
their suffix array (prefix doubling) with its longest common prefixes tells for each line on how
many distinct pages its whole, its label (up to a colon) and its opening recur.  No wording is
listed anywhere: a host without repetition has no furniture.

Lines whose whole or label recurs are covered; the others are unique, and unique sentences, code, tables,
quotes and captions are the solid parts of the article.  What an article repeats by chance (a refrain,
flour and salt in every recipe) is covered too, so each covered form is judged by where it
stands on all pages of the host: outside the solid parts, or between them as a bare phrase, it is
furniture if that holds for ``LIKELY`` of its pages.  On a page, forms of furniture are removed; unique lines go
with them where they stand before the title, after the last solid part and the first
furniture that follows it, or in a container without solid parts.  All other unique runs are kept.

Hot hosts are split into shards of about ``SHARD`` characters, so no group is larger than that (or than
one page).  Their counts are joined: each shard gives digests of its line forms with their pages, then of its covered
forms with the pages where they stand as furniture; the tests apply to the sums of the host, as if it were one group.

Defined results: pages with null id or without lines give nothing; null and blank lines are no pieces;
repeated deliveries of a page count once, and pages of equal content count as one page of their host; a
key delivered with different contents gives a row for each; null hosts form a group of their own;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from quillworks.llm.encoding import SUSPECT, repair
from quillworks.llm.lineage import checkpointed

_GARBLED = re.compile(SUSPECT.replace("\\p{L}", "[^\\W\\d_]"))
SHARD, DEPTH = 2_000_000, 64
#: The shard of hosts that are one group.
WHOLE = -1
#: A line form is covered if it is on at least so many distinct pages of its host.
MIN_PAGES = 3
#: Share of its pages on which a covered form stands as furniture, for it to be furniture.
LIKELY = 0.75
#: Tokens of a line's opening, and the most tokens of a label before its colon.
OPENING, LABEL = 2, 6

_TOKENS = re.compile(r"\d+|[^\W\d_]+|[^\w\s]")
_UNSEEN = re.compile("[\\u200b-\\u200f\\u2060\\ufeff\\u00ad]")
_SPACES = re.compile(r"\s+")
_SENTENCE = re.compile(r"[.!?…。！？][\"'”’»)\]]*$")
#: Kinds of pieces that only an article has, and kinds that say nothing.
_OWN, _BARE_KINDS = ("code", "table", "quote", "caption", "pre"), ("paragraph", "other", "preservedContent", "")


def plain(line: str) -> str:
    return _SPACES.sub(" ", _UNSEEN.sub("", line)).strip()


def tokens(line: str) -> list[str]:
    """Words and signs in small letters; digits count as one token, so years and counters don't hide a repetition."""
    return ["#" if w[0].isdigit() else w for w in _TOKENS.findall(line.lower())]


def forms(words: list[str]) -> list[tuple[str, ...] | None]:
    """What of a line can recur: its whole, its label if it has one, its opening."""
    label = next((tuple(words[: i + 1]) for i in range(1, min(len(words) - 1, LABEL + 1)) if words[i] == ":"), None)
    return [tuple(words), label, tuple(words[:OPENING])]


def suffix_order(tokens: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffix array up to ``depth`` tokens by prefix doubling; and the ranks at each doubling."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    levels, h = [(1, rank)], 1
    while h < depth:
        ahead = np.full(n, -1, dtype=np.int64)
        ahead[: n - h] = rank[h:]
        rank = np.unique(rank * (n + 1) + ahead + 1, return_inverse=True)[1].astype(np.int64)
        h *= 2
        levels.append((h, rank))
        if rank.max() == n - 1:
            break
    return np.argsort(rank, kind="stable"), levels


def common_prefixes(order: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Longest common prefixes of neighbours in the suffix order, up to the sum of the levels."""
    n = len(order)
    a, b = order[:-1].copy(), order[1:].copy()
    out = np.zeros(n - 1, dtype=np.int64)
    for h, rank in reversed(levels):
        ok = (a < n) & (b < n)
        same = np.zeros(n - 1, dtype=bool)
        same[ok] = rank[a[ok]] == rank[b[ok]]
        out += h * same
        a += h * same
        b += h * same
    return out


def recurrence(pages: list[list[list[str]]], min_pages: int = MIN_PAGES) -> list[list[tuple[int, int, int]]]:
    """For each line (as tokens) of each page, on how many distinct pages its whole, label and opening recur (0: fewer than min_pages)."""
    known: dict[str, int] = {}
    whole: dict[tuple, int] = {}  # lines beyond the array's depth are told apart by all their tokens
    stream, asked = [], ([], [], [], [], [])  # start, page, length, which form, long line
    at = []
    for k, lines in enumerate(pages):
        for i, words in enumerate(lines):
            start = len(stream)
            stream.append(0)
            ids = [known.setdefault(w, len(known) + 1) for w in words]
            stream += ids
            for f, form in enumerate(forms(words)):
                if form is not None:
                    size = len(form) + (2 if f == 0 else 1)
                    long = whole.setdefault(tuple(ids), len(whole)) + 1 if size > DEPTH else 0
                    for column, value in zip(asked, (start, k, min(size, DEPTH), f, long)):
                        column.append(value)
                    at.append((k, i, f))
        stream.append(0)
        stream.append(-1 - k)
    out = [[[0, 0, 0] for _ in lines] for lines in pages]
    if len(pages) < min_pages or not at:
        return [[tuple(x) for x in lines] for lines in out]
    order, levels = suffix_order(np.array(stream))
    lcp = common_prefixes(order, levels)
    place = np.empty(len(stream), dtype=np.int64)
    place[order] = np.arange(len(stream))
    start, page, size, form, long = (np.array(c) for c in asked)
    where = place[start]
    by = np.argsort(where, kind="stable")
    for n in np.unique(size):
        mine = by[size[by] == n]
        # Suffixes fall into one group as long as their neighbours share n tokens.
        group = np.concatenate([[0], np.cumsum(lcp < n)])[where[mine]]
        group = np.unique((group * 3 + form[mine]) * (len(whole) + 1) + long[mine], return_inverse=True)[1]
        pairs = np.unique(group * len(pages) + page[mine])
        count = np.bincount(pairs // len(pages), minlength=group.max() + 1)[group]
        for j in np.flatnonzero(count >= min_pages):
            k, i, f = at[mine[j]]
            out[k][i][f] = int(count[j])
    return [[tuple(x) for x in lines] for lines in out]


# Page parts: lines as (pos, kind, box, text); box tells which container a line of page source is in.
_BARE = re.compile(r"\s*(?:<[^<>]*>\s*)+")
_OPEN_CLOSE = re.compile(r"<(/?)(nav|div|section|article|footer|header|aside|main|body|html|head|ul|ol|table|form)\b[^<>]*>", re.I)
_TAGS = re.compile(r"<[^<>]*>")


def source_lines(source: str) -> list[tuple[int, str, str, str]]:
    """Visible lines of page source with the outermost container under the body that they lie in."""
    out, stack, boxes, hidden, in_body, pre = [], [], 0, None, False, False
    for pos, line in enumerate(source.split("\n"), 1):
        if hidden:
            if hidden in line.lower():
                hidden = None
            continue
        small = line.lower()
        if "<body" in small or not in_body and "<head" not in small and "<html" not in small and "<!doctype" not in small and "<title" not in small and "<meta" not in small and "<link" not in small and line.strip():
            in_body = True
        if "<head" in small and "<header" not in small or "<title" in small:
            in_body = "<body" in small or "</head>" in small
            continue
        for tag in ("script", "style"):
            if f"<{tag}" in small and f"</{tag}" not in small:
                hidden = f"</{tag}"
        was_pre, pre = pre, (pre or "<pre" in small) and "</pre" not in small
        if _BARE.fullmatch(line) or not line.strip():
            for m in _OPEN_CLOSE.finditer(line):
                name = m.group(2).lower()
                if name in ("body", "html", "head"):
                    continue
                if m.group(1):
                    if name in stack:
                        while stack and stack.pop() != name:
                            pass
                else:
                    if not stack:
                        boxes += 1
                    stack.append(name)
            if _BARE.fullmatch(line):
                continue
        text = plain(html.unescape(_TAGS.sub(" ", re.sub(r"<(script|style)\b.*?</\1\s*>", "", line, flags=re.I))))
        if not text or not in_body:
            continue
        m = re.search(r"<(h[1-6]|li|p|blockquote|pre|td|figcaption)\b", line, re.I)
        kind = m.group(1).lower() if m else ""
        kind = f"heading:{kind[1]}" if kind[:1] == "h" else {"li": "listItem", "p": "paragraph"}.get(kind, "other")
        if was_pre or pre or "<pre" in small:
            kind = "code"
        outer = stack[0] if stack else ""
        out.append((pos, kind, f"{boxes}:{outer}" if stack else "", text))
    return out


class Page:
    """Lines of a page as (pos, kind, box, text), with their tokens and where their forms recur."""

    def __init__(self, key: tuple, lines: list[tuple[int, str, str, str]]) -> None:
        self.key, self.lines = key, lines
        self.words = [tokens(x[3]) for x in lines]
        self.counts: list[tuple[int, int, int]] = [(0, 0, 0)] * len(lines)

    def form(self, i: int) -> bytes | None:
        """Digest of the form by which a line is covered: its whole, else its label."""
        return _form_digest(self.words[i], 0 if self.counts[i][0] else 1) if self.covered(i) else None

    def spans(self) -> Iterator[tuple[list[int], int, int]]:
        """Parts of the page as (line numbers, start and end of the article among them).

        A page with several containers has each as a part: all of it is article if it has solid lines (if none
        has, the one with most unique text), else none of it.  Any other page is one part.
        """
        boxes: dict[str, list[int]] = {}
        for i, x in enumerate(self.lines):
            boxes.setdefault(x[2], []).append(i)
        if len([b for b in boxes if b]) > 1:
            stay = [b for b, at in boxes.items() if any(self.solid(i) for i in at)]
            stay = stay or [max(boxes, key=lambda b: sum(len(self.lines[i][3]) for i in boxes[b] if not self.covered(i)))]
            for b, at in boxes.items():
                yield at, 0 if b in stay else len(at), len(at)
            return
        n = len(self.lines)
        solid = [i for i in range(n) if self.solid(i)]
        title = next((i for i in range(n) if self.lines[i][1] == "heading:1" and not self.covered(i)), None)
        if solid or title is not None:
            first = min(solid[:1] + [title] if title is not None else solid)
            yield list(range(n)), first, (solid[-1] if solid else title) + 1
        else:
            yield list(range(n)), 0, n

    def covered(self, i: int) -> bool:
        whole, label, _ = self.counts[i]
        return bool(whole or label and self.lines[i][1] in _BARE_KINDS)

    def solid(self, i: int) -> bool:
        """A unique line that only an article has: a sentence, code, a table and the like."""
        _, kind, _, text = self.lines[i]
        said = _SENTENCE.search(text) and (len(text) >= 40 or text.count(" ") >= 5 or text[-1] in "。！？")
        return not self.covered(i) and bool(said or kind in _OWN)

    def places(self) -> dict[bytes, tuple[bool, bool]]:
        """Covered forms of the page: whether each stands as furniture, and outside the article, wherever the page has it."""
        out: dict[bytes, tuple[bool, bool]] = {}
        for at, first, end in self.spans():
            for j, i in enumerate(at):
                if (d := self.form(i)) is not None:
                    _, kind, _, text = self.lines[i]
                    outside, bare = j < first or j >= end, kind in _BARE_KINDS and not _SENTENCE.search(text)
                    right, outer = out.get(d, (True, True))
                    out[d] = right and (outside or bare), outer and outside
        return out

    def furniture(self, known: dict[bytes, bool]) -> list[bool]:
        """Which lines are furniture; ``known`` has the host's forms of furniture, and whether they end an article."""
        found = [known.get(d) if (d := self.form(i)) is not None else None for i in range(len(self.lines))]
        out = [f is not None for f in found]
        for at, first, end in self.spans():
            if first == end:  # a container without article goes if it has any furniture
                if any(out[i] for i in at):
                    for i in at:
                        out[i] = True
                continue
            last = max((j for j in range(first) if out[at[j]]), default=-1)
            for j, i in enumerate(at[:first]):
                out[i] = j <= last or self.counts[i][2] > 0 and self.lines[i][1] in _BARE_KINDS
            for i in at[next((j for j in range(end, len(at)) if found[at[j]]), len(at)) :]:
                out[i] = True
        return out


_SCHEMA = "tbl string, rec_id bigint, kept array<bigint>, furniture array<bigint>"


def _readable(source: str) -> str:
    """A garbled page as it was meant, line by line, so that its lines meet those of other pages."""
    if not _GARBLED.search(source):
        return source
    mended = repair(source)[0]
    return mended if mended.count("\n") == source.count("\n") else source


def _form_digest(words: list[str], which: int) -> bytes | None:
    form = forms(words)[which]
    if form is None:
        return None
    return hashlib.blake2b("\0".join((str(which), *form)).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _parsed(group: list[tuple]) -> tuple[list[Page], list[int]]:
    """The pages of a group, and for each the number of its content among the different ones."""
    pages, contents, content_of, seen = [], {}, [], set()
    for tbl, rec_id, _, _, content, source, blocks, what, *_ in group:
        if what is not None or (tbl, rec_id, content) in seen:
            continue
        seen.add((tbl, rec_id, content))
        if source is not None:
            lines = source_lines(_readable(source))
        else:
            lines = [(i, b["kind"] or "", "", t) for i, b in enumerate(blocks or [], 1) if b and (t := plain(b["text"] or ""))]
        content_of.append(contents.setdefault(content, len(contents)))
        pages.append(Page((tbl, rec_id), lines))
    return pages, content_of


def _count_here(pages: list[Page], content_of: list[int], min_pages: int = MIN_PAGES) -> None:
    """Count forms over the different contents of this group."""
    first = {c: p for p, c in reversed(list(zip(pages, content_of)))}
    numbers = sorted(first)
    counted = dict(zip(numbers, recurrence([first[c].words for c in numbers], min_pages)))
    for p, c in zip(pages, content_of):
        p.counts = counted[c]


def _count_host(pages: list[Page], group: list[tuple]) -> None:
    """The same counts for the whole host, from the sums that came with the group."""
    total = {g[8]: g[9] for g in group if g[7] == "line"}
    for p in pages:
        p.counts = [tuple(total.get(_form_digest(w, f), 0) for f in range(3)) for w in p.words]


def _place_sums(pages: list[Page], content_of: list[int]) -> dict[bytes, list[int]]:
    """Covered forms: pages (of different content) that have it, where it stands as furniture, and outside the article."""
    out: dict[bytes, list[int]] = {}
    for p in {c: p for p, c in reversed(list(zip(pages, content_of)))}.values():
        for d, (right, outer) in p.places().items():
            sums = out.setdefault(d, [0, 0, 0])
            sums[0] += 1
            sums[1] += right
            sums[2] += outer
    return out


def _line_rows(group: list[tuple]) -> list[tuple]:
    """``key, n, placed, outer`` of each different form in a shard."""
    pages, content_of = _parsed(group)
    _count_here(pages, content_of, 1)
    return list({(_form_digest(w, f), n, 0, 0) for p in pages for w, counts in zip(p.words, p.counts) for f, n in enumerate(counts) if n})


def _place_rows(group: list[tuple]) -> list[tuple]:
    """``key, n, placed, outer`` of each covered form in a shard."""
    pages, content_of = _parsed(group)
    _count_host(pages, group)
    return [(d, *sums) for d, sums in _place_sums(pages, content_of).items()]


def _group_rows(group: list[tuple]) -> list[tuple]:
    pages, content_of = _parsed(group)
    if group[0][3] == WHOLE:
        _count_here(pages, content_of)
        known = {d: 2 * outer >= n for d, (n, right, outer) in _place_sums(pages, content_of).items() if right >= LIKELY * n}
    else:
        _count_host(pages, group)
        known = {g[8]: 2 * g[10] >= g[9] for g in group if g[7] == "place"}
    out = []
    for p in pages:
        marks = p.furniture(known)
        out.append((*p.key, [x[0] for x, m in zip(p.lines, marks) if not m], [x[0] for x, m in zip(p.lines, marks) if m]))
    return out


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each host and shard."""
    group: list[tuple] = []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if group and (row[2], row[3]) != (group[0][2], group[0][3]):
                yield group
                group = []
            group.append(row)
    if group:
        yield group


def _separate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    for group in _groups(batches):
        if rows := _group_rows(group):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["tbl", "rec_id", "kept", "furniture"])


def _counted(rows_of):
    types = [pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            if rows := rows_of(group):
                at = [pa.array([group[0][2]] * len(rows), pa.string()), pa.array([group[0][3]] * len(rows), pa.int32())]
                yield pa.RecordBatch.from_arrays([*at, *(pa.array(c, t) for c, t in zip(zip(*rows), types))], ["host", "shard", "key", "n", "placed", "outer"])

    return run


def _host_sums(spread: DataFrame, rows_of) -> DataFrame:
    """``host, shard, key, n, placed, outer``: what each shard counted, with the sums of its host."""
    host = W.partitionBy("host", "key")  # a row for each shard at most
    counts = spread.mapInArrow(_counted(rows_of), "host string, shard int, key binary, n bigint, placed bigint, outer bigint")
    return counts.select("host", "shard", "key", *(F.sum(c).over(host).alias(c) for c in ("n", "placed", "outer")))


def separate_pages(pages: DataFrame, shard: int = SHARD) -> DataFrame:
    """``tbl, rec_id, kept, furniture``: positions of the article's pieces and of page furniture.

    ``pages`` has tbl, rec_id, host, source (page source, lines ending at LF) and blocks (an array of
    structs with kind and text); one of the two is null.  ``shard``: characters in a group of pages.
    """
    pages = pages.filter("tbl is not null and rec_id is not null").select("tbl", F.col("rec_id").cast("bigint").alias("rec_id"), F.coalesce("host", F.lit("")).alias("host"), "source", F.transform("blocks", lambda b: F.struct(b["kind"].alias("kind"), b["text"].alias("text"))).alias("blocks"))
    size = F.coalesce(F.length("source"), F.lit(0)) + F.coalesce(F.aggregate("blocks", F.lit(0), lambda n, b: n + F.coalesce(F.length(b["text"]), F.lit(0))), F.lit(0))
    # No hint: whether this table is small enough to broadcast is for the engine to see from its size.
    hot = pages.groupBy("host").agg(F.sum(size).alias("size")).filter(F.col("size") > shard).select("host", F.ceil(F.col("size") / shard).cast("int").alias("shards"))
    # Pages of equal content come to one shard, where they count once.
    content = F.xxhash64("source", "blocks")
    place = F.when(F.col("shards").isNull(), WHOLE).otherwise(F.pmod(content, F.col("shards"))).cast("int")

    def placed(how: str) -> DataFrame:
        nothing = [F.lit(None).cast(t).alias(c) for c, t in (("what", "string"), ("key", "binary"), ("n", "bigint"), ("outer", "bigint"))]
        return pages.join(hot, "host", how).select("tbl", "rec_id", "host", place.alias("shard"), content.alias("content"), "source", "blocks", *nothing)

    def added(sums: DataFrame, what: str) -> DataFrame:
        have = {"host": F.col("host"), "shard": F.col("shard"), "what": F.lit(what), "key": F.col("key"), "n": F.col("n"), "outer": F.col("outer")}
        return sums.select(*(have.get(c, F.lit(None).cast(t)).alias(c) for c, t in split.dtypes))

    def spread(rows: DataFrame) -> DataFrame:
        return rows.repartition("host", "shard").sortWithinPartitions("host", "shard", "tbl", "rec_id")

    split = placed("inner")
    lines = checkpointed(added(_host_sums(spread(split), _line_rows).filter(F.col("n") >= MIN_PAGES), "line"))
    places = added(_host_sums(spread(split.unionByName(lines)), _place_rows).filter(F.col("placed") >= LIKELY * F.col("n")), "place")
    return spread(placed("left").unionByName(lines).unionByName(places)).mapInArrow(_separate, _SCHEMA)
