"""Splitting oversized items at natural boundaries.

``split_items`` cuts every text above ``limit`` code points into ordered pieces.  The cuts come
from a dynamic program over boundary positions: each admitted boundary has a penalty by its kind
(paragraph < line < sentence < word < bare character), each piece a penalty for its distance from
the even size, and the program minimises the sum subject to ``piece length <= limit``, where a
piece starts about ``overlap`` code points before the end of the piece before it.

Defined results: null texts give no piece; a text within the limit is one piece, unchanged (an
empty text is one empty piece); repeated rows of one key give the pieces once; other columns of the
input are ignored, whatever their names.  ``text[end of the piece before : end of this piece]`` of
all pieces joined is the text itself, so nothing is lost.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

PENALTY = {"paragraph": 0.0, "line": 1.0, "sentence": 2.0, "word": 8.0, "character": 64.0, "end": 0.0}
PIECE_COST, BALANCE = 4.0, 16.0
_STRONG = re.compile(r"(?P<paragraph>[ \t\r]*\n[ \t\r]*\n\s*)|(?P<line>[ \t\r]*\n[ \t\r]*)|(?P<sentence>(?<=[.!?…。！？])[\"'”’»)\]]*[ \t 　]+|(?<=[。！？])[”’」』）]*(?=\S))")
_WORD = re.compile(r"\s+")
# Marks, joiners and selectors that belong to the character before them.
_GLUED = re.compile(r"[̀-ͯ҃-҉֑-ֽً-़्ٟ᪰-᫿᷀-᷿‌‍⃐-⃿゙゚︀-️︠-︯\U0001f3fb-\U0001f3ff]")


def _whole(text: str, p: int) -> int:
    """The last place at or before p that doesn't part a character from its marks, or CR from LF."""
    q = p
    while 0 < q < len(text) and p - q < 64 and (_GLUED.match(text[q]) or text[q - 1] == "‍" or text[q - 1 : q + 1] == "\r\n"):
        q -= 1
    return q if 0 < q and p - q < 64 else p


def boundaries(text: str, limit: int, overlap: int) -> tuple[list[int], list[str]]:
    """Admitted cut positions (each the end of a piece) with their kinds, in order.

    Paragraph, line and sentence ends are always admitted; word ends where no such end comes for a
    quarter of a piece; bare characters where no word end comes either.
    """
    n, reach = len(text), max(1, (limit - overlap) // 4)
    strong: list[tuple[int, str]] = []
    for m in _STRONG.finditer(text):
        p = m.start()
        if m.lastgroup == "sentence":
            p += len(m.group().rstrip())
        if 0 < p < n and (not strong or p > strong[-1][0]):
            strong.append((p, m.lastgroup))
    found, last = [], 0
    for p, kind in [*strong, (n, "end")]:
        if p - last > reach:
            near = last
            for q in [*(m.start() for m in _WORD.finditer(text, last, p)), p]:
                if q - near > reach:
                    step = max(1, reach // 16)
                    for c in range(near + step, q, step):
                        w = _whole(text, c)
                        if w > max(near, found[-1][0] if found else 0):
                            found.append((w, "character"))
                if last < q < p:
                    found.append((q, "word"))
                near = q
        found.append((p, kind))
        last = p
    # Where a cluster of marks left no place for a cut, bare positions inside it.
    step, out, last = limit - overlap, [], 0
    for p, kind in found:
        out += [(q, "character") for q in range(last + step, p, step)]
        out.append((p, kind))
        last = p
    return [p for p, _ in out], [k for _, k in out]


def cut(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, kind of the end) of each piece, positions from 0."""
    n = len(text)
    if n <= limit:
        return [(0, n, "end")]
    ends, kinds = boundaries(text, limit, overlap)
    p = np.array([0, *ends])
    pen = np.array([0.0, *(PENALTY[k] for k in kinds)])
    # Where a piece that follows a cut starts: the word start nearest to the stated overlap.
    tol = min(overlap // 2, (limit - overlap) // 4)
    words = [m.end() for m in _WORD.finditer(text)] if overlap else []
    s = [0]
    for e in ends:
        want = max(0, e - overlap)
        if words and overlap:
            lo, hi = bisect_left(words, want - tol), bisect_right(words, min(want + tol, e - 1))
            near = min(words[lo:hi], key=lambda x: abs(x - want), default=None)
            want = _whole(text, want) if near is None else near
        else:
            want = _whole(text, want)
        s.append(max(s[-1], min(want, e)))
    s = np.array(s)
    k = max(2, -(-(n - overlap) // (limit - overlap)))
    even = (n + (k - 1) * overlap) / k
    for starts in (s, np.maximum(0, p - overlap)):  # bare starts only where marks or words leave no way within the limit
        cost, back, lo = np.full(len(p), np.inf), np.zeros(len(p), dtype=np.int64), 0
        cost[0] = 0.0
        for j in range(1, len(p)):
            while lo < j and p[j] - starts[lo] > limit:
                lo += 1
            if lo == j:
                continue
            size = p[j] - starts[lo:j]
            c = cost[lo:j] + BALANCE * np.square((size - even) / limit)
            i = int(c.argmin())
            cost[j], back[j] = c[i] + pen[j] + PIECE_COST, lo + i
        s = starts
        if np.isfinite(cost[-1]):
            break
    out, j = [], len(p) - 1
    while j > 0:
        i = int(back[j])
        out.append((int(s[i]), int(p[j]), "end" if j == len(p) - 1 else kinds[j - 1]))
        j = i
    return out[::-1]


def _pieces(keys: list[str], limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, no, start, end, kind, text = [], [], [], [], [], []
            for r, t in enumerate(b.column("text").to_pylist()):
                for k, (s, e, why) in enumerate(cut(t, limit, overlap), 1):
                    row.append(r), no.append(k), start.append(s + 1), end.append(e), kind.append(why), text.append(t[s:e])
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).take(at) for c in keys), pa.array(no, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(kind, pa.string()), pa.array(text, pa.string())],
                [*keys, "piece_no", "start_pos", "end_pos", "ends_at", "text"],
            )

    return run


def split_items(df: DataFrame, keys: list[str], text: str, limit: int, overlap: int, only_oversized: bool = False) -> DataFrame:
    """Pieces of each text: ``keys + piece_no, start_pos, end_pos, ends_at, text``.

    ``only_oversized`` leaves out the texts within the limit, which then aren't shuffled.  Only texts above the
    limit are sent to Python; the shuffle counts a repeated key once and spreads long texts.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    if taken := {"piece_no", "start_pos", "end_pos", "ends_at", "text"} & set(keys):
        raise ValueError(f"key columns can't be named {sorted(taken)}")
    items = df.select(*keys, F.col(text).alias("text"))
    types = dict(items.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "piece_no int, start_pos bigint, end_pos bigint, ends_at string, text string"])
    long = items.filter(F.length("text") > limit).dropDuplicates(keys).mapInArrow(_pieces(keys, limit, overlap), schema)
    if only_oversized:
        return long
    short = items.filter(F.length("text") <= limit).dropDuplicates(keys)
    return long.unionByName(short.select(*keys, F.lit(1).alias("piece_no"), F.lit(1).cast("bigint").alias("start_pos"), F.length("text").cast("bigint").alias("end_pos"), F.lit("end").alias("ends_at"), "text"))
