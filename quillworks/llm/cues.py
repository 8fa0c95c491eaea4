"""Repeated consecutive events in ordered sequences.

``collapse_runs`` segments each entity's sequence by a pruned dynamic program: a segmentation costs
the dissimilarity inside its runs plus a penalty for each run, and the cheapest segmentation gives the runs.
Inside a run each event is compared with the one before it (``against="before"``: what this
project's statement of the problem asks for; the best runs then end exactly where neighbours differ by more than the penalty), or
with the run's first event (``against="first"``: slow drift ends a run, and where it ends is a matter of
the whole sequence).  The same event costs 0, one mistyped letter less than the penalty, any other more.

Hot entities: the table is cut into ranges of (entity, order value) by a sample of these keys, so however the
order values lie, no task holds more than a range.  With ``against="before"`` each range is segmented
on its own, and only its first and last run meet those of other ranges, by entity and in order, as a stream;
that gives what the whole sequence would.  ``against="first"`` needs an entity's sequence in one task.

Defined results: rows without entity or order value are left out; a repeated (entity, order) counts
once; an event with null text is a run of its own; an event of nothing but punctuation equals any
other such event; null times are passed over for the first start and last end; an empty table gives
an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

PENALTY, TYPO, OTHER = 1.0, 0.5, 4.0
_TAGS = re.compile(r"<[^<>]*>|\{[^{}]*\}")
_SIGNS = re.compile(r"[\W_]+")


def reduced(text: str | None) -> str | None:
    """What counts in a cue: its words in lower case, one space between them."""
    return None if text is None else _SIGNS.sub(" ", _TAGS.sub("", text).casefold()).strip()


def dissimilarity(a: str | None, b: str | None) -> float:
    """0 for the same event, TYPO for one mistyped letter, OTHER for different events; of reduced texts."""
    if a is None or b is None:
        return OTHER
    if a == b:
        return 0.0
    x, y = a.replace(" ", ""), b.replace(" ", "")
    if x == y:
        return 0.0
    if abs(len(x) - len(y)) > 1 or not x or not y:
        return OTHER
    if len(x) > len(y):
        x, y, a, b = y, x, b, a
    i, most = 0, len(x)
    while i < most and x[i] == y[i]:
        i += 1
    if len(x) == len(y):
        if x[i + 1 :] != y[i + 1 :] or not (x[i].isalpha() and y[i].isalpha()):
            return OTHER
        return OTHER if _word_length(b, i) == 1 or _word_length(a, i) == 1 else TYPO
    if x[i:] != y[i + 1 :] or not y[i].isalpha():
        return OTHER
    # An added letter that is a word of its own, and not a split one, is an added word.
    return OTHER if _word_length(b, i) == 1 and len(b.split()) > len(a.split()) else TYPO


def _word_length(text: str, i: int) -> int:
    """Length of the word that holds the i-th character that isn't a space."""
    for w in text.split(" "):
        if i < len(w):
            return len(w)
        i -= len(w)
    return 0


def segment(costs: list[float], penalty: float = PENALTY) -> list[int]:
    """Starts of the cheapest runs, where costs[t] is the dissimilarity of events t and t+1.

    The program keeps those last starts only that can still win: a start s whose cost up to t is at
    least the best cost to t can't be the last start of a better segmentation later.
    """
    n = len(costs) + 1
    best, back = [0.0] * (n + 1), [0] * (n + 1)
    best[0] = -penalty
    alive: list[tuple[int, float]] = []  # (start, cost inside the run so far)
    for t in range(n):
        if t:
            c = costs[t - 1]
            alive = [(s, w + c) for s, w in alive]
        alive.append((t, 0.0))
        s, w = min(alive, key=lambda x: (best[x[0]] + x[1], x[0]))
        best[t + 1], back[t + 1] = best[s] + w + penalty, s
        alive = [(s, w) for s, w in alive if best[s] + w < best[t + 1]]
    starts, t = [], n
    while t:
        t = back[t]
        starts.append(t)
    return starts[::-1]


def segment_by_first(keys: list[str | None], penalty: float = PENALTY) -> list[int]:
    """Starts of the cheapest runs, where each event of a run costs its dissimilarity to the run's first.

    Of starts with equal events only the cheapest so far can still win, so no more are kept than there are different events.
    """
    best, back = [-penalty], [0]
    alive: dict[object, tuple[float, int]] = {}  # by first event: (cost so far, start)
    for t, key in enumerate(keys):
        alive = {first: (c + dissimilarity(keys[s], key), s) for first, (c, s) in alive.items()}
        own = t if key is None else key  # events with null text equal none
        if own not in alive or best[t] < alive[own][0]:
            alive[own] = (best[t], t)
        c, s = min(alive.values())
        best.append(c + penalty)
        back.append(s)
    starts, t = [], len(keys)
    while t:
        t = back[t]
        starts.append(t)
    return starts[::-1]


_FIELDS = [("entity", pa.int64()), ("block", pa.int64()), ("edge", pa.int32()), ("first_seq", pa.int64()), ("last_seq", pa.int64()), ("n_events", pa.int64()), ("start_time", pa.float64()), ("end_time", pa.float64()), ("text", pa.string()), ("head", pa.string()), ("tail", pa.string())]
_SCHEMA = "entity bigint, block bigint, edge int, first_seq bigint, last_seq bigint, n_events bigint, start_time double, end_time double, text string, head string, tail string"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * len(_FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, _FIELDS)], [n for n, _ in _FIELDS])


def _block_runs(group: list[tuple], by_first: bool = False) -> list[tuple]:
    """Runs of one block; group: (entity, block, seq, text, start, end) in order of seq, repeats included."""
    events = [g for k, g in enumerate(group) if not k or g[2] != group[k - 1][2]]
    keys = [reduced(g[3]) for g in events]
    starts = segment_by_first(keys) if by_first else segment([dissimilarity(a, b) for a, b in zip(keys, keys[1:])])
    out = []
    for k, s in enumerate(starts):
        e = starts[k + 1] if k + 1 < len(starts) else len(events)
        run = events[s:e]
        edge = int(k == 0 or k == len(starts) - 1)
        out.append((run[0][0], run[0][1], edge, run[0][2], run[-1][2], e - s, next((g[4] for g in run if g[4] is not None), None), next((g[5] for g in reversed(run) if g[5] is not None), None), run[0][3], keys[s] if edge else None, keys[e - 1] if edge else None))
    return out


def _segment_blocks(by_first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId()
        group: list[tuple] = []
        for b in batches:
            out: list[tuple] = []
            for entity, *rest in zip(*(c.to_pylist() for c in b.columns)):
                if group and entity != group[0][0]:
                    out += _block_runs(group, by_first)
                    group = []
                group.append((entity, block, *rest))
            if out:
                yield _batch(out)
        if group:
            yield _batch(_block_runs(group, by_first))

    return run


def _join_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join edge runs that go on over a block's end; the rows come by entity in order of first_seq."""
    held: tuple | None = None
    for b in batches:
        out: list[tuple] = []
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if not row[2]:
                out.append(row)
            elif held and held[0] == row[0] and held[1] != row[1] and segment([dissimilarity(held[10], row[9])]) == [0]:
                held = (*held[:1], row[1], 1, held[3], row[4], held[5] + row[5], held[6] if held[6] is not None else row[6], row[7] if row[7] is not None else held[7], held[8], held[9], row[10])
            else:
                if held:
                    out.append(held)
                held = row
        if out:
            yield _batch(out)
    if held:
        yield _batch([held])


def collapse_runs(df: DataFrame, entity: str, order: str, text: str, start: str, end: str, repeated_only: bool = False, against: str = "before") -> DataFrame:
    """One row per run: ``entity, first_seq, last_seq, n_events, start_time, end_time, duration, text``.

    ``text`` is that of the run's first event, ``duration`` the last end less the first start.
    Order values are integers, with gaps allowed.  ``repeated_only`` keeps runs of two or more.
    """
    if against not in ("before", "first"):
        raise ValueError("against must be before or first")
    real = lambda c: F.when(F.isnan(F.col(c).cast("double")), None).otherwise(F.col(c).cast("double"))
    events = df.select(F.col(entity).cast("bigint").alias("entity"), F.col(order).cast("bigint").alias("seq"), F.col(text).alias("text"), real(start).alias("s"), real(end).alias("e")).filter("entity is not null and seq is not null")
    spread = events.repartition("entity") if against == "first" else events.repartitionByRange("entity", "seq")
    parts = spread.sortWithinPartitions("entity", "seq", "text", "s", "e").mapInArrow(_segment_blocks(against == "first"), _SCHEMA)
    if repeated_only:
        parts = parts.filter("edge = 1 or n_events > 1")
    if against == "before":
        apart = F.when(F.col("edge") == 0, F.col("block")).otherwise(F.lit(-1))
        parts = parts.withColumn("apart", apart).repartition("entity", "apart").drop("apart").sortWithinPartitions("entity", "first_seq").mapInArrow(_join_edges, _SCHEMA)
    runs = parts.filter("n_events > 1") if repeated_only else parts
    return runs.select("entity", "first_seq", "last_seq", "n_events", "start_time", "end_time", (F.col("end_time") - F.col("start_time")).alias("duration"), "text")
