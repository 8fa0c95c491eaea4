"""Filling fixed-capacity containers with items, by harmonic packing.

Sizes fall into classes by reciprocals of the capacity: class k holds the sizes in
(C/(k+1), C/k], and k of them fill one bin of the class, so every worker fills its own bins by
counting, without looking at any other worker's.  The last class (C/``CLASSES`` and below) is filled
by sum.  Two refinements keep the unused space small: a bin that has its k items takes items of
smaller classes into the space they left; and bins a worker could not fill are emptied and packed
again with those of other workers, in shards, where bins that stay open are joined.

An item larger than the capacity is cut into parts of exactly the capacity and a rest; only the rest
is packed.  No other item is cut.

Defined results: items of null text or null id are left out; a text without tokens takes no space and
goes into no container; repeated ids with the same text are items of their own; an empty table gives
no container; other columns of the input are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillworks.llm.tokens import DEFAULT_RANKS, count

CLASSES = 64
#: Bins that may stand open on one worker for each container kind.
OPEN = 4096


class Packer:
    """Fills bins of one capacity in the order the items come.

    ``filling`` has the bin of each class that still lacks some of its k items.  A bin with its k items
    is parked by the room it has left: in list r stands a bin with room for any item of class r.  An
    item of class k goes into the parked bin with the least sufficient room, else into its class's bin.
    """

    def __init__(self, capacity: int) -> None:
        self.capacity, self.parked, self.filling, self.n = capacity, defaultdict(list), {}, 0

    def kind(self, size: int) -> int:
        """Reciprocal class of an item: the k with C/(k+1) < size <= C/k."""
        return min(CLASSES, self.capacity // size)

    def room(self, left: int) -> int:
        """Smallest class whose largest item, C/k, fits; 0 if none does."""
        return -(-self.capacity // left) if left * CLASSES >= self.capacity else 0

    def park(self, used: int, items: list) -> list[tuple[int, list]]:
        r = self.room(self.capacity - used) if used < self.capacity else 0
        if not r:
            return [(used, items)]
        self.parked[r].append((used, items))
        self.n += 1
        if self.n <= OPEN:
            return []
        self.n -= 1
        return [self.parked[max(x for x, b in self.parked.items() if b)].pop(0)]

    def add(self, item: tuple, size: int) -> list[tuple[int, list]]:
        """Put the item into a bin; gives the bins that this closes, as (used, items)."""
        k = self.kind(size)
        for r in range(k, 0, -1):
            if self.parked.get(r):
                used, items = self.parked[r].pop()
                self.n -= 1
                items.append(item)
                return self.park(used + size, items)
        used, items = self.filling.pop(k, (0, []))
        if k == CLASSES and used + size > self.capacity:
            self.filling[k] = (size, [item])
            return [(used, items)]
        items.append(item)
        if k == CLASSES or len(items) < k:
            self.filling[k] = (used + size, items)
            return []
        return self.park(used + size, items)

    def rest(self) -> list[tuple[int, list]]:
        out = [*(b for bins in self.parked.values() for b in bins), *self.filling.values()]
        self.parked.clear(), self.filling.clear()
        self.n = 0
        return out


def merged(bins: list[tuple[int, list]], capacity: int) -> list[tuple[int, list]]:
    """Unfilled bins joined where they fit together, the fullest first, each into the tightest room."""
    out: list[tuple[int, list]] = []
    room: list[tuple[int, int]] = []  # (space left, place in out), in order
    for used, items in sorted(bins, key=lambda b: -b[0]):
        i = bisect_left(room, (used, -1))
        if i < len(room):
            left, k = room.pop(i)
            out[k] = (out[k][0] + used, out[k][1] + items)
            insort(room, (left - used, k))
        else:
            insort(room, (capacity - used, len(out)))
            out.append((used, items))
    return out


_SCHEMA = "limit_name string, capacity bigint, item_id bigint, part_no int, start_token bigint, n_tokens bigint, container string, shard int"
_NAMES = ["limit_name", "capacity", "item_id", "part_no", "start_token", "n_tokens", "container", "shard"]
_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int32()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)


def _fill(capacities: dict[str, int], ranks: str):
    """Count the tokens and pack what the partition holds; unfilled bins' items go out without a container."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        me = TaskContext.get().partitionId()
        packers = {n: Packer(c) for n, c in capacities.items()}
        closed: dict[str, int] = defaultdict(int)

        def rows(name: str, bins: list, done: bool):
            c = capacities[name]
            for _, items in bins:
                closed[name] += done
                where = f"{name}/{me}/{closed[name]}" if done else None
                for i, part, start, size in items:
                    yield name, c, i, part, start, size, where, me // 64

        for b in batches:
            out: list[tuple] = []
            for i, text in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist()):
                n = count(text, ranks)
                for name, c in capacities.items():
                    whole, rest = divmod(n, c)
                    for k in range(whole):
                        out += rows(name, [(c, [(i, k + 1, k * c, c)])], True)
                    if rest:
                        out += rows(name, packers[name].add((i, whole + 1, whole * c, rest), rest), True)
            if out:
                yield _batch(out)
        out = [r for name, p in packers.items() for bins in [p.rest()] for full in (True, False) for r in rows(name, [x for x in bins if (x[0] * 20 >= capacities[name] * 19) is full], full)]
        if out:
            yield _batch(out)

    return run


def _refill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pass packed rows on; pack the others, which come last, by container kind and falling size."""
    packer: Packer | None = None
    at, made = ("", 0), 0

    def rows(bins: list):
        nonlocal made
        for _, items in bins:
            made += 1
            for i, part, start, size in items:
                yield at[0], at[1], i, part, start, size, f"{at[0]}/s{at[2]}/{made}", at[2]

    for b in batches:
        out: list[tuple] = []
        for r in zip(*(c.to_pylist() for c in b.columns)):
            if r[6] is not None:
                out.append(r)
                continue
            if (r[0], r[1], r[7]) != at:
                out += rows(merged(packer.rest(), at[1])) if packer else []
                packer, at, made = Packer(r[1]), (r[0], r[1], r[7]), 0
            out += rows(packer.add(tuple(r[2:6]), r[5]))
        if out:
            yield _batch(out)
    if packer and (out := list(rows(merged(packer.rest(), at[1])))):
        yield _batch(out)


def pack_items(df: DataFrame, item_id: str, text: str, capacities: dict[str, int], ranks: str = DEFAULT_RANKS) -> DataFrame:
    """``limit_name, capacity, item_id, part_no, start_token, n_tokens, container``: one row per packed part.

    The first pass has no shuffle; the second moves ids and sizes only, and only unfilled bins meet.
    """
    if not capacities or min(capacities.values()) < 1:
        raise ValueError("capacities must be positive")
    items = df.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(text).alias("text")).filter("item_id is not null and text is not null")
    first = items.mapInArrow(_fill(dict(capacities), ranks), _SCHEMA)
    apart = F.when(F.col("container").isNull(), F.hash("limit_name", "shard")).otherwise(F.hash("item_id"))
    order = [F.col("container").isNull(), "limit_name", "shard", F.col("n_tokens").desc(), "item_id", "part_no"]
    return first.withColumn("apart", apart).repartition("apart").drop("apart").sortWithinPartitions(*order).mapInArrow(_refill, _SCHEMA).drop("shard")


def fill_report(packed: DataFrame) -> DataFrame:
    """Containers, tokens and used share of each container kind."""
    g = packed.groupBy("limit_name", "capacity", "container").agg(F.sum("n_tokens").alias("used"))
    return g.groupBy("limit_name", "capacity").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), (F.sum("used") / (F.count("*") * F.first("capacity"))).alias("fill"))
