"""Mixing sources to target weights, by weighted fair queueing.

Each use of a text gets a virtual finish time: the tokens its source has delivered up to and with it,
in shuffled order, divided by the source's target share.  Sorted by finish time over all sources and
cut where the tokens reach the budget, the sequence holds every source at its share at any place.

The running sums never gather a source in one task: uses are spread over ``BUCKETS`` hash ranges of
the shuffled order, each range is summed, the ranges' sums are added up on a table of at most
``sources x BUCKETS`` rows, and within one range a window adds the rest.  The same way over finish
times finds the place of the cut.

Defined results: rows with null id, text or source, and sources with share 0 or no share, are left
out; texts equal character by character are one text, used under the source of their smallest id; a
text without tokens is left out; a source without any text leaves its share unfilled, and the
others keep their ratio; empty tables give an empty mixture; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from quillworks.llm.tokens import DEFAULT_RANKS, count
from quillworks.llm.lineage import checkpointed

BUCKETS = 1024


def _counts(ranks: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pa.array([count(t, ranks) for t in b.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("item_id"), b.column("source"), b.column("same"), n], ["item_id", "source", "same", "n_tokens"])

    return run


def measured(df: DataFrame, item_id: str, text: str, source: str, ranks: str = DEFAULT_RANKS) -> DataFrame:
    """``item_id, source, n_tokens``, one row per different text; kept in the shared folder."""
    rows = df.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(source).alias("source"), F.col(text).alias("text")).filter("item_id is not null and source is not null and text is not null")
    rows = rows.select("item_id", "source", F.md5("text").alias("same"), "text").mapInArrow(_counts(ranks), "item_id bigint, source string, same string, n_tokens bigint")
    one = rows.groupBy("same").agg(F.min(F.struct("item_id", "source", "n_tokens")).alias("r")).select("r.*")
    return checkpointed(one.filter("n_tokens > 0"))


def _running(df: DataFrame, key: list[str], bucket: str, order: list[str], value: str, out: str, most: int | None = None) -> DataFrame:
    """Running sums of ``value`` by ``key`` in the order (bucket, order), without a task per key.

    With ``most``, buckets that begin beyond that sum are dropped before any of their rows is sorted.
    """
    sums = df.groupBy(*key, bucket).agg(F.sum(value).alias("_s"))
    before = sums.withColumn("_before", F.sum("_s").over(W.partitionBy(*key).orderBy(bucket)) - F.col("_s")).drop("_s")
    before = before.filter(F.col("_before") <= most) if most is not None else before
    inside = F.sum(value).over(W.partitionBy(*key, bucket).orderBy(*order))
    # Sources are bounded by the rows of the target table, buckets by BUCKETS: the hint is safe.
    return df.join(F.broadcast(before), [*key, bucket]).withColumn(out, F.col("_before") + inside).drop("_before")


def mix_sources(df: DataFrame, targets: DataFrame, item_id: str, text: str, source: str, seed: int = 11, budget: int | None = None, ranks: str = DEFAULT_RANKS) -> DataFrame:
    """``item_id, source, use_no, n_tokens, finish, place``: the mixture in its order.

    ``targets`` has source, target_share and max_repeats, one row a source.  Without a budget the
    mixture is the largest in which no source runs out before its share is reached.
    """
    texts = measured(df, item_id, text, source, ranks)
    t = targets.select("source", F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("int").alias("most")).filter("source is not null and share > 0 and most > 0").groupBy("source").agg(F.max("share").alias("share"), F.max("most").alias("most"))
    totals = texts.groupBy("source").agg(F.sum("n_tokens").alias("n")).join(F.broadcast(t), "source")
    room = totals.agg(F.min(F.col("n") * F.col("most") / F.col("share")).alias("r"), F.sum("share").alias("s"), F.sum(F.col("n") * F.col("most")).alias("all")).first()
    if budget is None:
        budget = int(min((room["r"] or 0.0) * (room["s"] or 0.0), room["all"] or 0))
    uses = texts.join(F.broadcast(t), "source").withColumn("use_no", F.explode(F.expr("sequence(1, most)")))
    # All texts are used once before any is used again.
    mixed = uses.withColumn("_h", F.xxhash64("item_id", "use_no", F.lit(seed))).withColumn("_b", (F.col("use_no") * BUCKETS + F.pmod(F.shiftright("_h", 20), F.lit(BUCKETS))).cast("bigint"))
    mixed = _running(mixed, ["source"], "_b", ["_h", "item_id"], "n_tokens", "_sum").withColumn("finish", F.col("_sum") / F.col("share"))
    mixed = mixed.select("item_id", "source", "use_no", "n_tokens", "finish")
    # Even steps up to where the budget ends if no source runs out, steps of a hundredth of their size beyond.
    width = max(1.0, budget / max(room["s"] or 1.0, 1e-12) / BUCKETS)
    step = F.col("finish") / width
    mixed = mixed.withColumn("_f", F.when(step < BUCKETS, F.floor(step)).otherwise(BUCKETS + F.floor(F.log2(step / BUCKETS) * 70)).cast("bigint")).withColumn("_all", F.lit(0))
    mixed = _running(mixed, ["_all"], "_f", ["finish", "source", "item_id", "use_no"], "n_tokens", "place", most=budget).filter(F.col("place") <= budget)
    return mixed.select("item_id", "source", "use_no", "n_tokens", "finish", "place").repartitionByRange("place").sortWithinPartitions("place")


def share_report(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and reached shares of each source of the target table, with its most frequent use and longest text."""
    g = mixture.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.countDistinct("item_id").alias("texts"), F.max("use_no").alias("most_uses"), F.max("n_tokens").alias("longest"))
    t = targets.select("source", "target_share", "max_repeats")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    rows = t.join(g, "source", "left").select("source", "target_share", "max_repeats", zero("n_tokens"), zero("texts"), zero("most_uses"), zero("longest"))
    # A window over one group: it has the rows of the target table.
    return rows.withColumn("actual_share", F.col("n_tokens") / F.sum("n_tokens").over(W.partitionBy(F.lit(0))))
