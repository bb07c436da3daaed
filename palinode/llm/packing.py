"""Filling containers of fixed capacity with items of varying length.

How the containers are filled depends only on how many items there are of each length, at most ``capacity`` counts. The plan is
made from these: a list of patterns (lengths that go together) with multiplicities. Every item then finds its container
from its number among the items of its length, so nothing about single items leaves the executors.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palinode.sources.shared import written

BUCKET_ROWS = 200_000


class _Sums:
    """Which gaps single lengths, pairs and triples of available lengths fill exactly.

    Lengths only ever run out, so an index of pair sums made earlier holds every pair there still is; what it names is
    looked up again before use, and it is made anew once enough lengths ran out.
    """

    def __init__(self, counts: np.ndarray) -> None:
        self.counts, self.gone = counts, 0
        self._index()

    def _index(self) -> None:
        there = (self.counts > 0).astype(np.float64)
        size = 1 << (2 * len(there)).bit_length()
        self.pairs = np.fft.irfft(np.fft.rfft(there, size) ** 2, size)[: len(there)] > 0.5
        self.gone = 0

    def take(self, lengths: list[int], times: int) -> None:
        for length in lengths:
            self.counts[length] -= times
            self.gone += self.counts[length] == 0
        if self.gone > 64:
            self._index()

    def pair(self, gap: int) -> list[int]:
        """The pair of available lengths with sum ``gap`` whose scarcer half is the most plentiful."""
        half = gap // 2
        a = self.counts[1 : half + 1]
        b = self.counts[gap - half : gap][::-1]
        have = np.minimum(a, b)
        if gap % 2 == 0 and half:
            have[-1] = a[-1] // 2
        if not len(have) or not have.max():
            return []
        small = int(have.argmax()) + 1
        return [gap - small, small]

    def fill(self, gap: int) -> list[int]:
        """One, two or three available lengths that fill ``gap`` exactly, or none."""
        if self.counts[gap]:
            return [gap]
        if self.pairs[gap] and (two := self.pair(gap)):
            return two
        third = np.arange(1, gap)
        third = third[(self.counts[1:gap] > 0) & self.pairs[gap - third]]
        for t in third[::-1]:
            self.counts[t] -= 1
            two = self.pair(gap - int(t))
            self.counts[t] += 1
            if two:
                return [int(t), *two]
        return []


def plan(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Patterns and how often each is used, for ``counts[length]`` items of each length from 1 to ``capacity``.

    The longest item opens a container; while three more items cannot fill the gap it takes the longest that there is. Then
    the lengths that fill the gap exactly are used up together with it, as often as all of them last. Where nothing fills it,
    the container gets the longest item that fits (best fit) and the search goes on with what is left.
    """
    index = _Sums(np.r_[counts.astype(np.int64), np.zeros(max(0, capacity + 1 - len(counts)), np.int64)])
    counts = index.counts
    patterns: list[tuple[list[int], int]] = []
    longest = capacity
    while True:
        while longest and not counts[longest]:
            longest -= 1
        if not longest:
            return patterns
        held, gap = [longest], capacity - longest
        counts[longest] -= 1
        while gap:
            top = min(longest, gap)
            exact = index.fill(gap) if gap <= 3 * longest else []
            if exact:
                held += exact
                for length in exact:
                    counts[length] -= 1
                gap = 0
                break
            have = np.flatnonzero(counts[1 : top + 1])
            if not len(have):
                break
            held.append(int(have[-1]) + 1)
            counts[held[-1]] -= 1
            gap -= held[-1]
        for length in held:
            counts[length] += 1
        lengths, need = np.unique(held, return_counts=True)
        times = int((counts[lengths] // need).min())
        index.take(held, times)
        patterns.append((held, times))


def pack(items: DataFrame, key: str, size: Column, capacity: int) -> DataFrame:
    """Containers for the items: ``key``, ``n_parts``, ``part``, ``start``, ``size`` (of the part), ``container`` (bigint).

    One row per part. An item larger than ``capacity`` alone is split: full containers, and a rest that is packed
    with the others. Items of null size or of size below 1 have no row. Repeated keys are items of their own, and null
    keys too. An item keeps its container if the table is read again.
    """
    from pyspark.sql.types import LongType, StructField, StructType

    spark = items.sparkSession
    parts = items.select(F.col(key).alias("key"), size.cast("bigint").alias("whole")).where("whole >= 1")
    parts = parts.withColumn("n_parts", F.expr(f"(whole + {capacity - 1}) div {capacity}"))
    parts = parts.select("key", "n_parts", "whole", F.explode(F.expr("sequence(0L, n_parts - 1)")).alias("part"))
    parts = parts.withColumn("start", F.col("part") * capacity).withColumn("size", F.least(F.lit(capacity), F.col("whole") - F.col("start")))
    # the items of one length are numbered bucket by bucket, so a length that a third of all items have is no single task
    parts = written(parts.drop("whole"), "parts")
    n = parts.count()
    buckets = max(1, -(-n // BUCKET_ROWS))
    parts = parts.withColumn("bucket", F.pmod(F.xxhash64("key", "part"), F.lit(buckets)))
    per_bucket = parts.groupBy("size", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = written(per_bucket.select("size", "bucket", "n", before.alias("offset")), "offsets")

    counts = np.zeros(capacity + 1, np.int64)
    for row in offsets.groupBy("size").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        counts[row["size"]] = row["n"]
    uses, used, base = [], np.zeros(capacity + 1, np.int64), 0
    for lengths, times in plan(counts, capacity):
        for length in lengths:
            uses.append((length, int(used[length]), int(used[length]) + times, base))
            used[length] += times
        base += times
    fields = [StructField(c, LongType(), False) for c in ("size", "from", "to", "base")]
    lookup = spark.createDataFrame(uses, StructType(fields))  # a few rows per length
    spans = lookup.groupBy("size").agg(F.array_sort(F.collect_list(F.struct("from", "to", "base"))).alias("spans"))

    nth = F.row_number().over(Window.partitionBy("size", "bucket").orderBy("key", "part")) - 1 + F.col("offset")
    numbered = parts.join(offsets.drop("n"), ["size", "bucket"]).withColumn("nth", nth)
    mine = F.element_at(F.filter("spans", lambda s: (s["from"] <= F.col("nth")) & (F.col("nth") < s["to"])), 1)
    return (
        numbered.join(F.broadcast(spans), "size")
        .withColumn("span", mine)
        .select(F.col("key").alias(key), "n_parts", "part", "start", "size", (F.col("span.base") + F.col("nth") - F.col("span.from")).alias("container"))
    )


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: ``containers``, ``items``, ``used``, ``room`` (what is left over in all), ``fill`` (used share), ``full`` (containers without room)."""
    each = packed.groupBy("container").agg(F.sum("size").alias("used"), F.count(F.lit(1)).alias("items"))
    return each.agg(
        F.count(F.lit(1)).alias("containers"),
        F.sum("items").alias("items"),
        F.sum("used").alias("used"),
        F.sum(capacity - F.col("used")).alias("room"),
        (F.sum("used") / (F.count(F.lit(1)) * capacity)).alias("fill"),
        F.count_if(F.col("used") == capacity).alias("full"),
    )
