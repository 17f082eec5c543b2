"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups (here: rows of equal text) are packed by their total size. Groups of equal size are
interchangeable, so the packing needs only the histogram (size, number of groups): one pass over its
rows, largest first, puts each run of equal groups into the tightest bin that still holds one, found in
a balanced tree of the bins' remaining capacities. That is exactly the group-by-group best fit.

Scale: a histogram with D distinct sizes implies at least D*(D+1)/2 bytes, so the driver holds at most
sqrt(2 * total bytes) rows (14 million for 100 TB, a few ten thousands in practice). Ranks within a size
and within a shard are dealt over salts, so neither a common size nor a shard meets in one task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialize, salted_rank
from ledgerloom.llm.names import spread


class BalancedTree:
    """Ordered set of (remaining capacity, bin) as an AA tree; all operations take logarithmic time."""

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root = None

    @staticmethod
    def _skew(t):
        if t and t[1] and t[1][3] == t[3]:
            left = t[1]
            t[1] = left[2]
            left[2] = t
            return left
        return t

    @staticmethod
    def _split(t):
        if t and t[2] and t[2][2] and t[3] == t[2][2][3]:
            right = t[2]
            t[2] = right[1]
            right[1] = t
            right[3] += 1
            return right
        return t

    def add(self, key: tuple[int, int]) -> None:
        self.root = self._add(self.root, key)

    def _add(self, t, key):
        if t is None:
            return [key, None, None, 1]
        side = 1 if key < t[0] else 2
        t[side] = self._add(t[side], key)
        return self._split(self._skew(t))

    def remove(self, key: tuple[int, int]) -> None:
        self.root = self._remove(self.root, key)

    def _remove(self, t, key):
        if t is None:
            return None
        if key == t[0]:
            if t[1] is None and t[2] is None:
                return None
            side = 2 if t[2] is not None else 1
            heir = t[side]
            while heir[3 - side] is not None:
                heir = heir[3 - side]
            t[0] = heir[0]
            t[side] = self._remove(t[side], heir[0])
        else:
            side = 1 if key < t[0] else 2
            t[side] = self._remove(t[side], key)
        least = min(t[1][3] if t[1] else 0, t[2][3] if t[2] else 0) + 1
        if least < t[3]:
            t[3] = least
            if t[2] and least < t[2][3]:
                t[2][3] = least
        t = self._skew(t)
        t[2] = self._skew(t[2])
        if t[2]:
            t[2][2] = self._skew(t[2][2])
        t = self._split(t)
        t[2] = self._split(t[2])
        return t

    def tightest(self, size: int) -> tuple[int, int] | None:
        """The smallest (remaining, bin) with remaining >= size."""
        t, best = self.root, None
        while t is not None:
            if t[0] >= (size, -1):
                best, t = t[0], t[1]
            else:
                t = t[2]
        return best


@dataclass(frozen=True)
class Run:
    """`count` groups of `size`, numbered from `first` among the groups of that size, go to shard `shard`."""

    size: int
    first: int
    count: int
    shard: int


def best_fit_decreasing(histogram: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[Run] | None:
    """Pack (size, count) rows, given largest first, into bins of `capacity`; a group beyond it has a bin of its own.

    None: more than `most` bins would be opened.
    """
    tree, runs, opened = BalancedTree(), [], 0
    for size, count in histogram:
        done = 0
        while done < count:
            found = tree.tightest(size)
            if found is None:
                if most is not None and opened >= most:
                    return None
                found = (max(capacity, size), opened)
                opened += 1
            else:
                tree.remove(found)
            left, shard = found
            n = min(count - done, left // size)
            runs.append(Run(size, done, n, shard))
            tree.add((left - n * size, shard))
            done += n
    return runs


def into_shards(histogram: list[tuple[int, int]], shards: int) -> list[Run]:
    """The packing of smallest capacity that best fit finds for a given number of bins, so that bins are near equal.

    A group larger than an even share of what is left gets a shard alone, and the rest is evened out over the others.
    """
    rest, alone, total = [list(x) for x in histogram], [], sum(s * n for s, n in histogram)
    at = 0
    while at < len(rest) and shards - len(alone) > 1 and rest[at][0] * (shards - len(alone)) >= total and rest[at][0] < total:
        size = rest[at][0]
        alone.append(Run(size, histogram[at][1] - rest[at][1], 1, len(alone)))
        total -= size
        rest[at][1] -= 1
        at += rest[at][1] == 0
    left, bins = [(s, n) for s, n in rest[at:]], shards - len(alone)
    if not left:
        return alone
    low = max(left[0][0], -(-total // bins))
    high = low + left[0][0]
    best = best_fit_decreasing(left, high, bins)
    while best is None:
        high *= 2
        best = best_fit_decreasing(left, high, bins)
    while low < high:
        mid = (low + high) // 2
        tried = best_fit_decreasing(left, mid, bins)
        best, low, high = (best, mid + 1, high) if tried is None else (tried, low, mid)
        if high - low <= low >> 17:
            break
    first = {r.size: r.first + 1 for r in alone}
    return alone + [Run(r.size, r.first + first.get(r.size, 0), r.count, r.shard + len(alone)) for r in best]


def shard(docs: DataFrame, *, text_col: str = "text", shards: int | None = None, capacity: int | None = None, salts: int = 1024) -> DataFrame:
    """docs without their text, with shard, slot, group_size, text_crc32 and _ld_size (the row's size).

    Give `shards` (a fixed number, sizes near equal) or `capacity` (bytes a shard, as few shards as
    best fit opens). Rows of equal text, null texts among themselves, stay together. A row's size is its
    text's UTF-8 bytes plus 1. slot is gapless from 0 in each shard. An empty table gives no rows.
    Columns whose names begin with _ld_ are the operator's own; columns named shard, slot, group_size or text_crc32 are
    replaced. A text of any length is hashed whole and not carried on.
    """
    if (shards is None) == (capacity is None):
        raise ValueError("give either shards or capacity")
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8")
    rows = docs.select(
        *(F.col(f"`{c}`") for c in docs.columns if c not in ("shard", "slot", "group_size", "text_crc32", text_col)),
        F.sha2(F.when(F.col(text_col).isNotNull(), raw), 256).alias("_ld_key"), (F.octet_length(raw) + 1).cast("long").alias("_ld_size"), F.crc32(raw).alias("text_crc32"),
    )
    rows = materialize(rows.withColumn("_ld_key", F.coalesce("_ld_key", F.lit("null"))), "shard-rows")
    groups = rows.groupBy("_ld_key").agg(F.sum("_ld_size").alias("group_size"), F.count(F.lit(1)).alias("_ld_rows"))
    numbered = materialize(salted_rank(groups, ["group_size"], [F.col("_ld_key")], salts, "_ld_rank", F.xxhash64("_ld_key")), "shard-groups")
    got = numbered.groupBy("group_size").count().toPandas().sort_values("group_size", ascending=False)
    histogram = list(zip(got["group_size"].astype(int).tolist(), got["count"].astype(int).tolist(), strict=True))
    runs = into_shards(histogram, shards) if shards else best_fit_decreasing(histogram, capacity)
    placed = numbered.join(_run_table(docs.sparkSession, runs), "group_size")
    # The last run of the size that begins at or before the group's rank.
    at = F.expr("filter(_ld_runs, r -> r.first <= _ld_rank)[size(filter(_ld_runs, r -> r.first <= _ld_rank)) - 1].shard")
    placed = placed.select("_ld_key", "group_size", at.alias("shard"))
    out = spread(rows, placed, ["_ld_key"], numbered.select("_ld_key", "_ld_rows"), "_ld_rows")
    ident = [F.col("_ld_key"), *(F.col(f"`{c}`") for c in docs.columns if c == "doc_id")]
    return salted_rank(out, ["shard"], ident, salts, "slot", F.xxhash64(*ident)).drop("_ld_key")


def _run_table(spark, runs: list[Run]) -> DataFrame:
    """group_size, runs: the packing as a table, one row a size, spread like any other (a size has at most one run a shard)."""
    import pandas as pd

    table = pd.DataFrame({"group_size": np.array([r.size for r in runs], np.int64), "first": np.array([r.first for r in runs], np.int64), "shard": np.array([r.shard for r in runs], np.int32)})
    df = spark.createDataFrame(table, "group_size bigint, first bigint, shard int")
    return df.groupBy("group_size").agg(F.sort_array(F.collect_list(F.struct("first", "shard"))).alias("_ld_runs"))
