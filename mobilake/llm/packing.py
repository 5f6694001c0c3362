"""Problem 9: items of varying length into containers of one capacity.

Items are reduced to a histogram of lengths (at most ``capacity`` rows), which
is all the packer needs: each container is seeded with the longest length
left, a bitset subset-sum programme over the remaining lengths finds the
multiset that comes closest to the capacity, and it is backtracked into counts
per length. The same multiset is used as often as the counts last, so the work
depends on the number of distinct lengths and not on the number of items.
Then every item gets its rank within its length and looks its container up.

A length that a large share of the rows has is ranked in salted groups of
bounded size, with offsets from their counts. An item longer than the capacity
is divided into full containers and a remainder, no other item is divided.

Defined cases: items of length 0 (empty and null texts) use no space and go
to container 0; ties between items of one length are broken by a hash of the
id and the id; repeated ids are separate items; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

GROUP_ROWS = 50_000


@dataclass(frozen=True)
class Pattern:
    """A multiset of lengths, used for ``times`` containers from number ``first`` on."""

    counts: tuple[tuple[int, int], ...]
    first: int
    times: int


def fill(target: int, lengths: list[int], left: Mapping[int, int]) -> dict[int, int]:
    """Counts per length with the largest total that is at most target.

    Bit k of ``reach`` says that k can be made of the lengths seen so far;
    the counts are split into powers of two. Stops when target is reached.
    """
    mask = (1 << (target + 1)) - 1
    reach, steps = 1, []
    for n in lengths:
        if n > target:
            continue
        most = min(left[n], target // n)
        k = 1
        while most > 0:
            k = min(k, most)
            new = reach | (reach << (n * k)) & mask
            if new != reach:
                steps.append((n, k, reach))
                reach = new
            most -= k
            k *= 2
        if reach >> target & 1:
            break
    total = reach.bit_length() - 1
    counts: dict[int, int] = {}
    for n, k, was in reversed(steps):
        if not was >> total & 1:  # only with this step
            counts[n] = counts.get(n, 0) + k
            total -= n * k
    return counts


def pack_histogram(histogram: Mapping[int, int], capacity: int) -> list[Pattern]:
    """Minimum bin slack over a histogram of lengths 1..capacity."""
    left = {n: c for n, c in histogram.items() if c > 0}
    lengths = sorted(left, reverse=True)
    out, first = [], 0
    while lengths:
        seed = lengths[0]
        left[seed] -= 1
        counts = fill(capacity - seed, lengths, left)
        left[seed] += 1
        counts[seed] = counts.get(seed, 0) + 1
        times = min(left[n] // c for n, c in counts.items())
        out.append(Pattern(tuple(sorted(counts.items(), reverse=True)), first, times))
        first += times
        for n, c in counts.items():
            left[n] -= c * times
        lengths = [n for n in lengths if left[n]]
    return out


def _intervals(patterns: list[Pattern]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (length, first rank) keys with the container of that rank and the items per container."""
    used: dict[int, int] = {}
    rows = []
    for p in patterns:
        for n, c in p.counts:
            start = used.get(n, 0)
            rows.append((n, start, p.first, c))
            used[n] = start + c * p.times
    rows.sort()
    a = np.array(rows or [(0, 0, 0, 1)], dtype=np.int64)
    return a[:, 0] << 44 | a[:, 1], a[:, 1], a[:, 2], a[:, 3]


def pack(items: DataFrame, key: str, size: str, capacity: int = 4096) -> DataFrame:
    """(key, piece, pieces, size, container) for every item; undivided items have one piece."""
    n = F.coalesce(F.col(size).cast("bigint"), F.lit(0))
    d = items.select(F.col(key).alias("__key"), n.alias("__n"))
    d = d.withColumn("__pieces", F.greatest(F.lit(1), F.ceil(F.col("__n") / capacity)).cast("bigint"))
    d = d.withColumn("__piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__pieces") - 1)))
    d = d.withColumn("__size", F.least(F.lit(capacity).cast("bigint"), F.col("__n") - F.col("__piece") * capacity))
    hist = {r[0]: r[1] for r in d.groupBy("__size").agg(F.count(F.lit(1)).alias("n")).collect()}
    patterns = pack_histogram({k: v for k, v in hist.items() if k > 0}, capacity)
    table = items.sparkSession.sparkContext.broadcast(_intervals(patterns))  # as long as the patterns, whatever the number of items

    salts = {k: -(-v // GROUP_ROWS) for k, v in hist.items() if v > GROUP_ROWS}
    salt = F.lit(0).cast("bigint")
    if salts:
        by = F.create_map(*[x for k, v in salts.items() for x in (F.lit(k).cast("bigint"), F.lit(v).cast("bigint"))])
        salt = F.pmod(F.xxhash64("__key", "__piece"), F.coalesce(F.try_element_at(by, F.col("__size")), F.lit(1).cast("bigint")))
    d = d.withColumn("__salt", salt)
    d = d.withColumn("__rn", F.row_number().over(Window.partitionBy("__size", "__salt").orderBy(F.xxhash64("__key", "__piece"), "__key", "__piece")) - 1)
    if salts:
        counts = d.groupBy("__size", "__salt").agg(F.count(F.lit(1)).alias("__c")).where(F.col("__size").isin(*salts))
        w = Window.partitionBy("__size").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.select(F.col("__size").alias("__s2"), F.col("__salt").alias("__t2"), F.coalesce(F.sum("__c").over(w), F.lit(0)).alias("__off"))
        d = d.join(offsets, (F.col("__size") == F.col("__s2")) & (F.col("__salt") == F.col("__t2")), "left")
        d = d.withColumn("__rn", F.col("__rn") + F.coalesce("__off", F.lit(0)))

    @F.arrow_udf(T.LongType())
    def container(length: pa.Array, rank: pa.Array) -> pa.Array:
        n, r = length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False).astype(np.int64)
        starts, ranks, firsts, per = table.value
        i = np.searchsorted(starts, n.astype(np.int64) << 44 | r, side="right") - 1
        return pa.array(np.where(n > 0, firsts[i] + (r - ranks[i]) // per[i], 0), pa.int64())

    return d.select(F.col("__key").alias(key), F.col("__piece").alias("piece"), F.col("__pieces").alias("pieces"), F.col("__size").alias(size), container(F.col("__size"), F.col("__rn").cast("bigint")).alias("container"))
