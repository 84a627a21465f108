"""Sharding: minimax contiguous partition of atomic groups [native].

Rows with equal texts form a group that is never split. Groups stand in the order of their text's MD5 (its first 60 bits);
the shards are contiguous ranges of that order, and the largest shard is as small as any contiguous cut allows.

Null texts count as empty ones (size 1). Null ``doc_id``s, repeated rows and an empty table are allowed: each input
row gives one output row; repeated rows share a shard and get different slots. Columns other than ``doc_id`` and
``text`` are ignored.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import ordered, positions, table, written

#: Capacities tried in one pass over the group ends while the interval still holds more than KEPT of them.
WIDTH = 7
#: Group ends (one integer each) that the driver may hold to finish the search.
KEPT = 65_536


def _cuts(ends: DataFrame, capacities: list[int], shards: int, total: int, widest: int) -> list[list[int]]:
    """For each capacity, the prefix sums at which a greedy filling ends its shards.

    Each step is one aggregation for all capacities; the driver sees one number per capacity. The next cut lies
    within ``widest`` of its bound, so row groups elsewhere are skipped.
    """
    cuts: list[list[int]] = [[] for _ in capacities]
    for _ in range(shards):
        bounds = [(c[-1] if c else 0) + cap for c, cap in zip(cuts, capacities, strict=True)]
        near = ends.where((F.col("end") > min(bounds) - widest - 1) & (F.col("end") <= max(bounds)))
        row = near.agg(*(F.max(F.when(F.col("end") <= b, F.col("end"))).alias(f"c{j}") for j, b in enumerate(bounds))).first()
        for j, c in enumerate(cuts):
            c.append(max(row[j] or 0, c[-1] if c else 0))
        if all(c[-1] >= total for c in cuts):
            break
    return cuts


def _finish(ends: list[int], low: int, high: int, shards: int, total: int) -> list[int]:
    """Binary search for the smallest feasible capacity in (low, high], given all ends at which its cuts can fall."""

    def greedy(capacity: int) -> list[int]:
        cuts: list[int] = []
        while len(cuts) < shards and (not cuts or cuts[-1] < total):
            at = bisect_right(ends, (cuts[-1] if cuts else 0) + capacity)
            cuts.append(ends[at - 1] if at else 0)
        return cuts

    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if greedy(middle)[-1] >= total else (middle, high)
    return greedy(high)


def minimax_cuts(ends: DataFrame, shards: int, total: int, widest: int) -> list[int]:
    """The ends of the shards under the smallest feasible capacity.

    ends: column ``end``, the prefix sums at group ends. A capacity is feasible if greedy filling needs no more than
    ``shards`` shards. Larger capacities move every cut forward, so between an infeasible and a feasible capacity only
    the ends between their cuts matter; once those are KEPT at most, the bisection ends on the driver. Before that,
    WIDTH capacities between the two are tried in each pass.
    """
    low = max(widest, -(-total // shards))
    high = -(-total // shards) + widest
    low_cuts, high_cuts = _cuts(ends, [low, high], shards, total, widest)
    if low_cuts[-1] >= total:
        return low_cuts
    while high - low > 1:
        between = F.lit(False)
        for i, c in enumerate(high_cuts):
            between = between | F.col("end").between(low_cuts[min(i, len(low_cuts) - 1)], c)
        found = [r[0] for r in ends.where(between).select("end").limit(KEPT + 1).collect()]
        if len(found) <= KEPT:
            return _finish(sorted(found), low, high, shards, total)
        tried = sorted({low + (high - low) * (j + 1) // (WIDTH + 1) for j in range(WIDTH)} - {low, high})
        for cap, cuts in zip(tried, _cuts(ends, tried, shards, total, widest), strict=True):
            if cuts[-1] >= total:
                high, high_cuts = cap, cuts
                break
            low, low_cuts = cap, cuts
    return high_cuts


def shard_table(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long").alias("_group"))
    rows = positions(ordered(rows, [F.col("_group"), F.col("doc_id")]), "size")
    groups = rows.groupBy("_group").agg(F.max("cum").alias("end"), F.sum("size").alias("w"))
    ends = written(groups.repartitionByRange("end").sortWithinPartitions("end").select("end", "w"))
    total, widest = ends.agg(F.max("end"), F.max("w")).first()
    cuts = minimax_cuts(ends, shards, total, widest)[: shards - 1] if total else []
    shard = F.lit(0)
    for c in cuts:
        shard = shard + (F.col("cum") > c).cast("int")
    rows = rows.withColumn("shard", shard)
    starts = F.broadcast(rows.groupBy("shard").agg(F.min("pos").alias("_start")))  # one row a shard
    return rows.join(starts, "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("pos") - F.col("_start")).alias("slot"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_table(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
