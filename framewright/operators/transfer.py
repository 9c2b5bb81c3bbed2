"""Planning transfers: coalescing neighbours, finding regions, merging freed intervals."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions.scalar import align_up

GAP = 8192


def coalesced(parts: DataFrame, keys: tuple[str, ...] = ("tf_id", "sender"), gap: int = GAP) -> DataFrame:
    """Parts with their transfer group: sorted by address, a group goes on while the region is the same and the gap small. Parts without data are in none."""
    w = Window.partitionBy(*keys).orderBy("addr")
    x = parts.where("len > 0 and addr > 0")
    far = (F.lag("region").over(w) != F.col("region")) | (F.col("addr") - F.lag(F.col("addr") + F.col("len")).over(w) > gap)
    x = x.withColumn("_new", F.coalesce(far.cast("int"), F.lit(0)))
    return x.withColumn("txg", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def groups(parts: DataFrame, keys: tuple[str, ...] = ("tf_id", "sender"), gap: int = GAP) -> DataFrame:
    """One transfer for each group: start, length with its gaps, parts."""
    x = coalesced(parts, keys, gap).groupBy(*keys, "txg").agg(F.min("region").alias("region"), F.min("addr").alias("start"), F.max(F.col("addr") + F.col("len")).alias("end"), F.count(F.lit(1)).alias("data_parts"), F.sum("len").alias("data"))
    return x.withColumn("len", F.col("end") - F.col("start")).withColumn("gap", F.col("len") - F.col("data")).drop("end")


def located(parts: DataFrame, keys: tuple[str, ...] = ("tf_id", "sender")) -> DataFrame:
    """Each part's offset within its group's transfer."""
    w = Window.partitionBy(*keys).orderBy("addr")
    begins = F.coalesce(F.col("txg") != F.lag("txg").over(w), F.lit(True))
    x = coalesced(parts, keys).withColumn("_begin", F.when(begins, F.col("addr")))
    x = x.withColumn("start", F.max("_begin").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_begin")
    return x.withColumn("offset", F.col("addr") - F.col("start"))


def in_region(points: DataFrame, regions: DataFrame, cell: int = 1 << 18) -> DataFrame:
    """Points with the region that holds them, the largest if several do: a range join by cells of addresses, not by all pairs."""
    r = regions.select("region", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / cell), F.floor((F.col("start") + F.col("size") - 1) / cell))).alias("_c"))
    x = points.withColumn("_c", F.floor(F.col("addr") / cell)).join(r, "_c").where("addr >= start and addr + len <= start + size")
    cols = [c for c in points.columns]
    return x.groupBy(*cols).agg(F.max_by("region", F.struct("size", "region")).alias("region"))


def merged_intervals(blocks: DataFrame, keys: tuple[str, ...], align: int = 64) -> DataFrame:
    """Freed blocks, rounded up, that touch or overlap, as one interval each: its length, and how many blocks it is made of."""
    w = Window.partitionBy(*keys).orderBy("addr", "end")
    x = blocks.where("len > 0").withColumn("end", F.col("addr") + align_up(F.col("len"), align))
    x = x.withColumn("_reach", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    x = x.withColumn("_new", F.coalesce((F.col("addr") > F.col("_reach")).cast("int"), F.lit(1)))
    x = x.withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(*keys, "island").agg(F.min("addr").alias("start"), (F.max("end") - F.min("addr")).alias("len"), F.count(F.lit(1)).alias("n_blocks"))


def started(requests: DataFrame, most: int = 300, key: str = "worker") -> DataFrame:
    """(key, seq, at, start, in_flight): when each fetch begins if a worker has no more than `most` (2 to 5000) in flight, and how many it has then.

    requests: (key, seq, at, took). Fetches wait in the order of at and seq; one that ends makes room at that time. Workers are
    folded on their own, in order; only the ends of what is in flight are held.
    """
    most = min(5000, max(2, most))
    columns = [key, "seq", "at", "start", "in_flight"]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, ends, last = None, [], None
        for b in batches:
            out = []
            for w, seq, at, took in zip(b[key], b["seq"], b["at"], b["took"], strict=True):
                if w != now:
                    now, ends, last = w, [], at
                start = max(at, last)
                while ends and (ends[0] <= start or len(ends) >= most):
                    start = max(start, heapq.heappop(ends))
                last = start
                heapq.heappush(ends, start + took)
                out.append((w, seq, at, start, len(ends)))
            yield pd.DataFrame(out, columns=columns)

    x = requests.select(key, "seq", "at", "took").repartition(key).sortWithinPartitions(key, "at", "seq")
    return x.mapInPandas(fold, f"{key} long, seq long, at long, start long, in_flight long")
