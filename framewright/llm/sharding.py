"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix. DataFrame expressions only."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.llm.native import numbered, tagged

#: Rows of a source partition or of a part of a shard, and the most such parts.
PART_ROWS, MOST_PARTS = 100_000, 1024


def _rest(n: int) -> float:
    """log n! less Stirling's approximation."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi)
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / n / n) / n / n) / n / n) / n


def _deviance(x: float, mean: float) -> float:
    """x log(x / mean) + mean - x, without loss where both are near."""
    if abs(x - mean) >= 0.1 * (x + mean):
        return x * math.log(x / mean) + mean - x
    v = (x - mean) / (x + mean)
    s, e, j = (x - mean) * v, 2 * x * v, 1
    while True:
        e *= v * v
        j += 2
        if s + e / j == s:
            return s
        s += e / j


def _log_binomial(k: int, n: int, p: float) -> float:
    if k in (0, n):
        return n * (math.log(p) if k else math.log1p(-p))
    return _rest(n) - _rest(k) - _rest(n - k) - _deviance(k, n * p) - _deviance(n - k, n * (1 - p)) + 0.5 * math.log(n / (2 * math.pi * k * (n - k)))


def hypergeometric(rng: random.Random, good: int, bad: int, drawn: int) -> int:
    """How many of `drawn` balls are good: inversion outwards from the mode, about one step a standard deviation, whatever the numbers."""
    lo, hi = max(0, drawn - bad), min(good, drawn)
    if lo == hi:
        return lo
    mode = min(hi, max(lo, (drawn + 1) * (good + 1) // (good + bad + 2)))
    p = drawn / (good + bad)
    up = down = math.exp(_log_binomial(mode, good, p) + _log_binomial(drawn - mode, bad, p) - _log_binomial(drawn, good + bad, p))
    a = b = mode
    u = rng.random() - up
    while u > 0 and (a > lo or b < hi) and up + down > 1e-18:
        if b < hi:
            up *= (good - b) * (drawn - b) / ((b + 1) * (bad - drawn + b + 1))
            b += 1
            u -= up
            if u <= 0:
                return b
        if a > lo:
            down *= a * (bad - drawn + a) / ((good - a + 1) * (drawn - a + 1))
            a -= 1
            u -= down
            if u <= 0:
                return a
    return mode


def communication_matrix(rng: random.Random, sources: list[int], targets: list[int]) -> list[list[int]]:
    """Counts from each source to each target, as a uniform shuffle of all rows would give them; rows and columns add up exactly."""
    left, out = list(targets), []
    for n in sources:
        rest, row = sum(left), []
        for j, room in enumerate(left):
            x = hypergeometric(rng, room, rest - room, n)
            rest -= room
            n -= x
            row.append(x)
            left[j] -= x
        out.append(row)
    return out


def shard_rows(docs: DataFrame, n_shards: int = 16, seed: int = 5, id_col: str = "doc_id", text: str = "text", part_rows: int = PART_ROWS, carry: bool = True) -> DataFrame:
    """Deals all rows to shards 0..n_shards-1, whose row counts differ by one at most, in uniformly random order.

    Rows fall into source partitions by a hash. Their counts, MOST_PARTS at most, are all that the driver sees: from
    them it draws how many rows each sends to each part of each shard (hypergeometric). Each source permutes its rows
    by a seeded hash and cuts them at those counts; each part permutes what it gets by another hash. Two exchanges of ids and hashes,
    and no count over the result, as all sizes are known in advance. If carry, whole rows follow their places in one exchange more.

    Returns (row struct<all columns> if carry, doc_id, size, text_crc32, shard, slot gapless from 0 in each shard). size: UTF-8
    bytes + 1; null text counts as empty. Null ids are dealt like others. Rows that agree in id and text are numbered and
    hashed with their number, so copies scatter like other rows; among each other they are interchangeable. Rows whose hashes tie
    are ordered by id, size, crc and number. Runs agree for a seed, whatever the partitioning. An empty table gives no rows.
    """
    if carry:
        base = tagged(docs)
        x = base.select("rid", F.col("row")[id_col].alias("doc_id"), F.col("row")[text].alias("t"))
    else:
        x = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("t"))
    t = F.coalesce("t", F.lit(""))
    row = x.withColumns({"size": (F.octet_length(t) + 1).cast("long"), "text_crc32": F.crc32(t)}).drop("t")
    row = numbered(row, ("doc_id", "size", "text_crc32"))
    total = docs.count()
    n_parts = min(MOST_PARTS, max(64, math.ceil(total / part_rows)))
    cuts = math.ceil(n_parts / n_shards)
    source = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "copy"), F.lit(n_parts)).cast("int")
    row = row.withColumn("source", source)
    counts = dict(row.groupBy("source").count().collect())
    sources = [counts.get(i, 0) for i in range(n_parts)]
    sizes = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    targets = [n * (k + 1) // cuts - n * k // cuts for n in sizes for k in range(cuts)]
    matrix = communication_matrix(random.Random(seed), sources, targets)
    lines = []
    for i, counts_of in enumerate(matrix):
        ends, at = [], 0
        for x in counts_of:
            at += x
            ends.append(at)
        lines.append(f"({i}, '{' '.join(','.join(map(str, ends[s * cuts : (s + 1) * cuts])) for s in range(n_shards))}')")
    # n_parts rows of as many numbers: under 10 MB by MOST_PARTS
    plan = docs.sparkSession.sql(f"select * from values {', '.join(lines)} as t(source, ends)")
    plan = plan.select("source", F.transform(F.split("ends", " "), lambda s: F.transform(F.split(s, ","), lambda x: x.cast("long"))).alias("ends"))

    def random_order(of: int, *keys: str) -> Window:
        return Window.partitionBy(*keys).orderBy(F.xxhash64(F.lit(of), "doc_id", "text_crc32", "copy"), "doc_id", "size", "text_crc32", "copy")

    below: Column = F.col("rank")
    row = row.withColumn("rank", F.row_number().over(random_order(seed + 1, "source")) - 1).join(F.broadcast(plan), "source")
    row = row.withColumn("shard", F.size(F.filter("ends", lambda e: F.get(e, F.lit(cuts - 1)) <= below)))
    row = row.withColumn("part", F.size(F.filter(F.get("ends", F.col("shard")), lambda e: e <= below))).drop("ends", "rank", "source")
    held = F.lit(total // n_shards) + F.when(F.col("shard") < total % n_shards, 1).otherwise(0)
    slot = F.expr(f"({total // n_shards} + if(shard < {total % n_shards}, 1, 0)) * part div {cuts}") if total else held
    row = row.withColumn("slot", (slot + F.row_number().over(random_order(seed + 2, "shard", "part")) - 1).cast("long")).drop("part", "copy")
    return base.join(row, "rid").drop("rid") if carry else row


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"), carry=False)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
