"""Documents dealt into chunks of bounded size, which ask questions of hash blocks and get answers back.

A statistic over the whole corpus (how often a window occurs, how a context predicts) is asked by
each chunk once for each distinct key, packed by block; the blocks answer in the same order. So a
common key costs one entry a chunk, not one a row, and neither side needs more than one chunk or block
in memory. All exchanges are plain shuffles, which Spark recomputes if an executor is lost.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 3 << 20


def totals(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """(rows, bytes of text)."""
    row = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.col(text)))).first()
    return row[0], row[1] or 0


def chunked(docs: DataFrame, size: int, id_col: str = "doc_id", text: str = "text", keep: tuple[Column, ...] = (), chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(chunk, doc_id, text, ...): about chunk_bytes of text each, by a hash of the row's place in the input.

    So neither null ids nor copies meet in one chunk. Which rows do doesn't matter for the results, but passes over the chunks must see
    the same ones: docs should be a table or what a written one gives, whose partitions are read alike again.
    """
    n = max(1, math.ceil(size / chunk_bytes))
    key = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int")
    rows = docs.select(key.alias("chunk"), F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"), *keep)
    return rows.repartition(max(12, math.ceil(n / 3)), "chunk")
