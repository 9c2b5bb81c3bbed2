"""Column expressions shared by the operators that use none but Spark's own functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.store import written

#: The six ASCII characters between words, and all others, in a regular expression.
SPACE, NO_SPACE = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    """Words between white space; null: none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), "")


def word_chars(text: Column) -> Column:
    """Code points that are no white space: what is left without the six, which is faster than to list each place of them."""
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(""))
    return F.char_length(text)


def computed(df: DataFrame) -> DataFrame:
    """df, such that what uses its columns can't be moved below them: a filter on one would compute it anew."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def tagged(docs: DataFrame) -> DataFrame:
    """(row struct<all columns>, rid): docs, written to the shared folder with a number for each row.

    What is worked out from a few columns is joined by that number, so whole texts are exchanged only once.
    """
    return written(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("rid")))


def numbered(df: DataFrame, keys: Sequence[str], name: str = "copy") -> DataFrame:
    """df with a number from 0 for each row among those that agree in keys (null agrees with null).

    Rows are numbered within their key and input partition, after as many as the key has in partitions before; so a key
    that holds a third of all rows is spread over as many tasks as the input. Where a key is repeated, df is written to the
    shared folder first, so that both sums and rows see the same partitions; where none is, there is no exchange of rows.
    """
    if df.groupBy(*keys).count().where("count > 1").isEmpty():
        return df.withColumn(name, F.lit(0).cast("long"))
    x = written(df).withColumn("_pid", F.spark_partition_id())
    held = x.groupBy(*keys, "_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_pid")) - F.col("_n")
    held = held.withColumn("_before", before).where("_before > 0").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_pid").alias("_p"), "_before")
    on = F.col("_pid") == F.col("_p")
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    own = F.row_number().over(Window.partitionBy(*keys, "_pid").orderBy(*keys)) - 1
    return x.join(held, on, "left").select(*df.columns, (own + F.coalesce("_before", F.lit(0))).cast("long").alias(name))
