"""Running values over a whole table's order, without putting the table into one task.

Rows are cut into ranges of an ordering number; each range is summed up, the sums are accumulated over the ranges (a table
smaller by the rows of a range), and windows run inside ranges only. The input is computed once, so calls can be nested.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.operators.tables import kept

#: Rows of a range, if numbers are spread evenly.
RANGE_ROWS = 100_000
_HOW = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}


def running(df: DataFrame, name: str, how: str, value: Column, order: str, keys: Sequence[str] = (), ties: Sequence[str] = (), before: bool = False, down: bool = False, width: int | None = None) -> DataFrame:
    """df with a running sum, max, min, count or last value, by keys, in the order of a whole number and `ties`.

    before: without the row itself. down: from the highest number to the lowest. width: of a range of numbers; by default such that
    a range has about RANGE_ROWS rows, however far the numbers lie apart. A null number comes first (down: last).
    """
    sign = -1 if down else 1
    x = kept(df.withColumns({"_v": value, "_o": F.col(order).cast("long") * sign}))
    if width is None:
        lo, hi, n = x.agg(F.min("_o"), F.max("_o"), F.count(F.lit(1))).first()
        width = max(1, -(-((hi or 0) - (lo or 0) + 1) // max(1, -(-n // RANGE_ROWS))))
    lowest = F.lit(-(1 << 62)) if sign > 0 else F.lit(1 << 62)
    x = x.withColumn("_b", F.coalesce(F.expr(f"_o div {width} - if(_o % {width} < 0, 1, 0)"), lowest))
    inside = Window.partitionBy(*keys, "_b").orderBy("_o", *ties).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    over = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    if how == "last":
        parts = x.groupBy(*keys, "_b").agg(F.max_by("_v", F.struct("_o", *ties)).alias("_p"))
        base, own = F.last("_p", ignorenulls=True).over(over), F.last("_v").over(inside)
        n = F.count(F.lit(1)).over(inside)
        x = x.withColumns({"_in": own, "_n": n})
        joined = _join(x, parts.withColumn("_base", base), keys)
        return joined.withColumn(name, F.when(F.col("_n") > 0, F.col("_in")).otherwise(F.col("_base"))).drop("_v", "_o", "_b", "_p", "_in", "_n", "_base")
    f = _HOW[how]
    parts = x.groupBy(*keys, "_b").agg(f("_v").alias("_p")).withColumn("_base", (F.sum if how == "count" else f)("_p").over(over))
    joined = _join(x.withColumn("_in", f("_v").over(inside)), parts, keys)
    both = F.coalesce(F.col("_in"), F.lit(0)) + F.coalesce(F.col("_base"), F.lit(0)) if how in ("sum", "count") else (F.greatest if how == "max" else F.least)("_in", "_base")
    return joined.withColumn(name, both).drop("_v", "_o", "_b", "_p", "_in", "_base")


def _join(x: DataFrame, parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    on = x["_b"] == parts["_b"]
    for k in keys:
        on &= x[k].eqNullSafe(parts[k])
    return x.join(parts, on).drop(parts["_b"], *[parts[k] for k in keys])


def ranked(df: DataFrame, name: str, order: str, ties: Sequence[str] = (), keys: Sequence[str] = (), width: int | None = None) -> DataFrame:
    """df with each row's place from 0."""
    return running(df, name, "count", F.lit(1), order, keys, ties, before=True, width=width)
