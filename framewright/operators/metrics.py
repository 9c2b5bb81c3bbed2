"""Metrics: values and rates by interval, running statistics, counters of senders, latencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.operators.ordered import ranked


def values(metric: DataFrame, interval: Column, keys: tuple[str, ...] = ("name", "key")) -> DataFrame:
    """Mean, least and most by interval."""
    return metric.groupBy(*keys, interval.alias("interval")).agg(F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))


def rates(samples: DataFrame, interval: Column, seconds: int, keys: tuple[str, ...] = ("sender",)) -> DataFrame:
    """Mean size, rate and throughput for every interval from the first to the last that any key has, 0 where there is no sample."""
    x = samples.groupBy(*keys, interval.cast("bigint").alias("interval")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"), F.min("size").alias("least"), F.max("size").alias("most"))
    first, last = (x.agg(f("interval")).scalar() for f in (F.min, F.max))
    every = x.select(*keys).distinct().select(*keys, F.explode(F.sequence(first, last)).alias("interval"))
    x = every.join(x, [*keys, "interval"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return x.select(*keys, "interval", zero(F.col("total") / F.col("n")).alias("mean"), zero(F.col("least")).alias("least"), zero(F.col("most")).alias("most"), (zero(F.col("n")) / seconds).alias("rate"), (zero(F.col("total")) / seconds).alias("throughput"))


def recent(samples: DataFrame, keys: tuple[str, ...], order: str, value: str, n: int = 1024) -> DataFrame:
    """Over the last n samples: sum, mean, least, most, the mean of the steps up, and steps a unit (one over their mean)."""
    w = Window.partitionBy(*keys).orderBy(order)
    near = w.rowsBetween(-(n - 1), 0)
    x = samples.withColumn("_step", F.col(value) - F.lag(value).over(w))
    up = F.avg(F.when(F.col("_step") > 0, F.col("_step"))).over(near)
    return x.withColumns({"sum_n": F.sum(value).over(near), "mean_n": F.avg(value).over(near), "least_n": F.min(value).over(near), "most_n": F.max(value).over(near), "mean_step": up, "rate_step": 1 / up}).drop("_step")


def sender_counters(events: DataFrame) -> DataFrame:
    """Of each sender: buffered, in sending, sent, missing and rejected sub time frames, from its events."""
    count = lambda k: F.sum(F.when(F.col("kind") == k, 1).otherwise(0))
    out = events.groupBy("sender").agg(count("announced").alias("announced"), count("requested").alias("requested"), count("sent").alias("sent"), count("missing").alias("missing"), count("rejected").alias("rejected"))
    return out.withColumns({"in_sending": F.col("requested") - F.col("sent"), "buffered": F.col("announced") - F.col("sent") - F.col("rejected")})


def buffers(info: DataFrame) -> DataFrame:
    """Mean and highest use of the senders' buffers as last announced, and the sender that has it."""
    last = info.groupBy("sender").agg(F.max_by(F.struct("buffer_used", "buffer_size"), "seq").alias("b"))
    x = last.select("sender", (F.col("b.buffer_used") / F.col("b.buffer_size")).alias("used"))
    return x.groupBy().agg(F.avg("used").alias("mean_used"), F.max("used").alias("max_used"), F.max_by("sender", F.struct("used", "sender")).alias("fullest"))


def smoothed(samples: DataFrame, keys: tuple[str, ...], order: str, value: str, keep: float = 0.75, start: float = 0.5) -> DataFrame:
    """Exponentially weighted average in order, over each key's samples: a sum of weights by how many samples come after."""
    x = ranked(samples.select(*keys, order, F.col(value).cast("double").alias("v")).withColumn("_down", -F.col(order)), "_back", "_down", keys=keys)
    weight = F.pow(F.lit(keep), F.col("_back"))
    return x.groupBy(*keys).agg((start * F.pow(F.lit(keep), F.count(F.lit(1))) + (1 - keep) * F.sum(F.col("v") * weight)).alias("average"))


def latency(requests: DataFrame, receipts: DataFrame, keys: tuple[str, ...] = ("tf_id", "sender")) -> DataFrame:
    """Time from request to receipt."""
    return requests.join(receipts, list(keys)).withColumn("latency", F.col("received") - F.col("requested"))


def named(table: DataFrame, component: str, values: dict[str, Column]) -> DataFrame:
    """(component, name, value): aggregates of a table, all in one pass, a row for each; null where there are no rows."""
    x = table.agg(*[c.cast("double").alias(f"_{i}") for i, c in enumerate(values.values())])
    return x.select(F.lit(component).alias("component"), F.inline(F.array(*[F.struct(F.lit(k).alias("name"), F.col(f"_{i}").alias("value")) for i, k in enumerate(values)])))


def lines(metrics: DataFrame, keys: tuple[str, ...], values: tuple[str, ...], at: str, prefix: str = "") -> DataFrame:
    """(line): a line of text for each value that isn't null: name, keys and value, and the time in milliseconds, to be written to any store."""
    one = [F.struct(F.lit(prefix + v).alias("name"), F.col(v).cast("double").alias("value")) for v in values]
    x = metrics.select(*keys, at, F.inline(F.array(*one))).where("value is not null")
    tags = [F.concat(F.lit(f",{k}="), F.coalesce(F.col(k).cast("string"), F.lit(""))) for k in keys]
    return x.select(F.concat(F.col("name"), *tags, F.lit(" value="), F.format_string("%.6f", "value"), F.lit(" "), F.col(at).cast("string")).alias("line"))


def changes(samples: DataFrame, keys: tuple[str, ...], order: str, value: str) -> DataFrame:
    """samples with `changed`: whether the value differs from the one before of the same keys; the first does."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) == 1
    return samples.withColumn("changed", first | ~before.eqNullSafe(F.col(value)))
