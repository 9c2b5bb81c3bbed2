"""Filters on pages, messages and announcements. Each adds a flag or keeps rows, and can be chained with transform()."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions import scalar
from framewright.operators.ordered import running

HEADER = 64


def empty_trigger(rdhs: Column, length: Column) -> Column:
    """A block with nothing but headers: one that stops, or two of which only the second does, of equal source."""
    one, two = F.get(rdhs, F.lit(0)), F.get(rdhs, F.lit(1))
    alone = one["stop_bit"] & (length == HEADER) & (one["memory_size"] == HEADER)
    pair = ~one["stop_bit"] & (one["offset_to_next"] >= HEADER) & (one["offset_to_next"] <= length) & two["stop_bit"] & (one["memory_size"] == HEADER) & (two["memory_size"] == HEADER) & (one["subspec"] == two["subspec"])
    return length.isin(64, 128, 16384) & F.coalesce(alone | pair, F.lit(False))


def drop_empty_triggers(df: DataFrame, keys: tuple[str, ...] = ("tf_id", "sender", "subspec"), order: str = "seq") -> DataFrame:
    """Without empty blocks, but with the first block of each source in each frame whatever it holds."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) == 1
    return df.withColumn("_first", first).where(F.col("_first") | ~empty_trigger(F.col("rdhs"), F.col("length"))).drop("_first")


def sane(rdhs: Column, length: Column, orbit: Column, first_orbit: Column) -> Column:
    """Whether the headers of a block account for it: sizes and steps inside it, one source, a stop bit at last, and no orbit before the frame's first."""
    start = F.struct(length.cast("bigint").alias("left"), F.lit(True).alias("ok"), F.lit(False).alias("done"))

    def step(a: Column, h: Column) -> Column:
        stop, left = h["stop_bit"], a["left"]
        fits = (left >= HEADER) & (h["subspec"] == F.get(rdhs, F.lit(0))["subspec"]) & F.when(stop, h["memory_size"] <= left).otherwise((h["offset_to_next"] > 0) & (h["offset_to_next"] < left) & (h["memory_size"] < left))
        return F.struct((left - F.when(a["done"] | stop, 0).otherwise(h["offset_to_next"])).alias("left"), F.when(a["done"], a["ok"]).otherwise(a["ok"] & fits).alias("ok"), (a["done"] | (a["ok"] & fits & stop)).alias("done"))

    end = F.aggregate(rdhs, start, step)
    return (length >= HEADER) & (orbit >= first_orbit) & end["ok"] & end["done"]


def with_sanity(df: DataFrame, keys: tuple[str, ...] = ("tf_id", "sender"), order: str = "seq") -> DataFrame:
    """df with `sane`; a frame's first orbit is that of its first block."""
    first = F.first("orbit").over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("first_orbit", first).withColumn("sane", sane(F.col("rdhs"), F.col("length"), F.col("orbit"), F.col("first_orbit")))


def check_headers(mode: str) -> Callable[[DataFrame], DataFrame]:
    """off, drop (insane blocks go) or print (they are flagged)."""
    if mode not in ("off", "drop", "print"):
        raise ValueError(f"no such mode: {mode}")
    return {"off": lambda df: df, "print": with_sanity, "drop": lambda df: with_sanity(df).where("sane").drop("sane", "first_orbit")}[mode]


def monotone(df: DataFrame, value: str = "tf_id", order: str = "seq", keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose id is not below one received before."""
    return running(df, "_most", "max", F.col(value), order, keys).where(F.col(value) >= F.col("_most")).drop("_most")


def newer(df: DataFrame, value: str = "tf_id", order: str = "seq", keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose id is above all received before: repeated and older ones go."""
    return running(df, "_most", "max", F.col(value), order, keys, before=True).where(F.col("_most").isNull() | (F.col(value) > F.col("_most"))).drop("_most")


def current_run(df: DataFrame, run: str = "run", order: str = "seq") -> DataFrame:
    """Rows of the highest run so far, with `reset` where a higher one begins: lower runs are refused, higher ones start afresh."""
    x = running(df, "_most", "max", F.col(run), order, before=True)
    return x.where(F.col("_most").isNull() | (F.col(run) >= F.col("_most"))).withColumn("reset", F.col("_most").isNotNull() & (F.col(run) > F.col("_most"))).drop("_most")


def throttled(df: DataFrame, percent: float, key: str = "tf_id") -> DataFrame:
    """A share of the frames; all senders agree on which."""
    return df.where(scalar.chance(F.col(key), percent))


def full_buffers(df: DataFrame, percent: int = 97) -> DataFrame:
    """Ids of frames that a sender with a full buffer has announced: they are dropped everywhere."""
    return df.where(F.col("buffer_used") * 100 > F.col("buffer_size") * percent).select("tf_id").distinct()


def newest(df: DataFrame, n: int, keys: tuple[str, ...], order: str) -> DataFrame:
    """The n newest rows by keys: a bounded queue that drops its oldest."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where(F.col("_n") <= n).drop("_n")


def well_formed(df: DataFrame, version: int = 2, header_size: int = 48) -> DataFrame:
    """Messages of this version and header size; with no pages only if they are a frame's last."""
    return df.where((F.col("version") == version) & (F.col("header_size") == header_size) & ((F.size("pages") > 0) | F.col("last_tf")))


def announceable(stfs: DataFrame, keys: tuple[str, ...] = ("sender", "tf_id"), order: str = "seq", topological: bool = False) -> DataFrame:
    """What a sender may announce: sub time frames (origin, n_equip) of a known origin, the first of each id; topological ones of just one equipment."""
    ok = F.col("origin").isin(*scalar.DETECTORS)
    x = stfs.where(ok & (F.col("n_equip") == 1)) if topological else stfs.where(ok)
    cols = [c for c in x.columns if c not in keys]
    return x.groupBy(*keys).agg(F.min_by(F.struct(*cols), order).alias("_r")).select(*keys, "_r.*").select(stfs.columns)


def with_payload(messages: DataFrame, parts: str = "parts") -> DataFrame:
    """Messages that have data: one with headers only, or nothing, is refused."""
    return messages.where(F.exists(parts, lambda p: p > 0))
