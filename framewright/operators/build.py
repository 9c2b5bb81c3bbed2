"""Building sub time frames from pages, topological ones from counts, and time frames from sub time frames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from framewright.operators.ordered import ranked


def sub_time_frames(pages: DataFrame, keys: tuple[str, ...] = ("tf_id", "sender")) -> DataFrame:
    """A row for each frame, sender and equipment: parts in the order of arrival, counted and added up; the lowest orbit."""
    part = F.struct("seq", "size")
    return pages.groupBy(*keys, "origin", "subspec").agg(F.count(F.lit(1)).alias("n_parts"), F.sum("size").alias("data_size"), F.min(F.col("tf_id") * 256).alias("first_orbit"), F.transform(F.sort_array(F.collect_list(part)), lambda p: p["size"]).alias("parts"))


def time_frames(pages: DataFrame, n_senders: int) -> DataFrame:
    """A row for each frame, merged over senders, and whether all of them are there."""
    one = pages.groupBy("tf_id", "sender", "origin", "subspec").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    out = one.groupBy("tf_id").agg(F.countDistinct("sender").alias("n_senders"), F.sum("n").alias("n_parts"), F.sum("size").alias("tf_size"), F.countDistinct("origin", "subspec").alias("n_equipments"))
    return out.withColumn("complete", F.col("n_senders") == n_senders)


def conflicts(parts: DataFrame, keys: tuple[str, ...] = ("tf_id", "equipment")) -> DataFrame:
    """Equipments that more than one sender has in a frame; their data are kept all the same."""
    return parts.groupBy(*keys).agg(F.countDistinct("sender").alias("n_senders"), F.count(F.lit(1)).alias("n_parts"), F.sum("size").alias("size")).where("n_senders > 1")


def spans(pages: DataFrame, keys: tuple[str, ...] = ("sender",), value: str = "subspec", order: str = "seq") -> DataFrame:
    """Runs of pages with one source that follow each other, numbered within keys."""
    w = Window.partitionBy(*keys).orderBy(order)
    x = pages.withColumn("_new", F.coalesce((F.lag(value).over(w) != F.col(value)).cast("int"), F.lit(1)))
    x = x.withColumn("span", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(*keys, "span").agg(F.first(value).alias(value), F.count(F.lit(1)).alias("n_pages"), F.min(order).alias("first_seq"), F.sum("size").alias("size"))


def topology_frames(pages: DataFrame, n: int = 128, key: str = "subspec", order: str = "seq") -> DataFrame:
    """Windows of n pages of each source; the last may hold fewer. Renumbered over all sources by the page that begins them."""
    ordinal = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    x = pages.withColumn("window", F.floor(ordinal / n)).groupBy(key, "window").agg(F.count(F.lit(1)).alias("n_pages"), F.sum("size").alias("size"), F.min(order).alias("first_seq"), F.max(order).alias("last_seq"))
    return ranked(x, "topo_id", "first_seq").withColumn("topo_id", F.col("topo_id") + 1)


def topology_frames_by_orbit(pages: DataFrame, n: int, key: str = "subspec", order: str = "seq") -> DataFrame:
    """As topology_frames, but a window is closed only by the first page of another orbit once it holds n pages.

    Where a window closes depends on where the last one did, so each source is folded in order; a source's pages pass
    through in batches, and only the open window is held.
    """
    schema = f"{key} long, window long, n_pages long, size long, first_seq long, last_seq long"

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: list | None = None  # key, window, pages, size, first, last, orbit
        for b in batches:
            out = []
            for k, s, z, o in zip(b[key], b[order], b["size"], b["orbit"], strict=True):
                if now is None or now[0] != k or now[2] >= n and o != now[6]:
                    if now is not None:
                        out.append(now[:6])
                    now = [k, now[1] + 1 if now is not None and now[0] == k else 0, 0, 0, s, s, o]
                now[2], now[3], now[5], now[6] = now[2] + 1, now[3] + z, s, o
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])
        if now is not None:
            yield pd.DataFrame([now[:6]], columns=[c.split()[0] for c in schema.split(", ")])

    return pages.select(key, order, "size", "orbit").repartition(key).sortWithinPartitions(key, order).mapInPandas(fold, schema)


def restamped(parts: DataFrame, message: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """Header counters of split payloads: index and number of parts for several, 0 of 1 for one."""
    w = Window.partitionBy(*message)
    n = F.count(F.lit(1)).over(w)
    at = F.row_number().over(w.orderBy(*order)) - 1
    return parts.withColumns({"split_index": F.when(n > 1, at).otherwise(0).cast("bigint"), "split_parts": n})


def merged_header(stfs: DataFrame) -> DataFrame:
    """Header fields of a frame: the lowest orbit that is known, the highest run, the origin of the earliest."""
    return stfs.groupBy("tf_id").agg(F.min("first_orbit").alias("first_orbit"), F.max("run").alias("run"), F.min_by("source", "seq").alias("source"), F.coalesce(F.min(F.when(F.col("created") > 0, F.col("created"))), F.lit(0)).alias("created"))


def continued(parts: DataFrame, keys: tuple[str, ...], header: str, order: str) -> DataFrame:
    """Parts without a header belong to the last one that has one: their payload goes on."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return parts.withColumns({"message": F.last(header, ignorenulls=True).over(w), "message_no": F.count(header).over(w)})


def index(parts: DataFrame, header: int = 96) -> DataFrame:
    """The index of a frame's file: for each equipment, in order, parts, bytes with headers, and offset of the first."""
    x = parts.groupBy("tf_id", "equipment").agg(F.count(F.lit(1)).alias("block_cnt"), F.sum(F.col("size") + header).alias("size"))
    before = Window.partitionBy("tf_id").orderBy("equipment").rowsBetween(Window.unboundedPreceding, -1)
    return x.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)))


def consistency(frames: DataFrame, keys: tuple[str, ...], checked: tuple[str, ...]) -> DataFrame:
    """Frames whose parts disagree in fields that all should share."""
    x = frames.groupBy(*keys).agg(*[F.countDistinct(c).alias(f"n_{c}") for c in checked])
    bad = F.lit(False)
    for c in checked:
        bad |= F.col(f"n_{c}") > 1
    return x.where(bad)


def decoded_channel(messages: DataFrame, keys: tuple[str, ...] = ("tf_id",)) -> DataFrame:
    """(keys, place, at, kind, n_payloads, error): the data items of each frame's list of messages (keys, at, split_index, split_parts, stf_header).

    At an item's first message, up to one split part means a header and its payload; an index of 0 full headers, one before each of
    the parts; an index as large as the number of parts one header before all of them. Anything else, or a list too short, is an error, at
    which decoding of the frame ends. A frame's header is an item of kind stf_header; one without it gets a last row with the error no_header.
    Where an item begins depends on the last one, so frames are folded in order, with a few numbers of state: work and memory
    don't depend on how long a frame's list is. A null place is no message's, a null index fits no split, null parts are none.
    """
    own = StructType([messages.schema[k] for k in keys])
    schema = StructType(own.fields)
    for name, kind in (("place", "long"), ("at", "long"), ("kind", "string"), ("n_payloads", "long"), ("error", "string")):
        schema = schema.add(name, kind)
    columns = ["at", "split_index", "split_parts", "stf_header", "n"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, following, place, headed, kinds = None, 0, 0, 0, False, None

        def packed(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=schema.names)

        for b in batches:
            kinds = kinds or [*(b.schema.field(k).type for k in keys), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
            out = []
            frames = zip(*(b.column(k).to_pylist() for k in keys), strict=True)
            for frame, at, first, parts, header, length in zip(frames, *(b.column(c).to_numpy(zero_copy_only=False).tolist() for c in columns), strict=True):
                if frame != now:
                    if now is not None and not headed:
                        out.append((*now, place, n, "none", 0, "no_header"))
                    now, n, following, place, headed = frame, length, 0, 0, False
                if at != following:
                    continue
                bad = parts > 1 and first not in (0, parts)
                needed = 2 if parts <= 1 else 2 * parts if first == 0 else 1 + parts
                kind = ("full_split" if first == 0 else "reduced_split") if parts > 1 else "stf_header" if header else "single"
                error = "split_index" if bad else "too_short" if n - at < needed else None
                out.append((*now, place, at, kind, parts if parts > 1 else 1, error))
                following, place, headed = -1 if error else at + needed, place + 1, headed or kind == "stf_header"
            if out:
                yield packed(out)
        if now is not None and not headed:
            yield packed([(*now, place, n, "none", 0, "no_header")])

    none = F.lit(-1).cast("long")
    x = messages.select(*keys, F.coalesce(F.col("at").cast("long"), none).alias("at"), F.coalesce(F.col("split_index").cast("long"), none).alias("split_index"), F.coalesce(F.col("split_parts").cast("long"), F.lit(0)).alias("split_parts"), F.coalesce("stf_header", F.lit(False)).alias("stf_header"))
    order = [*keys, *columns[:-1]]
    whole = Window.partitionBy(*keys).orderBy(*columns[:-1]).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return x.withColumn("n", F.count(F.lit(1)).over(whole)).sortWithinPartitions(*order).mapInArrow(fold, schema)


def inspected(headers: DataFrame, keys: tuple[str, ...] = ("tf_id",)) -> DataFrame:
    """(keys, orbit, counter, run, start, split): which checks a frame's headers fail (first_orbit, tf_counter, run, start_time, split_index, split_parts).

    All known first orbits (0: unknown), frame counters, runs and start times should be one; the first of split messages has
    index 0 or as many as there are parts, and 0 parts are none. Null fields are ignored. Sums by frame only.
    """
    differ = lambda c: F.coalesce(F.min(c) != F.max(c), F.lit(False))
    parts, first = F.col("split_parts"), F.col("split_index")
    bad = (parts == 0) | ((parts > 1) & (first != 0) & (first != parts))
    return headers.groupBy(*keys).agg(differ(F.nullif(F.col("first_orbit"), F.lit(0))).alias("orbit"), differ(F.col("tf_counter")).alias("counter"), differ(F.col("run")).alias("run"), differ(F.col("start_time")).alias("start"), F.coalesce(F.bool_or(bad), F.lit(False)).alias("split"))


def with_end_of_stream(frames: DataFrame, peers: DataFrame, order: str = "tf_id") -> DataFrame:
    """Frames (peer, tf_id), and after the last of them an end-of-stream row (tf_id null, end true) for every peer, those without frames too."""
    ends = peers.select("peer", F.lit(None).cast(frames.schema[order].dataType).alias(order), F.lit(True).alias("end")).distinct()
    return frames.select("peer", order, F.lit(False).alias("end")).unionByName(ends)
