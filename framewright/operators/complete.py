"""When time frames are complete: which senders are missing, what is emitted when, and what comes too late."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.operators.ordered import running
from framewright.operators.tables import kept


def first_arrivals(info: DataFrame, order: str = "seq") -> DataFrame:
    """The first announcement of each frame and sender; repeated ones are ignored."""
    cols = [c for c in info.columns if c not in ("tf_id", "sender")]
    return info.groupBy("tf_id", "sender").agg(F.min_by(F.struct(*cols), order).alias("_r")).select("tf_id", "sender", "_r.*")


def status(info: DataFrame, n_senders: int) -> DataFrame:
    """For each frame: senders, size, sizes by sender, and whether it is complete."""
    x = first_arrivals(info)
    out = x.groupBy("tf_id").agg(F.count(F.lit(1)).alias("n_senders"), F.sum("stf_size").alias("tf_size"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("sender", "stf_size")))).alias("sizes"))
    return out.withColumn("complete", F.col("n_senders") == n_senders)


def missing(info: DataFrame, n_senders: int) -> DataFrame:
    """(tf_id, sender) that are expected but weren't announced; the senders are a fixed list."""
    expected = info.select("tf_id").distinct().select("tf_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_senders - 1).cast("bigint"))).alias("sender"))
    return expected.join(info.select("tf_id", "sender").distinct(), ["tf_id", "sender"], "left_anti")


def emission(info: DataFrame, n_senders: int, order: str = "seq") -> DataFrame:
    """(tf_id, n_senders, complete, emit_seq): the announcement upon which a frame is given out, null if it is still open.

    A sender that has announced a frame has nothing more below it, so a frame is given out as soon as every sender has
    announced it or a later one: emit_seq = max over senders of the first arrival at or above the frame. Senders are in order.
    """
    x = first_arrivals(info, order).select("tf_id", "sender", order)
    ids = x.groupBy("tf_id").agg(F.count(F.lit(1)).alias("n_senders"))
    grid = ids.select("tf_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_senders - 1).cast("bigint"))).alias("sender"))
    grid = grid.join(x, ["tf_id", "sender"], "left")
    reached = running(grid, "q", "min", F.col(order), "tf_id", ["sender"], down=True)
    out = reached.groupBy("tf_id").agg(F.when(F.count("q") == n_senders, F.max("q")).alias("emit_seq"))
    return ids.join(out, "tf_id").withColumn("complete", F.col("n_senders") == n_senders)


def late(info: DataFrame, n_senders: int, order: str = "seq") -> DataFrame:
    """Announcements of frames that were given out before, each with the announcement that did it."""
    info = kept(info)
    return info.join(emission(info, n_senders, order).select("tf_id", "emit_seq"), "tf_id").where(F.col(order) > F.col("emit_seq"))


def gaps(ids: DataFrame, value: str = "tf_id", order: str = "tf_id", keys: tuple[str, ...] = ()) -> DataFrame:
    """How many ids are missing before each; before the first, those from 0."""
    x = running(ids, "previous", "last", F.col(value), order, keys, before=True)
    return x.withColumn("missing", F.col(value) - F.coalesce("previous", F.lit(0)) - 1)


def stale(info: DataFrame, n_senders: int, timeout: str, at: str = "ts") -> DataFrame:
    """Incomplete frames whose first announcement is older than the timeout when the last one of all arrives."""
    now = info.agg(F.max(at)).scalar()
    x = info.groupBy("tf_id").agg(F.countDistinct("sender").alias("n_senders"), F.min(at).alias("first_ts"))
    return x.where((F.col("n_senders") < n_senders) & (F.col("first_ts") < now - F.expr(timeout)))


def over_watermark(info: DataFrame, frames: DataFrame, percent: int = 90, most_bytes: int = 4 << 30, least_age: int = 0, at: str = "seq") -> DataFrame:
    """(tf_id, sender, stf_size, total): open frames to give up, oldest first, so that the sender with the fullest buffer gets room.

    Only if its last announcement shows more than `percent`. Frames are taken in order up to the highest complete one, but none from the first
    on that began less than `least_age` before the last announcement; those that the sender isn't in don't help it and stay. The sender's
    sizes are added up, and no frame is taken once they are over most_bytes.
    """
    last = info.groupBy("sender").agg(F.max_by(F.struct("buffer_used", "buffer_size"), "seq").alias("b"))
    used = F.col("b.buffer_used") / F.col("b.buffer_size")
    fullest = last.groupBy().agg(F.max_by("sender", F.struct(used, -F.col("sender"))).alias("sender"), F.max(used).alias("used")).where(F.col("used") > percent / 100).select("sender")
    open_ = frames.where("not complete").select("tf_id")
    began = info.join(open_, "tf_id", "left_semi").groupBy("tf_id").agg(F.min(at).alias("began"))
    now, done = info.agg(F.max(at)).scalar(), frames.where("complete").agg(F.max("tf_id")).scalar()
    young = began.where(now - F.col("began") < least_age).agg(F.min("tf_id")).scalar()
    old = began.where((F.col("tf_id") <= done) & (young.isNull() | (F.col("tf_id") < young))).select("tf_id")
    x = first_arrivals(info).join(F.broadcast(fullest), "sender", "left_semi").join(old, "tf_id", "left_semi").select("tf_id", "sender", "stf_size")
    return running(x, "total", "sum", F.col("stf_size"), "tf_id").where(F.col("total") - F.col("stf_size") <= most_bytes)


def stale_in_senders(stfs: DataFrame, timeout: int, at: str = "seq") -> DataFrame:
    """(sender, tf_id): what senders give up of their scheduled sub time frames (sender, tf_id, at): from the oldest id on, until one is no older than the timeout.

    Ages are counted up to the last row of all; what a worker has asked for isn't among them any more.
    """
    now = stfs.agg(F.max(at)).scalar()
    young = stfs.where(now - F.col(at) <= timeout).groupBy("sender").agg(F.min("tf_id").alias("young"))
    return stfs.join(young, "sender", "left").where(F.col("young").isNull() | (F.col("tf_id") < F.col("young"))).select("sender", "tf_id")
