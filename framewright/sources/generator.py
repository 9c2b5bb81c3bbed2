"""Generated readout messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORBITS_A_FRAME = 256
# Fixed value: orbits in a second.
ORBITS_A_SECOND = 11223


def messages(spark: SparkSession, n_frames: int, links: int = 2, bytes_a_page: int = 8192, pages: int = 4) -> DataFrame:
    """A row for each frame and link: seven of ten from the TPC, others from the ITS; about one frame in 67 is left out after a hash of its id."""
    link = spark.range(n_frames).select(F.col("id").alias("timeframe_id"), F.explode(F.sequence(F.lit(0), F.lit(links - 1))).alias("link_id"))
    x = link.where(F.pmod(F.col("timeframe_id") * 7919 + 13, F.lit(67)) != 0)
    draw = F.pmod(F.col("timeframe_id") * 31 + F.col("link_id") * 17, F.lit(10))
    return x.select(
        F.lit(2).alias("version"), "timeframe_id", F.lit(1).cast("bigint").alias("run_number"), F.when(draw < 7, 3).otherwise(4).alias("system_id"), F.lit(0xFEE0).alias("fee_id"), F.lit(0xE1D0).alias("equipment_id"), F.col("link_id").cast("bigint").alias("link_id"),
        (F.col("timeframe_id") * ORBITS_A_FRAME).alias("orbit_first"), ((F.col("timeframe_id") + 1) * ORBITS_A_FRAME - 1).alias("orbit_last"), (F.col("link_id") == links - 1).alias("last_tf"), F.lit(True).alias("is_rdh"), F.lit(pages * bytes_a_page).cast("bigint").alias("n_bytes"),
    )


def superpages(messages: DataFrame, bits_per_second: int, page_bytes: int = 1 << 20, free_pages: int = 64) -> DataFrame:
    """Messages with what their link makes in a frame's time at a bit rate: bytes, pages, and what is lost as no page is free for it."""
    made = F.lit(bits_per_second * ORBITS_A_FRAME // (8 * ORBITS_A_SECOND)).cast("bigint")
    pages = F.ceil(made / page_bytes)
    got = F.least(made, F.lit(page_bytes * free_pages).cast("bigint"))
    return messages.withColumns({"made": made, "n_pages": F.least(pages, F.lit(free_pages)).cast("bigint"), "lost": made - got})


def replayed(frames: DataFrame, times: int, step: int) -> DataFrame:
    """The frames again and again, ids moved on by `step` each time."""
    return frames.select("*", F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("round")).withColumn("tf_id", F.col("tf_id") + F.col("round") * step)
