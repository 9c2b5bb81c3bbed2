"""Views of the engine's inputs over the test tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.functions import scalar
from framewright.operators.ordered import ranked, running
from framewright.operators.tables import dealt

N_SENDERS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hbf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each page of readout data."""
    e = table(spark, sf_dir, "events")
    cru, link, ep = F.col("user_id") % 16, F.floor(F.col("user_id") / 16) % 8, F.col("user_id") % 2
    return e.select(
        F.col("event_id").alias("seq"), (F.expr("timestampdiff(HOUR, timestamp_ntz'2024-01-01 00:00:00', ts)") + 1).alias("tf_id"), (F.col("user_id") % N_SENDERS).alias("sender"), F.upper(F.substring("event_type", 1, 3)).alias("origin"),
        cru.alias("cru"), link.alias("link"), ep.alias("ep"), scalar.subspec(cru, link, ep).alias("subspec"), F.round(F.col("value") * 100).cast("bigint").alias("size"), F.get_json_object("props", "$.k").cast("int").alias("trigger"), "ts",
    )


def stf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each sub time frame: what one sender has of one frame."""
    return hbf(spark, sf_dir).groupBy("tf_id", "sender").agg(F.count(F.lit(1)).alias("n_parts"), F.sum("size").alias("stf_size"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.countDistinct("subspec").alias("n_equip"))


def stf_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Announcements of sub time frames in the order of their arrival, senders delayed against each other."""
    x = stf(spark, sf_dir).withColumn("at", F.col("last_seq") + F.col("sender") * 29)
    x = ranked(x, "seq", "at", ["tf_id", "sender"])
    x = running(x, "total", "sum", F.col("stf_size"), "seq", ["sender"])
    return x.select("seq", "tf_id", "sender", "stf_size", "n_parts", "n_equip", (F.col("total") % 1_000_000).alias("buffer_used"), F.lit(1_000_000).cast("bigint").alias("buffer_size"))


def stf_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same announcements, some of them late."""
    x = stf_info(spark, sf_dir).withColumn("at", F.col("seq") * 7919 % 64 + F.col("seq"))
    return ranked(x, "aseq", "at", ["tf_id", "sender"]).drop("at")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as blocks of one or two headers, right and wrong ones."""
    s, t, z = F.col("seq") % 6, F.col("trigger"), F.col("size")
    length = F.when(s == 0, 64).when(s == 1, 128).when(s == 2, 16384).otherwise(64 + z % 8000)
    x = hbf(spark, sf_dir).withColumn("length", length).withColumn("orbit", F.col("tf_id") * 256 + F.col("seq") % 256 - F.when(F.col("seq") % 97 == 0, 300).otherwise(0))
    mem = F.when((s <= 2) & (t % 3 != 0), 64).otherwise(F.least(F.col("length"), 64 + z % 4000))
    step = F.when(s == 1, 64).when(s == 2, 8192).otherwise(F.col("length"))
    head = lambda m, o, stop, sub: F.struct(m.cast("bigint").alias("memory_size"), o.cast("bigint").alias("offset_to_next"), stop.alias("stop_bit"), sub.alias("subspec"))
    one = head(mem, step, ~s.isin(1, 2), F.col("subspec"))
    two = head(F.when(t % 4 == 0, 65).otherwise(64), F.lit(64), t % 5 != 0, F.col("subspec") + F.when(t % 7 == 0, 1).otherwise(0))
    return x.withColumn("rdhs", F.when(s.isin(1, 2), F.array(one, two)).otherwise(F.array(one)))


def tf_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of time frames; a frame and sender can hold equal parts."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("tf_id"), (F.col("l_suppkey") % 8).alias("sender"), F.concat("l_returnflag", "l_linestatus").alias("equipment"), F.col("l_linenumber").cast("bigint").alias("line"), F.round("l_extendedprice").cast("bigint").alias("size"), (F.col("l_partkey") % 1000).cast("bigint").alias("subspec"))


def txg_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data parts with addresses in shared memory, gaps between them below and above the limit."""
    keys = ["tf_id", "sender"]
    x = dealt(tf_part(spark, sf_dir), *keys).groupBy(*keys, "equipment", "subspec").agg(F.sum("size").alias("len"))
    gap = F.when((F.col("subspec") + F.col("tf_id")) % 5 == 0, 9000).otherwise(F.col("subspec") % 3 * 512)
    x = x.withColumn("room", scalar.align_up(F.col("len"), 64) + gap)
    order = Window.partitionBy(*keys).orderBy("subspec", "equipment").rowsBetween(Window.unboundedPreceding, -1)
    return x.withColumn("addr", 4096 + F.coalesce(F.sum("room").over(order), F.lit(0))).withColumn("region", F.floor(F.col("addr") / 200_000)).drop("room")


SQL = """
with hbf as (select event_id seq, date_diff('hour', timestamp '2024-01-01', ts) + 1 tf_id, user_id % 8 sender, upper(substr(event_type, 1, 3)) origin, user_id % 16 cru, (user_id // 16) % 8 link, user_id % 2 ep,
  ((user_id % 16) << 16) | ((((user_id // 16) % 8) + 1) << (case when user_id % 2 = 0 then 0 else 8 end)) subspec, round(value * 100)::bigint size, json_extract(props, '$.k')::int trigger, ts from events),
stf as (select tf_id, sender, count(*) n_parts, sum(size)::bigint stf_size, min(seq) first_seq, max(seq) last_seq, count(distinct subspec) n_equip from hbf group by all),
info0 as (select row_number() over (order by last_seq + sender * 29, tf_id, sender) - 1 seq, * from stf),
stf_info as (select seq, tf_id, sender, stf_size, n_parts, n_equip, (sum(stf_size) over (partition by sender order by seq) % 1000000)::bigint buffer_used, 1000000 buffer_size from info0),
stf_shuffled as (select row_number() over (order by seq * 7919 % 64 + seq, tf_id, sender) - 1 aseq, * from stf_info),
blocks0 as (select *, case seq % 6 when 0 then 64 when 1 then 128 when 2 then 16384 else 64 + size % 8000 end length, tf_id * 256 + seq % 256 - case when seq % 97 = 0 then 300 else 0 end orbit from hbf),
blocks as (select *, case when seq % 6 <= 2 and trigger % 3 <> 0 then 64 else least(length, 64 + size % 4000) end mem1, case seq % 6 when 1 then 64 when 2 then 8192 else length end off1, seq % 6 not in (1, 2) stop1,
  case when trigger % 4 = 0 then 65 else 64 end mem2, 64 off2, trigger % 5 <> 0 stop2, subspec + case when trigger % 7 = 0 then 1 else 0 end sub2, seq % 6 in (1, 2) two from blocks0),
tf_part as (select l_orderkey tf_id, l_suppkey % 8 sender, l_returnflag || l_linestatus equipment, l_linenumber::bigint line, round(l_extendedprice)::bigint size, (l_partkey % 1000)::bigint subspec from lineitem),
txg0 as (select tf_id, sender, equipment, subspec, sum(size)::bigint len from tf_part group by all),
txg1 as (select *, (len + 63) // 64 * 64 + case when (subspec + tf_id) % 5 = 0 then 9000 else subspec % 3 * 512 end room from txg0),
txg2 as (select *, (4096 + coalesce(sum(room) over (partition by tf_id, sender order by subspec, equipment rows between unbounded preceding and 1 preceding), 0))::bigint addr from txg1),
txg_part as (select tf_id, sender, equipment, subspec, len, addr, addr // 200000 region from txg2)
"""
