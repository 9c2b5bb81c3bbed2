"""The engine's queries over the test tables, each with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.functions import headers, scalar
from framewright.operators import build, complete, filters, metrics, ordered, schedule, tables, transfer
from framewright.plans import views as v
from framewright.sources import generator, sidecar, tf_files
from framewright.streaming import builders, completer, replay

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
N = v.N_SENDERS


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, and SQL over the views."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = v.SQL + sql
        return f

    return put


# building


@query(f"""
select tf_id, count(distinct sender) n_senders, count(distinct sender) = {N} complete, count(*) n_parts, sum(size)::bigint tf_size, count(distinct origin || subspec::varchar) n_equipments from hbf group by tf_id""")
def tf_build(s, d):
    return build.time_frames(v.hbf(s, d), N).select("tf_id", "n_senders", "complete", "n_parts", "tf_size", "n_equipments")


@query("select tf_id, sender, origin, subspec, count(*) n_parts, sum(size)::bigint data_size, min(tf_id * 256) first_orbit, array_to_string(list(size order by seq), ',') parts from hbf group by all")
def stf_build(s, d):
    return build.sub_time_frames(v.hbf(s, d)).withColumn("parts", F.array_join(F.col("parts").cast("array<string>"), ","))


@query("select tf_id, sender, n_equip, n_parts, stf_size from stf")
def stf_equipments(s, d):
    return v.stf(s, d).select("tf_id", "sender", "n_equip", "n_parts", "stf_size")


@query("""
, q as (select sender, seq, subspec, size, sum(case when lag_ is distinct from subspec then 1 else 0 end) over (partition by sender order by seq) span from (select *, lag(subspec) over (partition by sender order by seq) lag_ from hbf))
select sender, span::bigint span, min(subspec) subspec, count(*) n_pages, min(seq) first_seq, sum(size)::bigint size from q group by sender, span""")
def spans(s, d):
    return build.spans(v.hbf(s, d))


@query("""
, q as (select *, (row_number() over (partition by subspec order by seq) - 1) // 128 w from hbf), g as (select subspec, w, count(*) n_pages, sum(size)::bigint size, min(seq) first_seq, max(seq) last_seq from q group by all)
select subspec, w as "window", n_pages, size, first_seq, last_seq, row_number() over (order by first_seq) topo_id from g""")
def topo_stf(s, d):
    return build.topology_frames(v.hbf(s, d))


@query(""", p as materialized (select subspec, seq, size, tf_id, row_number() over w - 1 r, lag(tf_id) over w <> tf_id turn from hbf window w as (partition by subspec order by seq)),
b as materialized (select subspec, list(r order by r) rs from p where turn group by subspec),
w as (with recursive x as (select subspec, 0::bigint k, 0::bigint s from (select distinct subspec from p) union all select x.subspec, k + 1, list_min(list_filter(rs, lambda t: t >= s + 16)) from x join b using (subspec) where list_max(rs) >= s + 16) select * from x),
m as (select p.*, w.k from p asof join w on p.subspec = w.subspec and p.r >= w.s)
select subspec, k "window", count(*) n_pages, sum(size)::bigint size, min(seq) first_seq, max(seq) last_seq from m group by subspec, k""")
def topo_stf_by_orbit(s, d):
    return build.topology_frames_by_orbit(v.hbf(s, d).withColumn("orbit", F.col("tf_id")), 16)


@query("select tf_id, equipment, count(distinct sender) n_senders, count(*) n_parts, sum(size)::bigint size from tf_part group by all having count(distinct sender) > 1")
def merge_conflicts(s, d):
    return build.conflicts(v.tf_part(s, d))


@query("""
, q as (select distinct tf_id, sender, equipment, line, size, subspec from tf_part)
select tf_id, sender, equipment, line, size, subspec, case when count(*) over w > 1 then row_number() over (partition by tf_id, equipment order by sender, line, subspec, size) - 1 else 0 end split_index, count(*) over w split_parts from q window w as (partition by tf_id, equipment)""")
def restamp_headers(s, d):
    x = v.tf_part(s, d).select("tf_id", "sender", "equipment", "line", "size", "subspec").distinct()
    return build.restamped(x, ("tf_id", "equipment"), ("sender", "line", "subspec", "size"))


@query("""
, q as (select *, case when seq % 5 = 0 then null else tf_id * 256 end first_orbit, 500 + sender // 4 run, case when seq % 3 = 0 then 'file' else 'readout' end source, case when seq % 4 = 0 then 0 else seq end created from stf_info)
select tf_id, min(first_orbit) first_orbit, max(run) run, arg_min(source, seq) source, coalesce(min(created) filter (created > 0), 0) created from q group by tf_id""")
def merged_header(s, d):
    q, x = F.col("seq"), v.stf_info(s, d)
    x = x.withColumns({"first_orbit": F.when(q % 5 == 0, None).otherwise(F.col("tf_id") * 256), "run": 500 + F.floor(F.col("sender") / 4), "source": F.when(q % 3 == 0, "file").otherwise("readout"), "created": F.when(q % 4 == 0, 0).otherwise(q)})
    return build.merged_header(x)


@query("""
, q as (select tf_id, sender, seq, size, case when seq % 3 = 0 then seq end header from hbf)
select tf_id, sender, seq, size, last_value(header ignore nulls) over w message, count(header) over w message_no from q window w as (partition by tf_id, sender order by seq rows unbounded preceding)""")
def split_payload(s, d):
    x = v.hbf(s, d).select("tf_id", "sender", "seq", "size", F.when(F.col("seq") % 3 == 0, F.col("seq")).alias("header"))
    return build.continued(x, ("tf_id", "sender"), "header", "seq").drop("header")


@query("""
, g as (select tf_id, equipment, count(*) block_cnt, sum(size + 96)::bigint size from tf_part group by all)
select tf_id, equipment, block_cnt, size, coalesce(sum(size) over (partition by tf_id order by equipment rows between unbounded preceding and 1 preceding), 0)::bigint as "offset" from g""")
def tf_index(s, d):
    return build.index(v.tf_part(s, d))


@query("select tf_id, count(distinct cru) n_cru, count(distinct link) n_link from hbf group by tf_id having count(distinct cru) > 1 or count(distinct link) > 1")
def channel_consistency(s, d):
    return build.consistency(v.hbf(s, d), ("tf_id",), ("cru", "link"))


@query("""
, e as (select tf_id, origin, subspec, count(*) n_parts, sum(size)::bigint size from hbf group by all), u as (select tf_id, '' origin, 0 subspec, 1 n_parts, 96 size from (select distinct tf_id from hbf) union all select * from e)
select tf_id, row_number() over (partition by tf_id order by origin, subspec) - 1 place, origin, subspec, n_parts, size from u""")
def channel_out(s, d):
    x = v.hbf(s, d).groupBy("tf_id", "origin", "subspec").agg(F.count(F.lit(1)).alias("n_parts"), F.sum("size").alias("size"))
    head = x.select("tf_id").distinct().select("tf_id", F.lit("").alias("origin"), F.lit(0).cast("bigint").alias("subspec"), F.lit(1).cast("bigint").alias("n_parts"), F.lit(96).cast("bigint").alias("size"))
    return head.unionByName(x).withColumn("place", F.row_number().over(Window.partitionBy("tf_id").orderBy("origin", "subspec")) - 1)


def _channel(s, d):
    """Each frame as a list of messages: its header, then its pages as single, full-split or reduced-split items."""
    x = v.hbf(s, d).withColumn("kind", F.col("trigger") % 3)
    parts = F.when(F.col("kind") == 0, 1).when(F.col("kind") == 1, 2 + F.col("size") % 4).otherwise(2 + F.col("size") % 7).cast("bigint")
    x = x.select("tf_id", "seq", "kind", parts.alias("parts"))
    x = x.unionByName(x.select("tf_id").distinct().selectExpr("tf_id", "-1L as seq", "-1L as kind", "1L as parts"))
    n = F.when(F.col("kind") == 1, 2 * F.col("parts")).otherwise(1 + F.col("parts"))
    x = x.withColumns({"n": n, "base": F.coalesce(F.sum(n).over(Window.partitionBy("tf_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    x = x.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("k"))
    first = F.when(F.col("kind") == 1, F.floor(F.col("k") / 2)).when(F.col("kind") == 2, F.col("parts")).otherwise(0)
    return x.select("tf_id", (F.col("base") + F.col("k")).alias("at"), first.cast("bigint").alias("split_index"), F.col("parts").alias("split_parts"), (F.col("kind") == -1).alias("stf_header"), "seq")


@query("""
, e as (select tf_id, seq, case trigger % 3 when 0 then 'single' when 1 then 'full_split' else 'reduced_split' end kind, case trigger % 3 when 0 then 1 when 1 then 2 + size % 4 else 2 + size % 7 end n_payloads from hbf
  union all select distinct tf_id, -1, 'stf_header', 1 from hbf),
x as (select *, case kind when 'full_split' then 2 * n_payloads else 1 + n_payloads end n from e)
select tf_id, row_number() over w - 1 place, coalesce(sum(n) over (partition by tf_id order by seq rows between unbounded preceding and 1 preceding), 0)::bigint "at", kind, n_payloads, null::varchar error from x window w as (partition by tf_id order by seq)""")
def channel_in(s, d):
    """Frames as lists of messages, decoded into their items again."""
    return build.decoded_channel(_channel(s, d))


@query("""
, h as (select tf_id, case when seq % 4 = 0 then 0 else tf_id * 256 + (seq % 501 = 7)::int end first_orbit, tf_id + (seq % 777 = 5)::int tf_counter, 500 + (seq % 333 = 2)::int run, case when seq % 2 = 0 then tf_id + (seq % 444 = 8)::int end start_time, size % 3 split_parts, (size // 3) % 4 split_index from hbf)
select tf_id, coalesce(count(distinct nullif(first_orbit, 0)) > 1, false) orbit, count(distinct tf_counter) > 1 counter, count(distinct run) > 1 run, count(distinct start_time) > 1 "start", bool_or(split_parts = 0 or split_parts > 1 and split_index not in (0, split_parts)) split from h group by tf_id""")
def channel_inspection(s, d):
    q = F.col("seq")
    on = lambda k, n: (q % k == n).cast("int")
    x = v.hbf(s, d).select("tf_id", F.when(q % 4 == 0, 0).otherwise(F.col("tf_id") * 256 + on(501, 7)).alias("first_orbit"), (F.col("tf_id") + on(777, 5)).alias("tf_counter"), (500 + on(333, 2)).alias("run"), F.when(q % 2 == 0, F.col("tf_id") + on(444, 8)).alias("start_time"), (F.col("size") % 3).alias("split_parts"), (F.floor(F.col("size") / 3) % 4).alias("split_index"))
    return build.inspected(x)


# filters

SANE = """, o as (select *, first_value(orbit) over (partition by tf_id, sender order by seq) first_orbit from blocks),
s as (select *, length >= 64 and orbit >= first_orbit and case when stop1 then mem1 <= length else off1 > 0 and off1 < length and mem1 < length and two and length - off1 >= 64 and sub2 = subspec and stop2 and mem2 <= length - off1 end sane from o)"""


@query(SANE + " select seq, first_orbit, sane from s")
def rdh_sanity_flags(s, d):
    return filters.check_headers("print")(v.blocks(s, d)).select("seq", "first_orbit", "sane")


@query(SANE + " select tf_id, sender, count(*) n, sum(length)::bigint size from s where sane group by all")
def rdh_sanity_drop(s, d):
    return filters.check_headers("drop")(v.blocks(s, d)).groupBy("tf_id", "sender").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("size"))


@query("""
, e as (select *, row_number() over (partition by tf_id, sender, subspec order by seq) = 1 first_, length in (64, 128, 16384) and (stop1 and length = 64 and mem1 = 64 or not stop1 and off1 >= 64 and off1 <= length and two and stop2 and mem1 = 64 and mem2 = 64 and sub2 = subspec) empty_ from blocks)
select tf_id, sender, count(*) n, sum(length)::bigint size, min(seq) first_seq from e where first_ or not empty_ group by all""")
def stf_filtered(s, d):
    return filters.drop_empty_triggers(v.blocks(s, d)).groupBy("tf_id", "sender").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("size"), F.min("seq").alias("first_seq"))


@query("select (subspec & 255) fee, count(distinct subspec) n_sources, count(*) n, sum(size)::bigint size from hbf group by all")
def fee_mask_group(s, d):
    return v.hbf(s, d).groupBy(scalar.mask_fee(F.col("subspec"), 0xFF).alias("fee")).agg(F.countDistinct("subspec").alias("n_sources"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))


@query(", q as (select aseq, tf_id, sender, max(tf_id) over (order by aseq) m from stf_shuffled) select aseq, tf_id, sender from q where tf_id >= m")
def id_monotone(s, d):
    return filters.monotone(v.stf_shuffled(s, d), "tf_id", "aseq").select("aseq", "tf_id", "sender")


@query(", q as (select aseq, tf_id, sender, max(tf_id) over (partition by sender order by aseq rows between unbounded preceding and 1 preceding) m from stf_shuffled) select aseq, tf_id, sender from q where m is null or tf_id > m")
def sequencer(s, d):
    return filters.newer(v.stf_shuffled(s, d), "tf_id", "aseq", ("sender",)).select("aseq", "tf_id", "sender")


RUNS = ", r as (select o_orderkey seq, year(o_orderdate) run from orders), q as (select *, max(run) over (order by seq rows between unbounded preceding and 1 preceding) m from r)"


@query(RUNS + " select run, count(*) n, sum((m is not null and run > m)::int)::bigint resets from q where m is null or run >= m group by run")
def run_reset(s, d):
    x = v.table(s, d, "orders").groupBy(F.col("o_orderkey").alias("seq")).agg(F.min(F.year("o_orderdate")).alias("run"))
    return filters.current_run(x).groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("reset").cast("int")).alias("resets"))


@query("select tf_id, count(*) n, sum(stf_size)::bigint size from stf_info where (tf_id * 7919 + 104729) % 10007 < 60 * 10007 / 100.0 group by tf_id")
def throttle(s, d):
    return filters.throttled(v.stf_info(s, d), 60).groupBy("tf_id").agg(F.count(F.lit(1)).alias("n"), F.sum("stf_size").alias("size"))


@query("select seq, tf_id, sender from stf_info where (seq * 7919 + 104729) % 10007 < 25 * 10007 / 100.0")
def sink_sample(s, d):
    return v.stf_info(s, d).where(scalar.chance(F.col("seq"), 25)).select("seq", "tf_id", "sender")


@query(", f as (select distinct tf_id from stf_info where buffer_used * 100 > buffer_size * 97) select tf_id, count(*) n, sum(stf_size)::bigint size from stf_info where tf_id in (select tf_id from f) group by tf_id")
def buffer_full(s, d):
    info = v.stf_info(s, d)
    return info.join(filters.full_buffers(info), "tf_id", "left_semi").groupBy("tf_id").agg(F.count(F.lit(1)).alias("n"), F.sum("stf_size").alias("size"))


@query(", t as (select tf_id, sum(case when stf_size % 3 = 0 then 0 else stf_size end)::bigint size from stf_info group by tf_id) select tf_id, case when size = 0 then 'empty' else 'build' end outcome, size from t")
def zero_size(s, d):
    x = v.stf_info(s, d).groupBy("tf_id").agg(F.sum(F.when(F.col("stf_size") % 3 == 0, 0).otherwise(F.col("stf_size"))).alias("size"))
    return x.select("tf_id", F.when(F.col("size") == 0, "empty").otherwise("build").alias("outcome"), "size")


@query(", q as (select *, row_number() over (partition by sender order by seq desc) n from stf_info) select sender, tf_id, seq from q where n <= 10")
def drop_oldest(s, d):
    return filters.newest(v.stf_info(s, d), 10, ("sender",), "seq").select("sender", "tf_id", "seq")


@query(" select seq, tf_id, sender from stf_info order by seq limit 100")
def build_limit(s, d):
    return v.stf_info(s, d).select("seq", "tf_id", "sender").orderBy("seq").limit(100)


@query(", m as (select seq, tf_id, 2 + (seq % 11 = 0)::int as version, 48 + (seq % 13 = 0)::int header_size, size % 3 n_pages, seq % 7 = 0 last_tf from hbf) select seq, tf_id from m where version = 2 and header_size = 48 and (n_pages > 0 or last_tf)")
def well_formed(s, d):
    q = F.col("seq")
    x = v.hbf(s, d).withColumns({"version": 2 + (q % 11 == 0).cast("int"), "header_size": 48 + (q % 13 == 0).cast("int"), "pages": F.array_repeat(F.lit(0), (F.col("size") % 3).cast("int")), "last_tf": q % 7 == 0})
    return filters.well_formed(x).select("seq", "tf_id")


@query(", x as (select tf_id, sender, n_equip, seq from stf_info) select seq, tf_id, sender from x where n_equip = 1")
def single_equipment(s, d):
    return v.stf_info(s, d).where("n_equip = 1").select("seq", "tf_id", "sender")


@query(", o as (select *, (['CPV', 'TPC', 'XYZ', 'ITS', 'NIL'])[seq % 5 + 1] origin from stf_info), a as (select * from o where n_equip = 1 and origin in ('CPV', 'TPC', 'ITS')) select sender, tf_id // 3 as tf_id, arg_min(seq, seq) seq, arg_min(origin, seq) origin from a group by sender, tf_id // 3")
def announceable(s, d):
    """Topological sub time frames, of which three share an id here, that may be announced."""
    x = v.stf_info(s, d).withColumn("origin", F.element_at(F.array(*map(F.lit, ("CPV", "TPC", "XYZ", "ITS", "NIL"))), (F.col("seq") % 5 + 1).cast("int"))).withColumn("tf_id", F.floor(F.col("tf_id") / 3))
    return filters.announceable(x, topological=True).select("sender", "tf_id", "seq", "origin")


@query(", m as (select tf_id, sender, list(case when seq % 3 = 0 then 0 else size end) l from hbf group by all) select tf_id, sender, len(l) n from m where list_max(l) > 0")
def with_payload(s, d):
    x = v.hbf(s, d).groupBy("tf_id", "sender").agg(F.collect_list(F.when(F.col("seq") % 3 == 0, 0).otherwise(F.col("size"))).alias("parts"))
    return filters.with_payload(x).select("tf_id", "sender", F.size("parts").cast("bigint").alias("n"))


@query(", x as (select sender, seq, n_equip, lag(n_equip) over w before, row_number() over w = 1 first_ from stf_info window w as (partition by sender order by seq)) select sender, seq, n_equip, first_ or before is distinct from n_equip changed from x")
def changed_values(s, d):
    return metrics.changes(v.stf_info(s, d).select("sender", "seq", "n_equip"), ("sender",), "seq", "n_equip")


@query(f" select tf_id % {N} + 1 peer, tf_id, false as \"end\" from (select distinct tf_id from stf_info) union all select p + 1, null, true from range({N} + 1) r(p)")
def end_of_stream(s, d):
    x = v.stf_info(s, d).select("tf_id").distinct().select((F.col("tf_id") % N + 1).alias("peer"), "tf_id")
    return build.with_end_of_stream(x, s.range(1, N + 2).withColumnRenamed("id", "peer"))


@query(", w as (select s_suppkey worker, abs(s_acctbal)::bigint * 100 free from supplier), t as (select tf_id, sum(stf_size)::bigint tf_size from stf_info group by tf_id) select worker, count(tf_id) n_fit from w left join t on t.tf_size <= w.free group by worker")
def worker_admission(s, d):
    """How many frames fit each worker: frames counted in the order of sizes, up to each worker's free memory."""
    w = v.table(s, d, "supplier").select(F.col("s_suppkey").cast("bigint").alias("worker"), (F.bround(F.abs("s_acctbal")).cast("bigint") * 200 + 1).alias("o"), F.lit(None).cast("bigint").alias("tf_id"))
    t = complete.status(v.stf_info(s, d), N).select(F.lit(None).cast("bigint").alias("worker"), (F.col("tf_size") * 2).cast("bigint").alias("o"), F.col("tf_id").cast("bigint").alias("tf_id"))
    return ordered.running(w.unionByName(t), "n_fit", "count", F.col("tf_id"), "o").where("worker is not null").select("worker", "n_fit")


@query(", x as (select tf_id, sender, seq, case when seq % 17 = 0 then '-1' else (seq % 5)::varchar end worker from stf_info) select tf_id, sender from x where worker <> '-1'")
def drop_requests(s, d):
    x = v.stf_info(s, d).withColumn("worker", F.when(F.col("seq") % 17 == 0, "-1").otherwise((F.col("seq") % 5).cast("string")))
    return x.join(x.where("worker = '-1'").select("tf_id", "sender"), ["tf_id", "sender"], "left_anti").select("tf_id", "sender")


# completeness


@query(f", t as (select tf_id, count(*) n_senders, sum(stf_size)::bigint tf_size, array_to_string(list(sender || '=' || stf_size order by sender), ',') sizes from stf_info group by tf_id) select *, n_senders = {N} complete from t")
def tf_complete(s, d):
    x = complete.status(v.stf_info(s, d), N)
    return x.withColumn("sizes", F.array_join(F.transform(F.map_entries("sizes"), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"].cast("string"))), ","))


@query(f" select tf_id, sum(stf_size)::bigint tf_size, case when count(*) = {N} then 'build' else 'discard' end decision from stf_info group by tf_id")
def tf_incomplete_policy(s, d):
    return complete.status(v.stf_info(s, d), N).select("tf_id", "tf_size", F.when(F.col("complete"), "build").otherwise("discard").alias("decision"))


MISSING = f", m as (select tf_id, sender from (select distinct tf_id from stf_info), range({N}) r(sender) except select tf_id, sender from stf_info)"


@query(MISSING + " select * from m")
def missing_senders(s, d):
    return complete.missing(v.stf_info(s, d), N)


@query(MISSING + " select sender, count(*) n from m group by sender")
def missing_per_sender(s, d):
    return complete.missing(v.stf_info(s, d), N).groupBy("sender").agg(F.count(F.lit(1)).alias("n"))


@query(", i as (select distinct tf_id from stf_info) select tf_id, lag(tf_id) over (order by tf_id) previous, tf_id - coalesce(lag(tf_id) over (order by tf_id), 0) - 1 missing from i")
def missing_ids(s, d):
    return complete.gaps(v.stf_info(s, d).select("tf_id").distinct())


def _emission(info: str, seq: str) -> str:
    return f""", f as (select tf_id, sender, min({seq}) seq from {info} group by all), ids as (select tf_id, count(*) n_senders from f group by tf_id),
g as (select ids.tf_id, r.sender, f.seq from ids cross join range({N}) r(sender) left join f on f.tf_id = ids.tf_id and f.sender = r.sender),
q as (select tf_id, min(seq) over (partition by sender order by tf_id desc) q from g), e as (select tf_id, case when count(q) = {N} then max(q) end emit_seq from q group by tf_id)"""


@query(_emission("stf_info", "seq") + f" select tf_id, n_senders, emit_seq, n_senders = {N} complete from ids join e using (tf_id)")
def tf_emission(s, d):
    return complete.emission(v.stf_info(s, d), N)


@query(_emission("stf_shuffled", "aseq") + " select x.tf_id, x.sender, x.aseq, e.emit_seq from stf_shuffled x join e using (tf_id) where x.aseq > e.emit_seq")
def late_stf(s, d):
    return complete.late(v.stf_shuffled(s, d), N, "aseq").select("tf_id", "sender", "aseq", "emit_seq")


@query(f", t as (select tf_id, count(distinct sender) n_senders, min(ts) first_ts from hbf group by tf_id) select tf_id, n_senders from t where n_senders < {N} and first_ts < (select max(ts) from hbf) - interval 5 day")
def stale_tf(s, d):
    return complete.stale(v.hbf(s, d), N, "interval 5 days").select("tf_id", "n_senders")


@query(", h as (select sender, tf_id, seq from stf_info where seq % 5 >= 3), y as (select sender, min(tf_id) young from h, (select max(seq) now from h) where now - seq <= 400 group by sender) select h.sender, h.tf_id from h left join y using (sender) where young is null or tf_id < young")
def stale_in_senders(s, d):
    """Sub time frames that nobody asked for, at the end of the input."""
    return complete.stale_in_senders(v.stf_info(s, d).where("seq % 5 >= 3").select("sender", "tf_id", "seq"), 400)


@query(", b as (select sender, arg_max(buffer_used, seq) / arg_max(buffer_size, seq) used from stf_info group by sender) select round(avg(used), 9) mean_used, max(used) max_used, arg_max(sender, used) fullest from b")
def buffer_util(s, d):
    return metrics.buffers(v.stf_info(s, d)).withColumn("mean_used", F.round("mean_used", 9))


@query(f"""
, u as (select sender, arg_max(buffer_used, seq) / arg_max(buffer_size, seq) used from stf_info group by sender), f as (select arg_max(sender, struct_pack(a := used, b := -sender)) sender from u having max(used) > 0.4),
t as (select tf_id, count(*) = {N} complete, min(seq) began from stf_info group by tf_id), c as (select max(tf_id) done from t where complete), y as (select min(tf_id) young from t, (select max(seq) now from stf_info) n where not complete and now - began < 50),
o as (select t.tf_id from t, c, y where not complete and tf_id <= done and (young is null or tf_id < young)),
x as (select i.tf_id, i.sender, i.stf_size, sum(stf_size) over (order by i.tf_id)::bigint total from stf_info i join f using (sender) join o on o.tf_id = i.tf_id)
select tf_id, sender, stf_size, total from x where total - stf_size <= 200000""")
def high_watermark(s, d):
    info = v.stf_info(s, d)
    return complete.over_watermark(info, complete.status(info, N).select("tf_id", "complete"), 40, 200_000, 50)


@query(", x as (select tf_id, sender, max(tf_id) over (partition by sender order by seq) sender_max, max(tf_id) over (order by seq) global_max, seq from stf_info) select * from x")
def running_ids(s, d):
    x = ordered.running(v.stf_info(s, d).select("seq", "tf_id", "sender"), "sender_max", "max", F.col("tf_id"), "seq", ["sender"])
    return ordered.running(x, "global_max", "max", F.col("tf_id"), "seq")


# sets and joins

EQ = ", e as (select distinct sender, subspec from hbf)"


@query(EQ + " select subspec, count(*) n_senders from e group by subspec")
def equipment_union(s, d):
    """Equipments of all senders together, and how many have each."""
    return v.hbf(s, d).select("sender", "subspec").distinct().groupBy("subspec").agg(F.count(F.lit(1)).alias("n_senders"))


@query(EQ + f" select r.sender, u.subspec from (select distinct subspec from e) u, range({N}) r(sender) except select sender, subspec from e")
def equipment_missing(s, d):
    """Equipments of the union that a sender doesn't have; the senders are a fixed list."""
    e = v.hbf(s, d).select("sender", "subspec").distinct()
    every = e.select("subspec").distinct().select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(N - 1).cast("bigint"))).alias("sender"), "subspec")
    return every.exceptAll(e)


@query(", x as (select tf_id, array_agg(distinct sender) l from stf_info group by tf_id) select tf_id, len(list_intersect(l, [0, 2, 4, 6])) n_allowed, coalesce(list_min(list_intersect(l, [0, 2, 4, 6])), -1) first_allowed from x")
def equipment_common(s, d):
    both = F.array_intersect(F.collect_set("sender"), F.array(*[F.lit(i).cast("bigint") for i in (0, 2, 4, 6)]))
    return v.stf_info(s, d).groupBy("tf_id").agg(F.size(both).cast("bigint").alias("n_allowed"), F.coalesce(F.array_min(both), F.lit(-1)).alias("first_allowed"))


@query(", q as (select tf_id, sender, min(seq) requested from stf_info group by all), r as (select tf_id, sender, max(aseq) + 3 received from stf_shuffled group by all) select tf_id, sender, requested, received, received - requested latency from q join r using (tf_id, sender)")
def fetch_latency(s, d):
    a = v.stf_info(s, d).groupBy("tf_id", "sender").agg(F.min("seq").alias("requested"))
    b = v.stf_shuffled(s, d).groupBy("tf_id", "sender").agg((F.max("aseq") + 3).alias("received"))
    return metrics.latency(a, b)


@query(" select tf_id, max(ts) - min(ts) >= interval 30 minute long_, date_diff('second', min(ts), max(ts)) span_s from hbf group by tf_id")
def receive_span(s, d):
    x = v.hbf(s, d).groupBy("tf_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    seconds = F.expr("unix_timestamp(date_trunc('second', b)) - unix_timestamp(date_trunc('second', a))")
    return x.select("tf_id", F.expr("b - a >= interval 30 minutes").alias("long_"), seconds.alias("span_s"))


@query(", x as (select distinct tf_id, sender from stf_info), w as (select sender, tf_id, row_number() over (partition by sender order by tf_id) topo_id from x) select x.sender, x.tf_id, w.topo_id from x join w using (sender, tf_id)")
def topo_renumber(s, d):
    x = v.stf_info(s, d).select("sender", "tf_id").distinct()
    return x.join(ordered.ranked(x, "topo_id", "tf_id", keys=["sender"]).withColumn("topo_id", F.col("topo_id") + 1), ["sender", "tf_id"])


@query(", a as (select tf_id, sender, min(seq) seq from stf_info group by all) select tf_id, sender, case when seq % 3 = 0 then 'acknowledged' when sender = 5 then 'disconnected' else 'in_flight' end outcome from a")
def in_flight(s, d):
    x = v.stf_info(s, d).groupBy("tf_id", "sender").agg(F.min("seq").alias("seq"))
    ack = x.where("seq % 3 = 0").select("tf_id", "sender", F.lit(True).alias("ack"))
    gone = x.where("sender = 5").select("sender").distinct().withColumn("gone", F.lit(True))
    return x.join(ack, ["tf_id", "sender"], "left").join(gone, "sender", "left").select("tf_id", "sender", F.when(F.col("ack"), "acknowledged").when(F.col("gone"), "disconnected").otherwise("in_flight").alias("outcome"))


@query(", r as (select tf_id, sender, seq % 4 worker, seq from stf_info union all select tf_id, sender, seq % 4, seq + 1000000 from stf_info where seq % 9 = 0) select tf_id, sender, worker, count(*) requests, min(seq) answered from r group by all")
def request_retries(s, d):
    x = v.stf_info(s, d).select("tf_id", "sender", (F.col("seq") % 4).alias("worker"), "seq")
    again = x.where("seq % 9 = 0").withColumn("seq", F.col("seq") + 1_000_000)
    return x.unionByName(again).groupBy("tf_id", "sender", "worker").agg(F.count(F.lit(1)).alias("requests"), F.min("seq").alias("answered"))


@query(", x as (select sender, row_number() over (order by sender) - 1 n from (select distinct sender from stf_info)) select sender, n, 'socket' || n socket from x")
def zip_sockets(s, d):
    x = ordered.ranked(v.stf_info(s, d).select("sender").distinct(), "n", "sender")
    sockets = s.range(N).select(F.col("id").alias("n"), F.concat(F.lit("socket"), F.col("id").cast("string")).alias("socket"))
    return x.join(sockets, "n").select("sender", "n", "socket")


@query(" select p.seq, p.sender, i.buffer_used from stf_info p asof left join stf_info i on i.sender = (p.sender + 1) % 8 and p.seq >= i.seq")
def as_of_status(s, d):
    """At every announcement, what was last announced by the next sender."""
    info = v.stf_info(s, d)
    ask = info.select("seq", "sender", ((F.col("sender") + 1) % N).alias("of"), F.lit(1).alias("asks"), F.lit(None).cast("bigint").alias("used"))
    know = info.select("seq", "sender", F.col("sender").alias("of"), F.lit(0).alias("asks"), F.col("buffer_used").alias("used"))
    x = ordered.running(ask.unionByName(know).withColumn("o", F.col("seq") * 2 + F.col("asks")), "n", "count", F.col("used"), "o", ["of"])
    x = x.withColumn("buffer_used", F.max("used").over(Window.partitionBy("of", "n")))
    return x.where("asks = 1").select("seq", "sender", "buffer_used")


@query(" select tf_id, sender, row_number() over (partition by tf_id order by stf_size, sender) - 1 place from stf_info")
def requests_by_size(s, d):
    return schedule.by_size(v.stf_info(s, d)).select("tf_id", "sender", "place")


@query(" select tf_id, arg_max(sender, struct_pack(a := stf_size, b := sender)) largest, arg_min(sender, struct_pack(a := stf_size, b := sender)) smallest from stf_info group by tf_id")
def extreme_senders(s, d):
    k = F.struct("stf_size", "sender")
    return v.stf_info(s, d).groupBy("tf_id").agg(F.max_by("sender", k).alias("largest"), F.min_by("sender", k).alias("smallest"))


# scalars


@query(" select seq, subspec, cru, link, ep, (subspec >> 16) cru_back from hbf")
def subspec_decode(s, d):
    x = v.hbf(s, d).select("seq", "subspec")
    p = scalar.subspec_parts(F.col("subspec"))
    return x.select("seq", "subspec", p["cru"].alias("cru"), p["link"].alias("link"), p["ep"].cast("bigint").alias("ep"), p["cru"].alias("cru_back"))


@query(" select seq, (mem1 + case when two then mem2 else 0 end)::bigint size, case when two then stop2 else stop1 end and mem1 + case when two then mem2 else 0 end <= length stop from blocks")
def block_memory(s, d):
    return v.blocks(s, d).select("seq", headers.memory_of(F.col("rdhs"), F.col("length")).alias("m")).select("seq", "m.size", "m.stop")


@query(" select seq, cru, link, ep, tf_id * 256 + seq % 256 orbit, size % 4096 bc, trigger % 2 = 0 stop, 6 as version, size % 65536 memory_size, subspec & 65535 fee_id, trigger trigger_type, seq % 300 page_counter from hbf")
def rdh_fields(s, d):
    q = F.col("seq")
    block = headers.header({"version": F.lit(6), "header_size": F.lit(64), "fee_id": F.col("subspec").bitwiseAND(F.lit(65535)), "system_id": F.lit(3), "offset_to_next": F.lit(64), "memory_size": F.col("size") % 65536, "link_id": F.col("link"), "cru_id": F.col("cru"), "endpoint_id": F.col("ep"), "bc": F.col("size") % 4096, "orbit": F.col("tf_id") * 256 + q % 256, "trigger_type": F.col("trigger"), "page_counter": q % 300, "stop_bit": (F.col("trigger") % 2 == 0).cast("int")})
    x = v.hbf(s, d).select("seq", block.alias("b"))
    f = lambda n: headers.field(F.col("b"), n)
    return x.select("seq", f("cru_id").alias("cru"), f("link_id").alias("link"), f("endpoint_id").alias("ep"), f("orbit").alias("orbit"), f("bc").alias("bc"), (f("stop_bit") == 1).alias("stop"), f("version").alias("version"), f("memory_size").alias("memory_size"), f("fee_id").alias("fee_id"), f("trigger_type").alias("trigger_type"), f("page_counter").alias("page_counter"))


@query(" select seq, case when seq % 6 < 5 then 3 + seq % 6 end as version, case when seq % 6 < 5 then tf_id * 256 end orbit, case when seq % 6 < 5 then size % 4096 end bc, case when seq % 6 < 5 then subspec & 65535 end fee_id from hbf")
def rdh_versions(s, d):
    """Headers of versions 3 to 7, each read by its own layout, and of one that isn't known."""
    k = F.col("seq") % 6
    given = {"version": (3 + k), "orbit": F.col("tf_id") * 256, "bc": F.col("size") % 4096, "fee_id": F.col("subspec").bitwiseAND(F.lit(65535))}
    block = F.when(k < 2, headers.header(given, 4)).otherwise(headers.header(given, 7))
    x = v.hbf(s, d).select("seq", block.alias("b"))
    return x.select("seq", *[headers.any_field(F.col("b"), n).alias(n) for n in given])


@query(" select seq, 2::bigint n_headers, (64 + 64 + size % 1000)::bigint memory, trigger % 2 = 0 stop from hbf")
def rdh_chain(s, d):
    head = lambda mem, stop, page: headers.header({"version": F.lit(6), "offset_to_next": F.lit(64), "memory_size": mem, "orbit": F.col("tf_id"), "page_counter": F.lit(page), "stop_bit": stop})
    block = F.concat(head(F.lit(64), F.lit(0), 0), head(64 + F.col("size") % 1000, (F.col("trigger") % 2 == 0).cast("int"), 1))
    x = headers.with_chain(v.hbf(s, d).select("seq", block.alias("block")))
    m = headers.memory_of(F.col("chain"), F.lit(1 << 20))
    return x.select("seq", F.size("chain").cast("bigint").alias("n_headers"), m["size"].alias("memory"), m["stop"].alias("stop"))


@query(" select seq, seq % 300 = 0 starts from hbf")
def orbit_starts(s, d):
    block = headers.header({"page_counter": F.col("seq") % 300})
    return v.hbf(s, d).select("seq", block.alias("b")).select("seq", (headers.field(F.col("b"), "page_counter") == 0).alias("starts"))


@query(" select seq, case when seq % 7 in (3, 4) then 'ANY' when sender % 2 = 0 and seq % 7 = 6 then 'TPC' when sender % 2 = 1 and seq % 7 = 6 then 'ITS' else 'TST' end origin from hbf")
def data_origin(s, d):
    v6 = F.when(F.col("seq") % 7 == 6, 6).otherwise(4)
    option = F.when((F.col("seq") % 7).isin(3, 4), "nonsense").otherwise(F.lit(" tst "))
    o = F.coalesce(F.when(v6 == 6, headers.origin(v6, 3 + F.col("sender") % 2, {3: "TPC", 4: "ITS"}, "TST")), scalar.origin_of_option(option))
    return v.hbf(s, d).select("seq", o.alias("origin"))


@query(" select tf_id, origin || '/RAWDATA/' || subspec::varchar equipment, count(*) n from hbf group by all")
def equipment_keys(s, d):
    e = scalar.equipment(F.col("origin"), F.lit("RAWDATA"), F.col("subspec"))
    return v.hbf(s, d).groupBy("tf_id", e.alias("e")).agg(F.count(F.lit(1)).alias("n")).select("tf_id", scalar.equipment_text(F.col("e")).alias("equipment"), "n")


@query(" select o_orderkey, round(o_totalprice)::bigint size, (round(o_totalprice)::bigint + 15) // 16 * 16 a16, (round(o_totalprice)::bigint + 4095) // 4096 * 4096 a4k, round(o_totalprice)::bigint * 120 // 100 estimate, 96 + 24 + 96 + 48 * (o_custkey % 5) + round(o_totalprice)::bigint + 96 * (o_custkey % 7) in_file from orders")
def size_in_file(s, d):
    n = F.round("o_totalprice").cast("bigint")
    return v.table(s, d, "orders").select("o_orderkey", n.alias("size"), scalar.align_up(n, 16).alias("a16"), scalar.align_up(n, 4096).alias("a4k"), scalar.estimated_size(n).alias("estimate"), scalar.size_in_file(n, F.col("o_custkey") % 5, F.col("o_custkey") % 7).alias("in_file"))


@query(" select tf_id, sum((size + 15) // 16 * 16)::bigint room from hbf group by tf_id")
def payload_room(s, d):
    return v.hbf(s, d).groupBy("tf_id").agg(F.sum(scalar.align_up(F.col("size"), 16)).alias("room"))


@query(""", n as (select o_orderkey, case o_orderkey % 4 when 0 then 'dir' || lpad(o_orderkey::varchar, 8, '0') when 1 then o_orderkey || '.data' when 2 then 'run-' || o_custkey || '-x' else 'plain' end name from orders)
select o_orderkey, case o_orderkey % 4 when 3 then '0' else regexp_extract(name, '^(.*?)[0-9]+[^0-9]*$', 1) || lpad((regexp_extract(name, '([0-9]+)[^0-9]*$', 1)::bigint + 1)::varchar, greatest(len(regexp_extract(name, '([0-9]+)[^0-9]*$', 1)), len((regexp_extract(name, '([0-9]+)[^0-9]*$', 1)::bigint + 1)::varchar))::int, '0') || regexp_extract(name, '([^0-9]*)$', 1) end next_name from n""")
def seq_name(s, d):
    k = F.col("o_orderkey")
    name = F.when(k % 4 == 0, F.concat(F.lit("dir"), F.lpad(k.cast("string"), 8, "0"))).when(k % 4 == 1, F.concat(k.cast("string"), F.lit(".data"))).when(k % 4 == 2, F.concat(F.lit("run-"), F.col("o_custkey").cast("string"), F.lit("-x"))).otherwise("plain")
    return v.table(s, d, "orders").select("o_orderkey", name.alias("name")).select("o_orderkey", scalar.next_in_sequence(F.col("name")).alias("next_name"))


@query(" select seq, 'run' || (500 + sender) || '_tf' || lpad(tf_id::varchar, 8, '0') || '_' || strftime(ts, '%Y%m%d_%H%M%S') || '_host.tf' file_name, upper(strftime(ts, '%b')) period from hbf")
def file_names(s, d):
    ts = F.col("ts").cast("timestamp")
    return v.hbf(s, d).select("seq", scalar.file_name("run%r_tf%i_%D_%T_%h.tf", F.lit("x"), 500 + F.col("sender"), F.col("tf_id"), ts).alias("file_name"), scalar.period_of(ts).alias("period"))


@query(""", p as (select event_id seq, case event_id % 5 when 0 then 'true' when 1 then 'FALSE' when 2 then '1' when 3 then 'yes' end b, case event_id % 4 when 0 then '-5' when 1 then event_id::varchar when 2 then 'x' end u, case event_id % 3 when 0 then ' 000' || event_id || ' ' when 1 then 'run' else event_id::varchar end r from events)
select seq, coalesce(b in ('true', 'TRUE', 'True', '1'), true) flag, case when seq % 4 = 1 then seq else 128 end number, case when seq % 3 = 1 then -1 else seq end run from p""")
def tunables(s, d):
    i = F.col("event_id")
    b = F.when(i % 5 == 0, "true").when(i % 5 == 1, "FALSE").when(i % 5 == 2, "1").when(i % 5 == 3, "yes")
    u = F.when(i % 4 == 0, "-5").when(i % 4 == 1, i.cast("string")).when(i % 4 == 2, "x")
    r = F.when(i % 3 == 0, F.concat(F.lit(" 000"), i.cast("string"), F.lit(" "))).when(i % 3 == 1, "run").otherwise(i.cast("string"))
    return v.table(s, d, "events").select(i.alias("seq"), scalar.bool_param(b, True).alias("flag"), scalar.uint_param(u, 128).alias("number"), scalar.run_number(r).alias("run"))


@query(" select event_id seq, case when event_id % 10 in (3, 7) then null else case when event_id % 10 > 7 then 'src' || event_id % 10 else 'src' || event_id % 10 || ',srcz' end end ids from events")
def id_list(s, d):
    i = F.col("event_id") % 10
    one = F.concat(F.lit("src"), i.cast("string"))
    text = F.when(i == 3, " ;, ").when(i == 7, F.concat(one, F.lit(";"), one)).when(i > 7, F.concat(F.lit(" "), one, F.lit(";"))).otherwise(F.concat(F.lit("srcz;\n"), one))
    return v.table(s, d, "events").select(F.col("event_id").alias("seq"), F.array_join(scalar.id_list(text), ",").alias("ids"))


@query(" select event_id seq, json_extract_string(props, '$.k') k, len(json_keys(props)) n from events")
def json_params(s, d):
    m = scalar.json_map(F.col("props"))
    return v.table(s, d, "events").select(F.col("event_id").alias("seq"), m["k"].alias("k"), F.size(m).cast("bigint").alias("n"))


@query(" select seq, (epoch_us(ts) + 499999) // 500000 * 500000 rounded, abs(trigger - 50) > 25 drifts, trigger * 10 delay_ms, trigger * 10 > 500 slow from hbf")
def clocks(s, d):
    micros = F.expr("unix_micros(cast(ts as timestamp))")
    t = F.col("trigger")
    return v.hbf(s, d).select("seq", scalar.round_up(micros, 500_000).alias("rounded"), (F.abs(t - 50) > 25).alias("drifts"), (t * 10).alias("delay_ms"), (t * 10 > 500).alias("slow"))


@query(" select tf_id, count(distinct sender + 1) popcnt, min(sender + 1) first_set, 220 - count(distinct sender + 1) clear, bool_or(sender = 4) has_five, len(list_intersect(array_agg(distinct sender + 1), [2, 3, 8])) common from hbf group by tf_id")
def bit_fields(s, d):
    x = v.hbf(s, d).groupBy("tf_id").agg(scalar.bits_of(F.collect_set((F.col("sender") + 1).cast("int"))).alias("b"))
    return x.select("tf_id", F.size("b").cast("bigint").alias("popcnt"), scalar.first_bit(F.col("b")).alias("first_set"), F.size(scalar.bits_not(F.col("b"), 220)).cast("bigint").alias("clear"), F.array_contains("b", 5).alias("has_five"), F.size(F.array_intersect("b", F.array(*map(F.lit, (2, 3, 8))))).cast("bigint").alias("common"))


@query(" select event_id seq, case event_id % 4 when 0 then 'physics' when 1 then 'topology' end run_type, case event_id % 5 when 0 then 3 when 1 then 4 when 2 then 5 when 3 then 6 end rdh_version from events")
def parse_modes(s, d):
    i = F.col("event_id")
    mode = F.when(i % 4 == 0, "Physics").when(i % 4 == 1, "topology").otherwise("other")
    token = (i % 5 + 3).cast("string")
    return v.table(s, d, "events").select(i.alias("seq"), F.when(F.lower(mode).isin("physics", "topology"), F.lower(mode)).alias("run_type"), F.when(token.isin("3", "4", "5", "6"), token.cast("int")).alias("rdh_version"))


# transfers and files


@query(""", x as (select *, lag(region) over w <> region or addr - lag(addr + len) over w > 8192 far from txg_part where len > 0 and addr > 0 window w as (partition by tf_id, sender order by addr)),
y as (select *, sum(coalesce(far, false)::int) over (partition by tf_id, sender order by addr) txg from x)
select tf_id, sender, txg::bigint txg, min(region)::bigint region, min(addr) as "start", count(*) data_parts, sum(len)::bigint data, (max(addr + len) - min(addr))::bigint len, (max(addr + len) - min(addr) - sum(len))::bigint gap from y group by tf_id, sender, txg""")
def txg_coalesce(s, d):
    return transfer.groups(v.txg_part(s, d))


@query(""", x as (select *, lag(region) over w <> region or addr - lag(addr + len) over w > 8192 far from txg_part where len > 0 and addr > 0 window w as (partition by tf_id, sender order by addr)),
y as (select *, sum(coalesce(far, false)::int) over (partition by tf_id, sender order by addr) txg from x)
select tf_id, sender, subspec, equipment, addr - min(addr) over (partition by tf_id, sender, txg) as "offset" from y""")
def txg_locate(s, d):
    return transfer.located(v.txg_part(s, d)).select("tf_id", "sender", "subspec", "equipment", "offset")


@query(""", r as (select i region, i * 150000 as "start", 200000 + i % 3 * 100000 size from range(40) t(i))
select tf_id, sender, addr, len, arg_max(r.region, struct_pack(a := r.size, b := r.region)) region from (select distinct tf_id, sender, addr, len from txg_part) p join r on p.addr >= r."start" and p.addr + p.len <= r."start" + r.size group by all""")
def region_lookup(s, d):
    i = F.col("id")
    r = s.range(40).select(i.alias("region"), (i * 150_000).alias("start"), (200_000 + i % 3 * 100_000).alias("size"))
    return transfer.in_region(v.txg_part(s, d).select("tf_id", "sender", "addr", "len").distinct(), r)


@query(""", b as (select tf_id, sender, addr, addr + (len + 63) // 64 * 64 as "end" from txg_part where len > 0), x as (select *, max("end") over (partition by tf_id, sender order by addr, "end" rows between unbounded preceding and 1 preceding) reach from b),
y as (select *, sum((reach is null or addr > reach)::int) over (partition by tf_id, sender order by addr, "end") island from x) select tf_id, sender, island::bigint island, min(addr) as "start", (max("end") - min(addr))::bigint len, count(*) n_blocks from y group by tf_id, sender, island""")
def interval_merge(s, d):
    return transfer.merged_intervals(v.txg_part(s, d), ("tf_id", "sender"))


@query(" select tf_id, sender, equipment, subspec, row_number() over (partition by tf_id, sender order by len > 0, addr) - 1 place from txg_part")
def address_order(s, d):
    return v.txg_part(s, d).withColumn("place", F.row_number().over(Window.partitionBy("tf_id", "sender").orderBy(F.col("len") > 0, "addr")) - 1).select("tf_id", "sender", "equipment", "subspec", "place")


@query(", x as (select tf_id, row_number() over (order by tf_id) - 1 n, sum(size)::bigint size from tf_part group by tf_id) select tf_id, size, n // 7 file_no, coalesce(sum(size) over (partition by n // 7 order by tf_id rows between unbounded preceding and 1 preceding), 0)::bigint as \"offset\" from x")
def file_rotation(s, d):
    x = v.tf_part(s, d).groupBy("tf_id").agg(F.sum("size").alias("size"))
    x = ordered.ranked(x, "n", "tf_id").withColumn("file_no", F.floor(F.col("n") / 7))
    before = Window.partitionBy("file_no").orderBy("tf_id").rowsBetween(Window.unboundedPreceding, -1)
    return x.select("tf_id", "size", "file_no", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))


# metrics


@query(" select sender, origin, tf_id // 6 \"interval\", avg(size) mean, min(size) least, max(size) most from hbf group by all")
def metric_value(s, d):
    return metrics.values(v.hbf(s, d).withColumn("value", F.col("size")), F.floor(F.col("tf_id") / 6), ("sender", "origin"))


@query(", m as (select sender, tf_id // 6 i, count(*) n, sum(size) t, min(size) a, max(size) b from hbf group by all), e as (select unnest(range(min(i), max(i) + 1)) i from m) select s.sender, e.i \"interval\", coalesce(t / n, 0) mean, coalesce(a, 0) least, coalesce(b, 0) most, coalesce(n, 0) / 21600 rate, coalesce(t, 0) / 21600 throughput from (select distinct sender from m) s cross join e left join m on m.sender = s.sender and m.i = e.i")
def metric_rate(s, d):
    return metrics.rates(v.hbf(s, d), F.floor(F.col("tf_id") / 6), 21_600)


@query(", x as (select sender, seq, size, size - lag(size) over (partition by sender order by seq) step from hbf) select sender, seq, sum(size) over w::bigint sum_n, avg(size) over w mean_n, min(size) over w least_n, max(size) over w most_n, avg(case when step > 0 then step end) over w mean_step, 1 / avg(case when step > 0 then step end) over w rate_step from x window w as (partition by sender order by seq rows between 63 preceding and current row)")
def running_stats(s, d):
    x = metrics.recent(v.hbf(s, d).select("sender", "seq", "size"), ("sender",), "seq", "size", 64)
    return x.drop("size")


COUNTERS = ", ev as (select sender, 'announced' kind from stf_info union all select sender, 'requested' from stf_info where seq % 5 < 3 union all select sender, 'sent' from stf_info where seq % 5 < 2 union all select sender, 'missing' from stf_info where seq % 31 = 0 union all select sender, 'rejected' from stf_info where seq % 29 = 0)"


def _events(s, d):
    x = v.stf_info(s, d)
    parts = [x.where(w).select("sender", F.lit(k).alias("kind")) for k, w in (("announced", "true"), ("requested", "seq % 5 < 3"), ("sent", "seq % 5 < 2"), ("missing", "seq % 31 = 0"), ("rejected", "seq % 29 = 0"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(COUNTERS + " , c as (select sender, count(*) filter (kind = 'announced') announced, count(*) filter (kind = 'requested') requested, count(*) filter (kind = 'sent') sent, count(*) filter (kind = 'missing') missing, count(*) filter (kind = 'rejected') rejected from ev group by sender) select *, requested - sent in_sending, announced - sent - rejected buffered from c")
def sender_counters(s, d):
    return metrics.sender_counters(_events(s, d))


@query(COUNTERS + " select kind, count(*) n from ev group by kind")
def outcome_counts(s, d):
    return _events(s, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(", x as (select sender, size, row_number() over (partition by sender order by seq desc) - 1 back, count(*) over (partition by sender) n from hbf) select sender, round(max(0.5 * pow(0.75, n)) + sum(size * 0.25 * pow(0.75, back)), 4) average from x group by sender")
def smoothed(s, d):
    return metrics.smoothed(v.hbf(s, d), ("sender",), "seq", "size").withColumn("average", F.round("average", 4))


@query(", x as (select tf_id, min(seq) seq, count(*) n from stf_info group by tf_id) select tf_id, seq, count(*) over (order by seq) built from x")
def output_count(s, d):
    x = v.stf_info(s, d).groupBy("tf_id").agg(F.min("seq").alias("seq"))
    return ordered.running(x, "built", "count", F.lit(1), "seq")


@query(", m as (select sender, tf_id // 6 i, count(*) n, sum(size)::double t from hbf group by all), l as (select sender, i, 'stf.n' name, n::double v from m union all select sender, i, 'stf.t', t from m) select name || ',sender=' || sender || ' value=' || printf('%.6f', v) || ' ' || (i * 21600000) line from l")
def metric_lines(s, d):
    x = v.hbf(s, d).groupBy("sender", F.floor(F.col("tf_id") / 6).alias("i")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("t"))
    return metrics.lines(x.withColumn("ms", F.col("i") * 21_600_000), ("sender",), ("n", "t"), "ms", "stf.")


# scheduling


@query()
def worker_first_fit(s, d):
    x = complete.status(v.stf_info(s, d), N).select(F.floor(F.col("tf_id") / 240).alias("run"), F.col("tf_id").alias("seq"), "tf_id", "tf_size")
    return schedule.first_fit(x, {w: 150_000 * (1 + w) for w in range(3)}, most_in_building=2, forwarded_after=10)


@query(", e as (select tf_id % 16 worker, tf_id, seq, case when seq % 3 = 2 then 'forwarded' else 'built' end kind, stf_size size from stf_info) select worker, seq, sum(case when kind = 'built' then -size else size end) over w::bigint balance, max(case when kind = 'built' then tf_id end) over w last_built from e window w as (partition by worker order by seq)")
def worker_ledger(s, d):
    x = v.stf_info(s, d).select((F.col("tf_id") % 16).alias("worker"), "tf_id", "seq", F.when(F.col("seq") % 3 == 2, "forwarded").otherwise("built").alias("kind"), F.col("stf_size").alias("size"))
    return schedule.ledger(x).select("worker", "seq", "balance", "last_built")


@query(", x as (select origin, subspec, min(seq) f from hbf group by all) select origin, subspec, (row_number() over (order by f) - 1) % 5 worker from x")
def topo_assign(s, d):
    return schedule.sticky(v.hbf(s, d), 5)


@query()
def tokens(s, d):
    """Each frame's workers, three of them, fetch from the senders whose parts they build."""
    x = v.stf_info(s, d).groupBy(F.col("tf_id").alias("run"), (F.col("sender") % 3).alias("worker")).agg(F.sort_array(F.collect_set((F.col("tf_id") + F.col("sender")) % N + 1)).alias("wanted"))
    return schedule.tokens(x, N)


@query(""", p as (select c_nationkey partition, c_custkey seq, c_custkey % 3 sender, case when c_custkey % 97 = 0 then 'failed' when c_custkey % 89 = 0 then 'terminate' else 'ready' end status from customer),
x as (select partition, seq, bool_or(status = 'failed') over w f, bool_or(status = 'terminate') over w t, (max((status = 'ready' and sender = 0)::int) over w + max((status = 'ready' and sender = 1)::int) over w + max((status = 'ready' and sender = 2)::int) over w)::bigint ready from p window w as (partition by partition order by seq))
select partition, seq, ready, case when f then 'error' when t then 'terminating' when ready >= 3 then 'configured' else 'configuring' end state from x""")
def partition_states(s, d):
    k = F.col("c_custkey")
    x = v.table(s, d, "customer").select(F.col("c_nationkey").alias("partition"), k.alias("seq"), (k % 3).alias("sender"), F.when(k % 97 == 0, "failed").when(k % 89 == 0, "terminate").otherwise("ready").alias("status"))
    return schedule.partition_state(x, 3).select("partition", "seq", F.col("ready").cast("bigint").alias("ready"), "state")


@query(f", x as (select tf_id, count(*) n, sum(case when seq % 6 <> 0 then 1 else 0 end)::bigint ok from stf_info group by tf_id) select tf_id, n, ok, ok = {N} ready from x")
def build_requests(s, d):
    x = v.stf_info(s, d).groupBy("tf_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("seq") % 6 != 0, 1).otherwise(0)).alias("ok"))
    return x.withColumn("ready", F.col("ok") == N)


@query(f" select tf_id, r.sender, 'drop' action from (select tf_id from stf_info group by tf_id having count(*) < 4), range({N}) r(sender)")
def drop_fan_out(s, d):
    x = complete.status(v.stf_info(s, d), N).where("n_senders < 4")
    return x.select("tf_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(N - 1).cast("bigint"))).alias("sender"), F.lit("drop").alias("action"))


# streams and files


@query(_emission("stf_info", "seq") + f", z as (select tf_id, sum(stf_size)::bigint tf_size from stf_info group by tf_id) select tf_id, n_senders, tf_size, emit_seq, n_senders = {N} complete from ids join e using (tf_id) join z using (tf_id) where emit_seq is not null")
def stream_complete(s, d):
    info = v.stf_info(s, d).select(F.lit(1).cast("bigint").alias("run"), "seq", "tf_id", "sender", "stf_size")
    out = replay.replayed(info, "seq", lambda x: completer.completed(x, N, 3_600_000))
    return out.where("outcome = 'built'").select("tf_id", "n_senders", "tf_size", "emit_seq", "complete")


@query(", q as (select *, (row_number() over (partition by subspec order by seq) - 1) // 16 w from hbf) select subspec, w \"window\", count(*) n_pages, sum(size)::bigint size, min(seq) first_seq, max(seq) last_seq from q group by subspec, w")
def stream_topology(s, d):
    """Each source's last page is marked, so what is open at the end of the input comes too."""
    pages = v.hbf(s, d).select("subspec", "seq", "size")
    ends = pages.groupBy("subspec").agg(F.max("seq").alias("end"))
    pages = pages.join(ends, "subspec").select("subspec", "seq", "size", (F.col("seq") == F.col("end")).alias("last"))
    return replay.replayed(pages, "seq", lambda x: builders.topology_frames(x, 16, 3_600_000))


@query(", l as (select tf_id, sender, count(*) n_parts, sum(size)::bigint size from hbf group by all), m as (select sender, max(tf_id) t from hbf group by sender) select sender, tf_id, n_parts, size, case when tf_id < t then 'next' else 'flag' end closed_by from l join m using (sender)")
def stream_build(s, d):
    """Each sender's last page is marked by last_tf."""
    pages = v.hbf(s, d).select("sender", "seq", "tf_id", "size")
    ends = pages.groupBy("sender").agg(F.max("seq").alias("end"))
    pages = pages.join(ends, "sender").select("sender", "seq", "tf_id", "size", (F.col("seq") == F.col("end")).alias("last_tf"))
    return replay.replayed(pages, "seq", lambda x: builders.sub_time_frames(x, 3_600_000))


@query(", x as (select distinct tf_id, sender, equipment, line, size, subspec from tf_part), p as (select tf_id, equipment, size, md5(left(repeat(md5(concat_ws('/', tf_id, sender, line, subspec, size)), (size // 32 + 1)::bigint), size)) digest from x) select tf_id, equipment, count(*) n_parts, sum(size)::bigint bytes, md5(string_agg(digest, '' order by digest)) digest from p group by all")
def tf_roundtrip(s, d):
    """Every part of every frame with a payload of its whole size, written, read again and compared by digest."""
    x = tables.dealt(v.tf_part(s, d), "tf_id").distinct()
    order = Window.partitionBy("tf_id", "equipment").orderBy("sender", "line", "subspec", "size")
    own = F.concat_ws("/", *(F.col(c).cast("string") for c in ("tf_id", "sender", "line", "subspec", "size")))
    size = F.col("size").cast("int")
    x = x.select("tf_id", F.lit(1).cast("bigint").alias("run"), (F.col("tf_id") * 256).alias("first_orbit"), F.col("equipment").alias("description"), F.lit("TST").alias("origin"), F.lit(0).cast("bigint").alias("subspec"), F.row_number().over(order).cast("bigint").alias("message"), F.lit(0).alias("split_index"), size.alias("size"), own.alias("own"))
    whole = F.substring(F.repeat(F.md5("own"), F.floor(F.col("size") / 32).cast("int") + 1).cast("binary"), F.lit(1), F.col("size"))
    at = replay.folder(s)
    tf_files.write_tf(x, at, whole, by_frame=True, max_frames=20, compression="zstd")
    read = tf_files.read_tf(s, at, digests=True).select("tf_id", F.col("description").alias("equipment"), "size", "digest")
    digests = F.transform(F.sort_array(F.collect_list("digest")), lambda x: F.lower(F.hex(x)))
    return read.groupBy("tf_id", "equipment").agg(F.count(F.lit(1)).alias("n_parts"), F.sum("size").alias("bytes"), F.md5(F.array_join(digests, "")).alias("digest"))


@query(", x as (select tf_id, seq data_idx, seq * 10 header_at, size from hbf) select tf_id, data_idx, rtrim(rpad(tf_id::varchar, 10, ' ') || ' ' || rpad('0', 10, ' ') || ' ' || rpad('100', 9, ' ') || ' ' || rpad('TPC', 6, ' ') || ' ' || rpad('RAWDATA', 9, ' ') || ' ' || rpad('0x' || lpad(lower(hex(size)), 8, '0'), 10, ' ') || ' ' || rpad(data_idx::varchar, 8, ' ') || ' ' || rpad(header_at::varchar, 10, ' ') || ' ' || rpad('96', 8, ' ') || ' ' || rpad((header_at + 96)::varchar, 10, ' ') || ' ' || rpad(size::varchar, 9, ' ') || ' ' || rpad(size::varchar, 12, ' ') || ' ' || rpad('1', 12, ' ') || ' ' || rpad('7', 10, ' ') || ' ' || rpad((tf_id * 256)::varchar, 12, ' ') || ' ' || rpad('0', 10, ' ') || ' ' || '0x00000010') line from x")
def sidecar_lines(s, d):
    one = lambda x: F.lit(x).cast("bigint")
    x = v.hbf(s, d).select(
        "tf_id", one(0).alias("tf_offset"), one(100).alias("tf_size"), F.lit("TPC").alias("origin"), F.lit("RAWDATA").alias("desc"), F.col("size").alias("subspec"), F.col("seq").alias("data_idx"), (F.col("seq") * 10).alias("hdr_off"), one(96).alias("hdr_size"), (F.col("seq") * 10 + 96).alias("data_off"), F.col("size").alias("data_size"),
        F.col("size").alias("rdh_mem_size"), one(1).alias("rdh_stop_bit"), one(7).alias("rdh_fee_id"), (F.col("tf_id") * 256).alias("rdh_orbit"), one(0).alias("rdh_bc"), one(16).alias("rdh_trg"),
    )
    return sidecar.lines(x)


@query("select 2 as version, t timeframe_id, l link_id, case when (t * 31 + l * 17) % 10 < 7 then 3 else 4 end system_id, t * 256 orbit_first, (t + 1) * 256 - 1 orbit_last, l = 1 last_tf from range(500) a(t), range(2) b(l) where (t * 7919 + 13) % 67 <> 0")
def generated_messages(s, d):
    return generator.messages(s, 500).select("version", "timeframe_id", "link_id", "system_id", "orbit_first", "orbit_last", "last_tf")


@query("select t timeframe_id, l link_id, 2000000000::bigint * 256 // (8 * 11223) made, 5 n_pages, 2000000000::bigint * 256 // (8 * 11223) - 5 * 1048576 lost from range(500) a(t), range(2) b(l) where (t * 7919 + 13) % 67 <> 0")
def generated_superpages(s, d):
    x = generator.superpages(generator.messages(s, 500), 2_000_000_000, free_pages=5)
    return x.select("timeframe_id", "link_id", "made", "n_pages", "lost")


@query(", q as (select tf_id, sender, min(seq) a, max(seq) b from stf_info group by all) select tf_id, sender, a requested_s, b + 3 received_s from q")
def stream_latency(s, d):
    """Requests and receipts as one stream, joined within a minute."""
    x = v.stf_info(s, d).groupBy("tf_id", "sender").agg(F.min("seq").alias("a"), F.max("seq").alias("b"))
    both = x.select("tf_id", "sender", F.lit("request").alias("kind"), F.col("a").alias("seq")).unionByName(x.select("tf_id", "sender", F.lit("receipt").alias("kind"), (F.col("b") + 3).alias("seq")))

    def joined(stream):
        at = F.timestamp_seconds(F.col("seq") + 86_400)  # time 0 is already late
        a = stream.where("kind = 'request'").select("tf_id", "sender", at.alias("requested"))
        b = stream.where("kind = 'receipt'").select("tf_id", "sender", at.alias("received"))
        return builders.fetched(a, b)

    out = replay.replayed(both, "seq", joined)
    return out.select("tf_id", "sender", (F.unix_seconds("requested") - 86_400).alias("requested_s"), (F.unix_seconds("received") - 86_400).alias("received_s"))


@query(", t as (select tf_id, sum(size)::bigint size from hbf group by tf_id) select tf_id + r * 1000 tf_id, r round, size from t, range(3) x(r)")
def replayed_frames(s, d):
    x = v.hbf(s, d).groupBy("tf_id").agg(F.sum("size").alias("size"))
    return generator.replayed(x, 3, 1000).select("tf_id", F.col("round").cast("bigint").alias("round"), "size")


# more decisions


@query(" select sender, tf_id, sum(stf_size) over (partition by sender order by tf_id)::bigint held, sum(stf_size) over (partition by sender order by tf_id) <= 1000000 * 95 // 100 kept from stf_info")
def keep_buffer(s, d):
    return schedule.keep_within(v.stf_info(s, d), 1_000_000).select("sender", "tf_id", "held", "kept")


@query(", x as (select tf_id, sender, stf_size, sum(stf_size) over (partition by tf_id order by sender) u, greatest(sum(stf_size) over (partition by tf_id), 1) t from stf_info) select tf_id, arg_max(sender, struct_pack(a := stf_size, b := sender)) linear, min(sender) filter ((tf_id * 7919 + 104729) % t < u and (tf_id * 7919 + 104729) % t >= u - stf_size) weighted from x group by tf_id")
def next_requests(s, d):
    return schedule.next_request(v.stf_info(s, d))


@query(""", x as (select tf_id % 20 worker, seq, case when seq % 50 = 49 then 'leaving' else 'running' end state, seq % 3 last_built, seq % 2 last_scheduled, buffer_used free_memory from stf_info),
g as (select *, count(*) filter (state <> 'running') over w gone from x window w as (partition by worker order by seq)), h as (select *, state = 'running' and (row_number() over (partition by worker, gone, state = 'running' order by seq) = 1 or last_built = last_scheduled) fresh from g),
e as (select *, count(*) filter (fresh) over (partition by worker order by seq) era, max(gone) over (partition by worker) gone_last from h),
k as (select worker, min(free_memory) free from e where gone = gone_last and state = 'running' and (fresh or last_built < last_scheduled) and era = (select max(era) from e f where f.worker = e.worker) group by worker)
select w.worker, k.free is not null ready, k.free from (select distinct worker from x) w left join k using (worker)""")
def worker_updates(s, d):
    q = F.col("seq")
    x = v.stf_info(s, d).select((F.col("tf_id") % 20).alias("worker"), "seq", F.when(q % 50 == 49, "leaving").otherwise("running").alias("state"), (q % 3).alias("last_built"), (q % 2).alias("last_scheduled"), F.col("buffer_used").alias("free_memory"))
    return schedule.worker_updates(x)


@query(" select o_orderkey * 10 + o_custkey % 10 seq, case when o_custkey % 9 = 0 then ' ' else 'p' || o_orderkey end partition_id, case when o_custkey % 4 = 0 then null when o_custkey % 4 = 1 then 'a' else 'a,b' end sender_list, 1 n_parameters, o_custkey % 9 <> 0 and o_custkey % 5 <> 0 and o_custkey % 4 <> 0 valid from orders")
def partition_requests(s, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    x = v.table(s, d, "orders").select((k * 10 + c % 10).alias("seq"), F.when(c % 9 == 0, " ").otherwise(F.concat(F.lit("p"), k.cast("string"))).alias("partition_id"), F.when(c % 5 != 0, "2024-01-01 10:00:00").alias("created"), F.when(c % 4 == 0, "a;a").when(c % 4 == 1, " a ").otherwise("b,a").alias("senders"), F.lit('{"n":"1"}').alias("parameters"))
    return schedule.partition_requests(x)


@query(""", r as (select 'p' || o_orderkey folder, case when o_custkey % 9 = 0 then ' ' else 'part' || o_orderkey end id, case when o_custkey % 5 <> 0 then 't' || o_custkey end created, case o_custkey % 4 when 0 then 'a;a' when 1 then ' a ' else 'b,a' end senders, o_custkey % 7 = 0 half from orders),
k as (select *, trim(id) <> '' and created is not null and senders <> 'a;a' ok from r where not half),
i as (select folder, ok, id, 'partition-id' field, id v from k union all select folder, ok, id, 'stf-sender-id-list', senders from k union all select folder, ok, id, 'parameters', '{}' from k union all select folder, ok, id, 'request-create-time', created from k where created is not null),
m as (select *, case when ok then 'partitions/' || id else 'invalid/7/' || folder end to_ from i)
select 'requests/' || folder || '/' || field old_key, to_ || '/' || field new_key, v "value", ok "valid" from m union all select null, case when ok then 'partitions/' || id else 'invalid/7/' || folder end || '/request-time', '7', ok from k""")
def partition_filing(s, d):
    """Requests in a store of keys; one in seven isn't finished, one in five has no time of creation."""
    k, c = F.col("o_orderkey").cast("string"), F.col("o_custkey")
    field = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    first = [field("partition-id", F.when(c % 9 == 0, " ").otherwise(F.concat(F.lit("part"), k))), field("stf-sender-id-list", F.when(c % 4 == 0, "a;a").when(c % 4 == 1, " a ").otherwise("b,a"))]
    rest = [field("parameters", F.lit("{}")), field("request-create-time", F.when(c % 5 != 0, F.concat(F.lit("t"), c.cast("string"))))]
    items = v.table(s, d, "orders").select("o_orderkey", F.inline(F.when(c % 7 == 0, F.array(*first)).otherwise(F.array(*first, *rest))))
    items = items.where("value is not null").select(F.concat_ws("/", F.lit("requests"), F.concat(F.lit("p"), k), "name").alias("key"), "value")
    return schedule.filed_requests(items, "7")


@query()
def keep_buffer_drawn(s, d):
    return schedule.keep_drawn(v.stf_info(s, d), 1_000_000)


@query(""", x as (select tf_id % 16 worker, seq, (row_number() over (partition by tf_id % 16 order by seq) - 1) k from stf_info)
select worker, seq, (max(seq - k // 4 * 100) over (partition by worker, k % 4 order by k) + k // 4 * 100)::bigint start from x""")
def fetch_starts(s, d):
    """Fetches that take equally long, so the SQL needs no state: each waits for the fourth before it."""
    x = v.stf_info(s, d).select((F.col("tf_id") % 16).alias("worker"), "seq", F.col("seq").alias("at"), F.lit(100).cast("bigint").alias("took"))
    return transfer.started(x, 4).select("worker", "seq", "start")


@query(f""", t as (select tf_id, count(*) n, sum(stf_size) size, max(seq) - min(seq) took from stf_info group by tf_id), s as (select sender, arg_max(buffer_used, seq) / arg_max(buffer_size, seq) used from stf_info group by sender),
m as (select sender, max(tf_id) - min(tf_id) + 1 - count(distinct tf_id) missing from stf_info group by sender), y as (select * from txg_part where len > 0),
z as (select *, lag(region) over w lr, lag(addr + len) over w le from y window w as (partition by tf_id, sender order by addr)), g as (select *, sum(case when lr <> region or addr - le > 8192 then 1 else 0 end) over (partition by tf_id, sender order by addr) txg from z),
h as (select tf_id, sender, txg, max(addr + len) - min(addr) whole, sum(len) data from g group by all)
select 'tfscheduler' component, 'tf.complete.total' "name", (select count(*) from t where n = {N})::double "value" union all select 'tfscheduler', 'tf.incomplete.total', (select count(*) from t where n < {N}) union all select 'tfscheduler', 'tf.scheduled.data_size_total', (select sum(size) from t)
union all select 'tfscheduler', 'tf.scheduled.incomplete.stf_cnt', (select sum(n) from t where n < {N}) union all select 'tfscheduler', 'stf.update.complete_dur_ms', (select round(avg(took), 6) from t where n = {N}) union all select 'tfscheduler', 'stf.update.incomplete_dur_ms', (select round(avg(took), 6) from t where n < {N})
union all select 'tfscheduler', 'stfsender.buffer.max_util', (select max(used) from s) union all select 'tfbuilder', 'tf_output.id', (select max(tf_id) from t) union all select 'tfbuilder', 'tf_output.sent_count', (select count(*) from t) union all select 'tfbuilder', 'tf_output.sent_size', (select sum(size) from t)
union all select 'tfbuilder', 'merge.receive_span_ms', (select max(took) from t) union all select 'stfsender', 'stf_input.id', (select max(tf_id) from stf_info) union all select 'stfsender', 'buffered.stf_cnt', (select count(*) from stf_info) union all select 'stfsender', 'buffered.stf_size', (select sum(stf_size) from stf_info)
union all select 'stfsender', 'sending.stf_cnt', (select count(*) from stf_info where seq % 5 = 2) union all select 'stfsender', 'sending.stf_size', (select sum(stf_size) from stf_info where seq % 5 = 2) union all select 'stfsender', 'stf_output.sent_count', (select count(*) from stf_info where seq % 5 < 2)
union all select 'stfsender', 'stf_output.sent_size', (select sum(stf_size) from stf_info where seq % 5 < 2) union all select 'stfsender', 'stf_output.stf_id', (select max(tf_id) from stf_info where seq % 5 < 2) union all select 'stfsender', 'stf_output.missing_cnt', (select count(*) from stf_info where seq % 31 = 0)
union all select 'stfsender', 'stf_output.rejected_cnt', (select count(*) from stf_info where seq % 29 = 0) union all select 'stfbuilder', 'stf_input.missing_stf.total', (select sum(missing) from m) union all select 'stfbuilder', 'stf_output.total', (select count(*) from stf_info) union all select 'stfbuilder', 'stf_output.id', (select max(tf_id) from stf_info)
union all select 'stfsender', 'ucx_txg.count', (select count(*) from h) union all select 'stfsender', 'ucx_rma_gap_total.size', (select sum(whole - data) from h) union all select 'stfsender', 'ucx_rma_gap_overhead', (select sum(whole - data) / sum(whole) from h) union all select 'stfsender', 'ucx.rma_gap', 8192""")
def metric_table(s, d):
    """Metrics of all components by their names; a fifth of the announced is in sending, two fifths are sent."""
    i, one, q = v.stf_info(s, d), F.lit(1), F.col("seq")
    t = i.groupBy("tf_id").agg(F.count(one).alias("n"), F.sum("stf_size").alias("size"), (F.max("seq") - F.min("seq")).alias("took"))
    full, size, of = F.col("n") == N, F.col("stf_size"), lambda w, x: F.sum(F.when(w, x))
    m = i.groupBy("sender").agg((F.max("tf_id") - F.min("tf_id") + 1 - F.countDistinct("tf_id")).alias("missing"))
    found = [
        metrics.named(t, "tfscheduler", {"tf.complete.total": F.count(F.when(full, one)), "tf.incomplete.total": F.count(F.when(~full, one)), "tf.scheduled.data_size_total": F.sum("size"), "tf.scheduled.incomplete.stf_cnt": of(~full, F.col("n")), "stf.update.complete_dur_ms": F.round(F.avg(F.when(full, F.col("took"))), 6), "stf.update.incomplete_dur_ms": F.round(F.avg(F.when(~full, F.col("took"))), 6)}),
        metrics.named(metrics.buffers(i), "tfscheduler", {"stfsender.buffer.max_util": F.max("max_used")}),
        metrics.named(t, "tfbuilder", {"tf_output.id": F.max("tf_id"), "tf_output.sent_count": F.count(one), "tf_output.sent_size": F.sum("size"), "merge.receive_span_ms": F.max("took")}),
        metrics.named(i, "stfsender", {"stf_input.id": F.max("tf_id"), "buffered.stf_cnt": F.count(one), "buffered.stf_size": F.sum(size), "sending.stf_cnt": F.count(F.when(q % 5 == 2, one)), "sending.stf_size": of(q % 5 == 2, size), "stf_output.sent_count": F.count(F.when(q % 5 < 2, one)), "stf_output.sent_size": of(q % 5 < 2, size), "stf_output.stf_id": F.max(F.when(q % 5 < 2, F.col("tf_id"))), "stf_output.missing_cnt": F.count(F.when(q % 31 == 0, one)), "stf_output.rejected_cnt": F.count(F.when(q % 29 == 0, one))}),
        metrics.named(m, "stfbuilder", {"stf_input.missing_stf.total": F.sum("missing")}),
        metrics.named(i, "stfbuilder", {"stf_output.total": F.count(one), "stf_output.id": F.max("tf_id")}),
        metrics.named(transfer.groups(v.txg_part(s, d)), "stfsender", {"ucx_txg.count": F.count(one), "ucx_rma_gap_total.size": F.sum("gap"), "ucx_rma_gap_overhead": F.sum("gap") / F.sum("len"), "ucx.rma_gap": F.max(F.lit(transfer.GAP))}),
    ]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


@query(", x as (select tf_id, min(seq) seq, min(ts) at_ from hbf group by tf_id) select tf_id, count(*) over (order by seq) built, count(*) over (order by seq) / greatest(1, date_diff('hour', timestamp '2024-01-01', at_)) an_hour from x")
def output_rate(s, d):
    x = v.hbf(s, d).groupBy("tf_id").agg(F.min("seq").alias("seq"), F.min("ts").alias("at"))
    x = ordered.running(x, "built", "count", F.lit(1), "seq")
    hours = F.greatest(F.lit(1), F.expr("timestampdiff(HOUR, timestamp_ntz'2024-01-01 00:00:00', at)"))
    return x.select("tf_id", "built", (F.col("built") / hours).alias("an_hour"))


@query(" select tf_id, sender, min(coalesce(nullif(case when seq % 4 = 0 then 0 else tf_id * 256 end, 0), tf_id * 256 + trigger)) first_orbit from hbf group by all")
def first_orbit(s, d):
    given = F.when(F.col("seq") % 4 == 0, 0).otherwise(F.col("tf_id") * 256)
    return v.hbf(s, d).groupBy("tf_id", "sender").agg(F.min(F.coalesce(F.nullif(given, F.lit(0)), F.col("tf_id") * 256 + F.col("trigger"))).alias("first_orbit"))


@query(", e as (select tf_id, sender, seq from stf_info union all select tf_id, sender, seq + 5 from stf_info where seq % 6 = 0) select tf_id, sender, count(*) n, min(seq) recorded from e group by all")
def events_once(s, d):
    x = v.stf_info(s, d).select("tf_id", "sender", "seq")
    return x.unionByName(x.where("seq % 6 = 0").withColumn("seq", F.col("seq") + 5)).groupBy("tf_id", "sender").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("recorded"))


@query(f", g as (select *, count(distinct case when sender < 8 then sender end) over () = {N} and seq >= 20 running from stf_info) select seq, tf_id, sender from g where running")
def running_gate(s, d):
    x = v.stf_info(s, d)
    ready = x.agg(F.countDistinct("sender") == N).scalar()
    return x.where(ready & (F.col("seq") >= 20)).select("seq", "tf_id", "sender")


@query(", x as (select sender, arg_max(seq % 7 <> 3, seq) ready from stf_info group by sender) select count(*) filter (ready) n_ready, count(*) n, count(*) filter (ready) = 8 healthy from x")
def sender_health(s, d):
    x = v.stf_info(s, d).groupBy("sender").agg(F.max_by(F.col("seq") % 7 != 3, "seq").alias("ready"))
    n = F.count(F.when(F.col("ready"), 1))
    return x.groupBy().agg(n.alias("n_ready"), F.count(F.lit(1)).alias("n"), (n == N).alias("healthy"))


@query(" select c_nationkey \"partition\", min(c_custkey) scheduler from customer group by c_nationkey")
def lowest_scheduler(s, d):
    return v.table(s, d, "customer").groupBy(F.col("c_nationkey").alias("partition")).agg(F.min("c_custkey").alias("scheduler"))
