"""Operators with state or files: against step-by-step versions, and round trips."""

import hashlib
import random
import struct
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from framewright import catalog
from framewright.operators import build, complete, ordered, schedule, tables, transfer
from framewright.plans import views as v
from framewright.plans.settings import Settings
from framewright.functions import headers
from framewright.sources import sidecar, tf_files, tf_format
from framewright.streaming import builders, replay
from framewright.streaming.completer import Completer, completing
from framewright.streaming.listener import BatchMetrics


def histories(seed, n, senders):
    """Announcements with senders in order, some repeated."""
    rng = random.Random(seed)
    queues = [sorted(rng.sample(range(1, n + 1), rng.randint(n // 2, n))) for _ in range(senders)]
    out = []
    while any(queues):
        s = rng.choice([i for i, q in enumerate(queues) if q])
        tf = queues[s].pop(0)
        out += [(tf, s)] * (1 + (rng.random() < 0.1))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_emission_is_what_the_completer_does(spark, seed):
    senders = 3
    events = histories(seed, 40, senders)
    c, built, late = Completer(senders), {}, 0
    for seq, (tf, s) in enumerate(events):
        for t, at, n, _, whole, outcome in c.announce(tf, s, 1, seq):
            if outcome == "built":
                built[t] = (at, n, whole)
            late += outcome == "late"
    info = spark.createDataFrame([(i, t, s, 1) for i, (t, s) in enumerate(events)], "seq long, tf_id long, sender long, stf_size long")
    got = {r.tf_id: (r.emit_seq, r.n_senders, r.complete) for r in complete.emission(info, senders).collect() if r.emit_seq is not None}
    assert got == built
    assert set(c.open) == {r.tf_id for r in complete.emission(info, senders).where("emit_seq is null").collect()}
    assert complete.late(info, senders).count() == late


def test_completer_rules():
    c = Completer(2)
    assert list(c.announce(5, 0, 10, 0)) == []
    assert [x[-1] for x in c.announce(5, 0, 10, 1)] == ["repeated"]
    assert [x[:5] for x in c.announce(5, 1, 7, 2)] == [(5, 2, 2, 17, True)]
    assert [x[-1] for x in c.announce(4, 1, 7, 3)] == ["late"]
    assert list(c.announce(6, 0, 1, 4, now=100)) == []
    assert [x[0] for x in c.stale(200, 150)] == [] and [(x[0], x[-1]) for x in c.stale(300, 150)] == [(6, "stale")]


def test_running_over_ranges(spark):
    rng = random.Random(1)
    data = [(i, rng.randint(0, 3), rng.randint(-50, 50) if rng.random() < 0.9 else None) for i in range(500)]
    df = spark.createDataFrame(data, "o long, k long, v long")
    for how, f in (("sum", lambda x: sum(x)), ("max", lambda x: max(x, default=None)), ("min", lambda x: min(x, default=None)), ("count", len)):
        for before in (False, True):
            got = {r.o: r.y for r in ordered.running(df, "y", how, F.col("v"), "o", ["k"], before=before, width=37).collect()}
            for o, k, _ in data:
                assert got[o] == f([v for p, q, v in data if q == k and v is not None and (p < o or p == o and not before)]), (how, before, o)
    got = {r.o: r.y for r in ordered.running(df, "y", "last", F.col("o"), "o", before=True, width=37).collect()}
    assert got == {o: o - 1 if o else None for o, _, _ in data}
    assert {r.o: r.n for r in ordered.ranked(df, "n", "o", width=11).collect()} == {o: o for o, _, _ in data}


def test_running_over_sparse_numbers(spark):
    rng = random.Random(5)
    data = sorted(rng.sample(range(-(10**15), 10**15), 300)) + [None]
    df = spark.createDataFrame([(x, 1) for x in data], "o long, v long")
    got = {r.o: r.y for r in ordered.running(df, "y", "sum", F.col("v"), "o", width=10**13).collect()}
    assert got == {x: i + 2 for i, x in enumerate(data[:-1])} | {None: 1}
    assert {r.o: r.n for r in ordered.ranked(df, "n", "o").collect()} == {x: i + 1 for i, x in enumerate(data[:-1])} | {None: 0}


def test_nested_running_values_read_their_input_once(spark, sf):
    plan = catalog.QUERIES["late_stf"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 0 and plan.count("Scan ExistingRDD") <= 4


def assign(sizes, workers, most, built_after, forwarded_after):
    """First fit, frame by frame: every worker's frames are looked at anew."""
    row, taken, out = sorted(workers), [], []
    for seq, size in enumerate(sizes):
        need, reasons, got = size * 120 // 100, [], None
        for w in row:
            own = [(at, n) for at, n, x in taken if x == w and seq < at + built_after + forwarded_after]
            building = sum(seq < at + built_after for at, _ in own)
            free = workers[w] - sum(n for _, n in own)
            if building >= most:
                reasons.append("too_many_frames")
            elif free < need or len(own) - building > 8 and free < 4 * need:
                reasons.append("no_memory")
            else:
                got = w
                break
        if got is not None:
            row.remove(got)
            row.append(got)
            taken.append((seq, need, got))
        out.append((got, "ok" if got is not None else "no_worker" if not row else "too_many_frames" if "too_many_frames" in reasons else "no_memory"))
    return out


@pytest.mark.parametrize(("workers", "most", "built", "forwarded"), [({0: 10, 1: 1000}, 1, 4, 0), ({}, 5, 4, 0), ({0: 300, 1: 200, 2: 900}, 2, 3, 5), ({0: 3000}, 5, 1, 30), ({0: 3000, 1: 700}, 3, 2, 15)])
def test_first_fit_step_by_step(spark, workers, most, built, forwarded):
    rng = random.Random(4)
    sizes = [100, 100] + [rng.randint(1, 200) for _ in range(120)]
    df = spark.createDataFrame([(1, i, i + 1000, z) for i, z in enumerate(sizes)], "run long, seq long, tf_id long, tf_size long")
    got = {r.tf_id: (r.worker, r.reason) for r in schedule.first_fit(df, workers, most, built, forwarded).collect()}
    assert [got[i + 1000] for i in range(len(sizes))] == assign(sizes, workers, most, built, forwarded)


def test_reasons_of_first_fit(spark):
    df = spark.createDataFrame([(1, i, i, 100) for i in range(2)], "run long, seq long, tf_id long, tf_size long")
    reasons = lambda *x: [r.reason for r in sorted(schedule.first_fit(df, *x).collect(), key=lambda r: r.tf_id)]
    assert reasons({0: 10, 1: 1000}, 1) == ["ok", "too_many_frames"] and reasons({0: 10}, 1) == ["no_memory"] * 2 and reasons({}, 1) == ["no_worker"] * 2
    df = spark.createDataFrame([(1, i, i, 10) for i in range(12)], "run long, seq long, tf_id long, tf_size long")
    assert reasons({0: 150}, 50, 1, 100)[8:] == ["ok", "no_memory", "no_memory", "no_memory"]  # nine are buffered, and less than 48 bytes are free


def test_tokens_of_senders():
    t = schedule.Tokens(3, 2)
    assert t.request({1, 2}, 0) == (1, "base") and t.request({1}, 0) == (1, "extra") and t.request({1}, 0) == (0, "none")
    assert t.request({1, 2, 3}, 1) == (3, "base") and t.request({1, 3}, 0) == (3, "extra")
    t.release(1)
    assert t.request({1}, 0) == (1, "extra")  # the base token comes back only with the last
    t.release(1)
    t.release(1)
    t.release(1)
    assert t.left[1] == 2 and t.request({1}, 5) == (1, "base")
    t.reset()
    assert t.base == {1, 2, 3} == t.extra
    one = schedule.Tokens(2, 1)
    assert one.request({1}, 0) == (1, "base") and one.request({1}, 0) == (0, "none")


def test_workers_fetch_from_all_they_want(spark):
    wanted = {0: [1, 2, 3], 1: [1, 2], 2: [1, 9], 3: []}
    df = spark.createDataFrame([(5, w, x) for w, x in wanted.items()], "run long, worker long, wanted array<int>")
    got = sorted(schedule.tokens(df, 3, per_sender=1, hold=4, lease=7).collect(), key=lambda r: (r.tick, r.worker))
    fetched = {w: sorted(r.token for r in got if r.worker == w and r.token) for w in wanted}
    assert fetched == {0: [1, 2, 3], 1: [1, 2], 2: [1], 3: []}
    held = [(r.tick, r.token) for r in got if r.token]
    for i, (a, x) in enumerate(held):  # a sender's only token is out for four ticks, or until the lease of all ends
        assert all(b - a >= 4 or b // 7 > a // 7 for b, y in held[i + 1 :] if x == y)
    assert {r.kind for r in got} == {"base", "none"}


def test_updates_of_workers(spark):
    rows = [(1, 0, "running", 0, 0, 50), (1, 1, "running", 1, 2, 40), (1, 2, "running", 1, 2, 45), (2, 0, "running", 5, 5, 9), (2, 1, "leaving", 5, 5, 9), (3, 0, "running", 0, 9, 7), (3, 1, "running", 9, 9, 70), (3, 2, "running", 10, 9, 3),
            (4, 0, "running", 0, 0, 5), (4, 1, "leaving", 0, 0, 5), (4, 2, "running", 3, 8, 60), (4, 3, "running", 3, 8, 80), (4, 4, "running", 3, 8, 55)]
    got = {r.worker: (r.ready, r.free) for r in schedule.worker_updates(spark.createDataFrame(rows, "worker long, seq long, state string, last_built long, last_scheduled long, free_memory long")).collect()}
    assert got == {1: (True, 40), 2: (False, None), 3: (True, 70), 4: (True, 55)}


def test_high_watermark_frees_the_fullest_sender(spark):
    rows = [(1, 0, 10), (1, 1, 90), (2, 1, 30), (3, 0, 10), (4, 1, 25), (5, 0, 5), (5, 1, 5), (5, 2, 5), (6, 1, 99), (9, 1, 10)]
    info = spark.createDataFrame([(i, t, s, z, 95 if s == 1 else 50, 100) for i, (t, s, z) in enumerate(rows)], "seq long, tf_id long, sender long, stf_size long, buffer_used long, buffer_size long")
    frames = complete.status(info, 3).select("tf_id", "complete")
    free = lambda *x: [(r.tf_id, r.sender, r.total) for r in sorted(complete.over_watermark(info, frames, *x).collect(), key=lambda r: r.tf_id)]
    assert free(90, 1000) == [(1, 1, 90), (2, 1, 120), (4, 1, 145)]  # 3 doesn't help, 6 and 9 are above the complete frame
    assert free(90, 90) == [(1, 1, 90), (2, 1, 120)] and free(90, 89) == [(1, 1, 90)] and free(95, 1000) == []
    assert free(90, 1000, 7) == [(1, 1, 90), (2, 1, 120)]  # 3 is the first that is too young


def test_buffer_is_kept_below_the_target(spark):
    df = spark.createDataFrame([(0, i, 10) for i in range(10)], "sender long, tf_id long, stf_size long")
    assert sorted(r.tf_id for r in schedule.keep_within(df, 100).where("kept").collect()) == list(range(9))
    assert schedule.keep_within(df, 106).where("kept").count() == 10


def drawn(arrivals, room, percent):
    """One sender's buffer, arrival by arrival."""
    held, fate = {}, {}
    draw = lambda seq, k: (seq * 7919 + 3 * 104729 + k * 3571) % 10007 % 100
    for seq, tf, size in arrivals:
        while held and sum(z for _, z in held.values()) > room * 95 // 100:
            fate[held.pop(max(held))[0]] = ("target", seq)
        if held and draw(seq, 0) <= percent:
            fate[held.pop(max(held))[0]] = ("highest", seq)
        if held and draw(seq, 1) <= percent // 4:
            fate[held.pop(sorted(held)[len(held) * draw(seq, 2) // 200])[0]] = ("drawn", seq)
        if tf in held:
            fate[seq] = ("repeated", seq)
        else:
            held[tf] = (seq, size)
    return fate | {seq: ("held", None) for seq, _ in held.values()}


@pytest.mark.parametrize("percent", [0, 25, 100])
def test_buffer_with_draws(spark, percent):
    rng = random.Random(percent)
    rows = [(i, rng.randint(1, 90), rng.randint(1, 40)) for i in range(300)]
    df = spark.createDataFrame([(s, i, tf, z) for s in (3, 4) for i, tf, z in rows], "sender long, seq long, tf_id long, stf_size long")
    got = schedule.keep_drawn(df.repartition(3), 400, percent).collect()
    assert len(got) == 600
    mine = {r.seq: (r.fate, r.until) for r in got if r.sender == 3}
    assert mine == drawn(rows, 400, percent)
    assert percent != 25 or {f for f, _ in mine.values()} == {"target", "highest", "drawn", "repeated", "held"}
    assert schedule.keep_drawn(df.limit(0), 400).count() == 0


@pytest.mark.parametrize("most", [2, 5, 300])
def test_fetches_in_flight(spark, most):
    rng = random.Random(most)
    rows = [(w, i, i // 3 * 2, rng.choice([0, 1, 7, 30])) for w in (1, 2) for i in range(150)]
    got = {(r.worker, r.seq): (r.start, r.in_flight) for r in transfer.started(spark.createDataFrame(rows, "worker long, seq long, at long, took long").repartition(3), most).collect()}
    for w in (1, 2):
        running, now = [], 0
        for _, seq, at, took in [r for r in rows if r[0] == w]:
            now = max(now, at)
            while len([e for e in running if e > now]) >= most:
                now += 1
            running = [e for e in running if e > now] + [now + took]
            assert got[w, seq] == (now, len(running))


def test_filed_requests(spark):
    good = {"partition-id": " p1 ", "request-create-time": "now", "stf-sender-id-list": "b, a", "parameters": "{}"}
    folders = {"x": good, "y": good | {"partition-id": "p2", "stf-sender-id-list": "a;a"}, "z": good | {"partition-id": "  "}, "w": {"partition-id": "p3", "parameters": "{}"}}
    items = [(f"requests/{f}/{k}", v) for f, x in folders.items() for k, v in x.items()] + [("settings/a/b", "1"), ("requests", "2")]
    got = [tuple(r) for r in schedule.filed_requests(spark.createDataFrame(items, "key string, value string"), "99").collect()]
    to = {"x": "partitions/p1", "y": "invalid/99/y", "z": "invalid/99/z"}
    want = [(f"requests/{f}/{k}", f"{to[f]}/{k}", v, f == "x") for f in to for k, v in folders[f].items()] + [(None, f"{t}/request-time", "99", f == "x") for f, t in to.items()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_missing_settings_are_written_back(spark):
    table = spark.createDataFrame([("stale_tf_timeout_ms", "100"), ("other", "x")], "key string, value string")
    more = Settings.read(table).missing(table)
    keys = {r.key: r.value for r in more.collect()}
    assert "stale_tf_timeout_ms" not in keys and keys["build_incomplete_tfs"] == "true" and keys["tokens_per_sender"] == "2"
    assert Settings.read(table.union(more)) == Settings.read(table) and Settings.read(table).missing(table.union(more)).count() == 0


def test_windows_by_orbit(spark):
    rows = [(1, i, 10, i // 3) for i in range(20)] + [(2, i, 1, 0) for i in range(7)]
    df = spark.createDataFrame(rows, "subspec long, seq long, size long, orbit long")
    got = sorted((r.subspec, r.window, r.n_pages, r.first_seq) for r in build.topology_frames_by_orbit(df, 4).collect())
    assert got == [(1, 0, 6, 0), (1, 1, 6, 6), (1, 2, 6, 12), (1, 3, 2, 18), (2, 0, 7, 0)]


def test_region_is_the_largest_that_holds(spark):
    points = spark.createDataFrame([(10, 5), (100, 50), (195, 10)], "addr long, len long")
    regions = spark.createDataFrame([(1, 0, 200), (2, 0, 150), (3, 90, 300)], "region long, start long, size long")
    assert sorted(tuple(r) for r in transfer.in_region(points, regions, 64).collect()) == [(10, 5, 1), (100, 50, 3), (195, 10, 3)]


PARTS = [("RAWDATA", "TPC", 7, [b"abc"]), ("CLUSTERS", "TPC", 1, [b"x" * 100, b"", b"yz"]), ("RAWDATA", "ITS", 9, [b"1"]), ("RAWDATA", "TPC", 7, [b"second"])]


def test_bytes_there_and_back():
    data = tf_format.encode(3, 500, 768, PARTS) + tf_format.encode(4, 500, 1024, PARTS[:1])
    got = list(tf_format.decode(data))
    assert [(r["tf_id"], r["origin"], r["payload"]) for r in got] == [(3, "TPC", b"x" * 100), (3, "TPC", b""), (3, "TPC", b"yz"), (3, "ITS", b"1"), (3, "TPC", b"abc"), (3, "TPC", b"second"), (4, "TPC", b"abc")]
    assert [(r["split_index"], r["split_parts"]) for r in got[:4]] == [(0, 3), (1, 3), (2, 3), (0, 1)]
    assert [r["tf_id"] for r in tf_format.decode(data, lambda t: t == 4)] == [4]
    index = tf_format.index_of(data)
    assert [(e["description"], e["origin"], e["block_cnt"]) for e in index] == [("CLUSTERS", "TPC", 3), ("RAWDATA", "ITS", 1), ("RAWDATA", "TPC", 2)]
    assert index[1]["offset"] == index[0]["size"]
    for bad in (data[:-1], data[:50], b"\0" * 200):
        with pytest.raises(ValueError):
            list(tf_format.decode(bad))


def test_files_there_and_back(spark, tmp_path):
    rows = [(t, 1, t * 256, d, o, s, m, i, p) for t in range(9) for m, (d, o, s, ps) in enumerate(PARTS) for i, p in enumerate(ps)]
    schema = "tf_id long, run long, first_orbit long, description string, origin string, subspec long, message long, split_index int, payload binary"
    tf_files.write_tf(spark.createDataFrame(rows, schema), str(tmp_path), max_frames=2, run=77)
    assert not [p for p in tmp_path.iterdir() if p.name.endswith(".part")] and (tmp_path / "run-77.done").exists()
    (tmp_path / ".hidden.tf").write_bytes(b"no")
    key = lambda r: (r.tf_id, r.description, r.origin, r.subspec, r.split_index, bytes(r.payload))
    want = sorted((t, d, o, s, i, p) for t, _, _, d, o, s, _, i, p in rows)
    tf_files.register(spark)
    own = spark.read.format("timeframes").load(str(tmp_path))
    assert sorted(map(key, own.collect())) == want
    assert sorted(map(key, tf_files.read_tf(spark, str(tmp_path)).collect())) == want
    assert {r.tf_id for r in own.where("tf_id >= 7").collect()} == {7, 8}


def test_packed_files_and_digests(spark, tmp_path):
    """Payloads made while they're written: packed files hold the same parts, in less room, and are told from others by themselves."""
    x = spark.range(40).select((F.col("id") % 10).alias("tf_id"), F.lit(1).cast("long").alias("run"), F.lit(5).cast("long").alias("first_orbit"), F.concat(F.lit("E"), (F.col("id") % 3).cast("string")).alias("description"), F.lit("TST").alias("origin"), F.lit(0).cast("long").alias("subspec"), F.col("id").alias("message"), F.lit(0).alias("split_index"))
    payload = F.repeat(F.md5(F.col("message").cast("string")), 1000 + F.col("message").cast("int")).cast("binary")
    tf_files.write_tf(x.repartition(2, "tf_id"), str(tmp_path / "packed"), payload, by_frame=True, max_frames=3, compression="zstd")
    tf_files.write_tf(x.withColumn("payload", payload), str(tmp_path / "plain"))
    size = lambda name: sum(p.stat().st_size for p in (tmp_path / name).glob("*.tf"))
    assert 0 < 20 * size("packed") < size("plain")
    want = sorted((m % 10, f"E{m % 3}", hashlib.md5(hashlib.md5(str(m).encode()).hexdigest().encode() * (1000 + m)).digest(), 32 * (1000 + m)) for m in range(40))
    for name in ("packed", "plain"):
        for df in (tf_files.read_tf(spark, str(tmp_path / name)), spark.read.format("timeframes").load(str(tmp_path / name))):
            assert sorted((r.tf_id, r.description, hashlib.md5(r.payload).digest(), len(r.payload)) for r in df.collect()) == want
        assert sorted((r.tf_id, r.description, bytes(r.digest), r["size"]) for r in tf_files.read_tf(spark, str(tmp_path / name), digests=True).collect()) == want
    with pytest.raises(ValueError):
        tf_files.plain(next((tmp_path / "packed").glob("*.tf")).read_bytes()[:-20])


def test_roundtrip_of_every_part(spark, sf):
    parts = v.tf_part(spark, sf).distinct()
    want = parts.groupBy("tf_id", "equipment").agg(F.count(F.lit(1)).alias("n_parts"), F.sum("size").alias("bytes"))
    got = catalog.QUERIES["tf_roundtrip"](spark, sf)
    assert sorted(map(tuple, got.drop("digest").collect())) == sorted(map(tuple, want.collect()))


def test_every_announcement_and_frame_is_asked(spark, sf):
    status = catalog.QUERIES["as_of_status"](spark, sf)
    assert status.count() == v.stf_info(spark, sf).count()
    sizes = [r.tf_size for r in complete.status(v.stf_info(spark, sf), v.N_SENDERS).collect()]
    free = {r.s_suppkey: round(abs(r.s_acctbal)) * 100 for r in v.table(spark, sf, "supplier").collect()}
    got = {r.worker: r.n_fit for r in catalog.QUERIES["worker_admission"](spark, sf).collect()}
    assert got == {w: sum(x <= most for x in sizes) for w, most in free.items()}


def test_parts_grow_in_number_with_the_table(spark, sf, monkeypatch):
    monkeypatch.setattr(tables, "PART_ROWS", 500)
    n = v.table(spark, sf, "lineitem").count()
    for name in ("interval_merge", "region_lookup", "txg_coalesce", "txg_locate"):
        sizes = [r["count"] for r in catalog.QUERIES[name](spark, sf).groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) >= n // 500 and max(sizes) < 1000


def test_located_keeps_parts_of_unknown_frames(spark):
    rows = [(None, 1, 100, 50, 0), (None, 1, 200, 50, 0), (None, 1, 20_000, 50, 0), (7, 1, 64, 10, 0), (7, 1, 9_000, 10, 1), (7, 1, 9_100, 0, 1)]
    got = transfer.located(spark.createDataFrame(rows, "tf_id long, sender long, addr long, len long, region long"))
    assert sorted(((r.tf_id or 0), r.addr, r.offset) for r in got.collect()) == [(0, 100, 0), (0, 200, 100), (0, 20_000, 0), (7, 64, 0), (7, 9_000, 0)]
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_sidecar(spark):
    values = {c.lower(): 1 for c in sidecar.WIDTHS} | {"origin": "TPC", "desc": "CLUSTERS"}
    line = sidecar.lines(spark.createDataFrame([values])).first().line
    assert line.startswith("1          1          1         TPC    CLUSTERS  0x00000001 1 ") and len(sidecar.title()) > 150


def test_streams_give_every_page(spark, sf):
    n, size = v.hbf(spark, sf).agg(F.count(F.lit(1)), F.sum("size")).first()
    for name, pages in (("stream_topology", "n_pages"), ("stream_build", "n_parts")):
        assert tuple(catalog.QUERIES[name](spark, sf).agg(F.sum(pages), F.sum("size")).first()) == (n, size)


def test_streams(spark):
    pages = spark.createDataFrame([(i % 2, i, i // 10, 5, i % 10 >= 8) for i in range(60)], "sender long, seq long, tf_id long, size long, last_tf boolean")
    got = replay.replayed(pages, "seq", lambda x: builders.sub_time_frames(x, 3_600_000), 3)
    assert sorted((r.sender, r.tf_id, r.n_parts, r.closed_by) for r in got.collect()) == [(s, t, 5, "flag") for s in (0, 1) for t in range(6)]
    updates = spark.createDataFrame([(1, 0, "run"), (1, 1, "run"), (2, 2, "run"), (1, 3, "leave"), (1, 4, "run")], "worker long, seq long, state string")
    got = replay.replayed(updates, "seq", lambda x: builders.heartbeats(x, 3_600_000), 1)
    assert sorted(tuple(r) for r in got.collect()) == [(1, "joined"), (1, "joined"), (1, "left"), (2, "joined")]
    asked = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, 1, 2)], "tf_id long, sender long, s long").withColumn("at", F.timestamp_seconds("s"))
    assert replay.replayed(asked, "s", lambda x: builders.once(x, "at", ["tf_id", "sender"]), 1).count() == 2


def test_channel_errors(spark):
    rows = [(1, 0, 0, 1, True), (1, 1, 0, 1, True), (1, 2, 1, 3, False), (1, 3, 0, 1, False), (2, 0, 0, 1, False), (2, 1, 0, 1, False), (3, 0, 0, 1, True), (3, 1, 0, 1, True), (3, 2, 0, 5, False), (3, 3, 0, 5, False)]
    got = build.decoded_channel(spark.createDataFrame(rows, "tf_id long, at long, split_index long, split_parts long, stf_header boolean")).orderBy("tf_id", "place").collect()
    assert [(r.tf_id, r.place, r.kind, r.error) for r in got] == [(1, 0, "stf_header", None), (1, 1, "reduced_split", "split_index"), (2, 0, "single", None), (2, 1, "none", "no_header"), (3, 0, "stf_header", None), (3, 1, "full_split", "too_short")]


def test_channel_of_one_long_frame(spark):
    """A list of 400,000 messages in one frame: time that grows with its square would take hours."""
    n = 200_000
    x = spark.range(2 * n).select(F.lit(1).cast("long").alias("tf_id"), F.col("id").alias("at"), F.lit(0).cast("long").alias("split_index"), F.lit(1).cast("long").alias("split_parts"), (F.col("id") == 0).alias("stf_header"))
    began = time.time()
    got = build.decoded_channel(x).agg(F.count(F.lit(1)), F.max("place"), F.max("at"), F.count("error")).first()
    assert tuple(got) == (n, n - 1, 2 * n - 2, 0) and time.time() - began < 60


def test_channel_of_unknown_frames_and_gaps(spark):
    rows = [(None, 0, 0, 1, True), (None, 1, 0, 1, True), (2, 0, 0, 1, True), (2, 1, 0, 1, True), (2, 1, 0, 2, False), (2, 5, 0, 1, False), (3, 4, 0, 1, True), (4, None, 0, 1, True), (4, 0, None, 2, False), (4, 1, 0, None, False)]
    got = build.decoded_channel(spark.createDataFrame(rows, "tf_id long, at long, split_index long, split_parts long, stf_header boolean")).collect()
    want = [(0, 0, 0, "stf_header", None), (2, 0, 0, "stf_header", None), (3, 0, 1, "none", "no_header"), (4, 0, 0, "reduced_split", "split_index"), (4, 1, 3, "none", "no_header")]
    assert sorted(((r.tf_id or 0), r.place, r.at, r.kind, r.error) for r in got) == want


class State:
    """State of one key, with a clock that the test moves on."""

    def __init__(self):
        self.value, self.at, self.hasTimedOut, self.now = None, None, False, 0

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutDuration(self, ms):
        self.at = self.now + ms

    def getCurrentProcessingTimeMs(self):
        return self.now

    def run(self, step, rows=(), names=()):
        self.hasTimedOut = not rows
        out = [tuple(r) for b in step((1,), [pd.DataFrame(rows, columns=names)] if rows else [], self) for r in b.itertuples(index=False)]
        return [tuple(None if x is pd.NA else x for x in r) for r in out]


def test_frames_close_when_idle():
    s, step, names = State(), builders.building(2000), ["seq", "tf_id", "size", "last_tf"]
    assert s.run(step, [(0, 7, 10, False), (1, 7, 5, False)], names) == [] and s.at == 2000
    assert s.run(step) == [(1, 7, 2, 15, "idle")] and s.run(step) == []
    assert s.run(step, [(2, 7, 1, True), (3, 6, 1, True)], names) == [(1, 7, 1, 1, "flag")]


def test_pages_after_a_stop_are_discarded():
    s, step, names = State(), builders.building(2000), ["seq", "tf_id", "size", "last_tf", "running"]
    assert s.run(step, [(0, 7, 10, False, True), (1, 7, 5, True, False), (2, 8, 3, True, True)], names) == [(1, 8, 1, 3, "flag")]


def test_windows_close_when_idle():
    s, step, names = State(), builders.windowing(3, 500), ["seq", "size"]
    assert s.run(step, [(i, 1) for i in range(4)], names) == [(1, 0, 3, 3, 0, 2)] and s.at == 500
    assert s.run(step) == [(1, 1, 1, 1, 3, 3)] and s.run(step) == []


def test_workers_expire():
    s, step, names = State(), builders.watching(5000), ["seq", "state"]
    assert s.run(step, [(0, "run")], names) == [(1, "joined")]
    s.now = 3000
    assert s.run(step, [(1, "run")], names) == [] and s.at == 8000
    assert s.run(step) == [(1, "expired")] and not s.exists
    assert s.run(step, [(2, "run"), (3, "leave")], names) == [(1, "joined"), (1, "left")]


def test_frames_get_stale_and_runs_start_afresh():
    s, step, names = State(), completing(2, 750), ["run", "seq", "tf_id", "sender", "stf_size"]
    assert s.run(step, [(1, 0, 5, 0, 10)], names) == [] and s.at == 750
    s.now = 700
    assert s.run(step, [(1, 1, 6, 0, 10)], names) == []
    s.now = 751
    assert s.run(step) == [(1, 5, None, 1, 10, False, "stale")]
    assert [r[-1] for r in s.run(step, [(1, 2, 5, 1, 1)], names)] == ["late"]
    assert s.run(step, [(2, 3, 5, 0, 1), (1, 4, 9, 1, 1), (2, 5, 5, 1, 1)], names) == [(1, 9, 4, 1, 1, False, "old_run"), (2, 5, 5, 2, 2, True, "built")]
    half, step = State(), completing(1, 750, 50)
    got = half.run(step, [(1, i, i, 0, 1) for i in range(400)], names)
    assert {r[-1] for r in got} == {"built", "throttled"} and 150 < sum(r[-1] == "built" for r in got) < 250


def test_header_stacks():
    one = lambda more, n=0: tf_format.pack_header(n, "RAWDATA", "TPC", 7, more=more)
    assert tf_format.unpack_stack(one(True, 3) + one(True) + one(False) + b"abc", 0) | {"x": 0} == tf_format.unpack_header(one(True, 3), 0) | {"size": 3 * 96, "n_headers": 3, "x": 0}
    assert tf_format.unpack_stack(one(True) * 15 + one(False), 0)["n_headers"] == 16
    with pytest.raises(ValueError):
        tf_format.unpack_stack(one(True) * 16 + one(False), 0)
    data = bytearray(tf_format.encode(3, 500, 768, PARTS[:1]))
    at = len(data) - 96 - 3
    both = bytes(data[:at]) + one(True, 3) + one(False) + b"abc"
    whole = struct.pack("<QQQ", 1, len(both), 0)
    both = both[:96] + whole + both[96 + 24 :]
    assert [(r["payload"], r["origin"]) for r in tf_format.decode(both)] == [(b"abc", "TPC")]
    old = bytearray(one(False, 5))
    old[8:12] = struct.pack("<I", 1)
    assert tf_format.unpack_header(bytes(old), 0)["tf_id"] == 0


def test_old_headers_have_their_own_layout(spark):
    df = spark.range(1).select(headers.header({"version": F.lit(4), "orbit": F.lit(77), "trigger_orbit": F.lit(5), "stop_bit": F.lit(1), "memory_size": F.lit(64)}, 4).alias("b"))
    got = df.select(headers.any_field(F.col("b"), "orbit").alias("o"), headers.field(F.col("b"), "trigger_orbit", 0, 4).alias("t"), headers.field(F.col("b"), "orbit").alias("wrong")).first()
    assert tuple(got) == (77, 5, 5) and headers.walk(bytes(df.first().b))[0]["orbit"] == 77


def test_run_folders(tmp_path):
    now = time.struct_time((2024, 5, 6, 7, 8, 9, 0, 127, 0))
    names = [tf_files.run_folder(str(tmp_path), "500", now) for _ in range(3)]
    assert [n.split("/")[-1] for n in names] == ["run0500_2024-05-06__07_08_09", "run0500_2024-05-06__07_08_09_1", "run0500_2024-05-06__07_08_09_2"]
    assert all((tmp_path / n.split("/")[-1]).is_dir() for n in names)
    with pytest.raises(ValueError):
        tf_files.run_folder(str(tmp_path / "no"), "1")


def test_listed_files_are_fetched(spark, tmp_path):
    paths = []
    for i in range(6):
        paths.append(tmp_path / f"a{i}.tf")
        if i not in (1, 3):
            paths[-1].write_bytes(tf_format.encode(i, 1, 0, PARTS[:1]))
    files = spark.createDataFrame([(i, str(p)) for i, p in enumerate(paths)], "number long, path string")
    got = {r.number: (r.ok, r.used) for r in tf_files.copied(files, "cp ?src ?dst").collect()}
    assert got == {i: (i not in (1, 3),) * 2 for i in range(6)}
    assert sorted(r.tf_id for r in tf_files.read_copied(files, "cp ?src ?dst").collect()) == [0, 2, 4, 5]
    assert sorted(r.tf_id for r in tf_files.read_copied(files, "cp ?src ?dst", 2).collect()) == [0, 2]


def test_metrics_of_batches(spark):
    seen = BatchMetrics()
    spark.streams.addListener(seen)
    try:
        pages = spark.createDataFrame([(1, i, i, 5, True) for i in range(8)], "sender long, seq long, tf_id long, size long, last_tf boolean")
        replay.replayed(pages, "seq", lambda x: builders.sub_time_frames(x, 3_600_000), 2).count()
        for _ in range(50):
            if len(seen.rows) >= 2:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(seen)
    assert sum(r.n_rows for r in seen.table(spark).collect()) == 8


def test_rotation_by_size(spark, tmp_path):
    rows = [(t, 1, 0, "RAWDATA", "TPC", 7, 0, 0, b"x" * 1000) for t in range(6)]
    schema = "tf_id long, run long, first_orbit long, description string, origin string, subspec long, message long, split_index int, payload binary"
    df = spark.createDataFrame(rows, schema).coalesce(1)
    tf_files.write_tf(df, str(tmp_path), max_bytes=2000, sample=100)
    sizes = [p.stat().st_size for p in tmp_path.glob("*.tf")]
    assert sum(sizes) > 6000 and all(n < 4000 for n in sizes) and len(tf_files.read_tf(spark, str(tmp_path)).collect()) == 6
    names = [r.name for r in tf_files.listed(spark.createDataFrame([("/x/b2.tf",), ("/y/a10.tf",), ("/z/a9.tf",)], "path string")).collect()]
    assert names == sorted(names)
