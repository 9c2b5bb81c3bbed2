"""Assigning time frames to workers: ordered folds over requests, closed forms where there are any."""

from __future__ import annotations

from bisect import insort
from collections import OrderedDict, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions.scalar import id_list, json_map
from framewright.operators.ordered import ranked


def first_fit(requests: DataFrame, workers: dict[int, int], most_in_building: int = 5, built_after: int = 4, forwarded_after: int = 0, run: str = "run") -> DataFrame:
    """(tf_id, worker, reason): frames in order, each to the first ready worker that has room for a fifth more than its size.

    A worker that is chosen goes to the end of the row. One is passed over if it builds most_in_building frames, has too little
    free memory, or has over 8 frames buffered and not four times the room. Reasons: no_worker if there is none; too_many_frames if any
    was passed over for that; else no_memory. Here a frame is built built_after requests after it was assigned, is buffered from then on, and
    forwarded_after requests later its memory is free again. Each run is folded on its own, in the order of seq; only the workers' state is held.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: OrderedDict = OrderedDict()
        building: deque = deque()
        buffered: deque = deque()
        now = None
        for b in batches:
            out = []
            for r, seq, tf, size in zip(b[run], b["seq"], b["tf_id"], b["tf_size"], strict=True):
                if r != now:
                    now, building, buffered = r, deque(), deque()
                    state = OrderedDict((w, {"free": free, "building": 0, "buffered": 0}) for w, free in sorted(workers.items()))
                while building and building[0][0] <= seq:
                    at, w, need = building.popleft()
                    state[w]["building"] -= 1
                    state[w]["buffered"] += 1
                    buffered.append((at + forwarded_after, w, need))
                while buffered and buffered[0][0] <= seq:
                    _, w, need = buffered.popleft()
                    state[w]["buffered"] -= 1
                    state[w]["free"] += need
                need = size * 120 // 100
                too_many = False
                for w, x in state.items():
                    if x["building"] >= most_in_building:
                        too_many = True
                    elif x["free"] >= need and (x["buffered"] <= 8 or x["free"] >= 4 * need):
                        x["free"] -= need
                        x["building"] += 1
                        state.move_to_end(w)
                        building.append((seq + built_after, w, need))
                        out.append((r, tf, w, "ok"))
                        break
                else:
                    out.append((r, tf, None, "no_worker" if not state else "too_many_frames" if too_many else "no_memory"))
            yield pd.DataFrame(out, columns=[run, "tf_id", "worker", "reason"]).astype({"worker": "Int64"})

    x = requests.select(run, "seq", "tf_id", "tf_size").repartition(run).sortWithinPartitions(run, "seq")
    return x.mapInPandas(fold, f"{run} long, tf_id long, worker long, reason string")


def sticky(topo: DataFrame, n_workers: int, order: str = "seq") -> DataFrame:
    """Each source keeps the worker it was given first: the least used, so in turn by first appearance."""
    first = topo.groupBy("origin", "subspec").agg(F.min(order).alias("first_seq"))
    return ranked(first, "place", "first_seq").select("origin", "subspec", (F.col("place") % n_workers).alias("worker"))


def ledger(events: DataFrame, order: str = "seq") -> DataFrame:
    """Free memory of each worker after every event: building takes, forwarding gives back; and the highest frame built."""
    w = Window.partitionBy("worker").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    signed = F.when(F.col("kind") == "built", -F.col("size")).otherwise(F.col("size"))
    return events.withColumns({"balance": F.sum(signed).over(w), "last_built": F.max(F.when(F.col("kind") == "built", F.col("tf_id"))).over(w)})


def by_size(requests: DataFrame) -> DataFrame:
    """A frame's requests, smallest first, so the largest comes last."""
    return requests.withColumn("place", F.row_number().over(Window.partitionBy("tf_id").orderBy("stf_size", "sender")) - 1)


def partition_state(senders: DataFrame, n_senders: int, order: str = "seq") -> DataFrame:
    """(seq, ready, state) after every status message: configured when all senders are ready, error if one fails, terminating and terminated last."""
    w = Window.partitionBy("partition").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    x = senders.withColumns({"ready": F.size(F.collect_set(F.when(F.col("status") == "ready", F.col("sender"))).over(w)), "failed": F.max((F.col("status") == "failed").cast("int")).over(w), "ending": F.max((F.col("status") == "terminate").cast("int")).over(w)})
    state = F.when(F.col("failed") == 1, "error").when(F.col("ending") == 1, "terminating").when(F.col("ready") >= n_senders, "configured").otherwise("configuring")
    return x.withColumn("state", state).drop("failed", "ending")


class Tokens:
    """Transfer tokens of the senders, numbered from 1: a base token of each, and extra ones while some of its `per_sender` are left.

    A request names the senders that are wanted. It gets the base token of one of them, else an extra one, else none (0). Which of
    several is a matter of `draw`. Base tokens come back when all of a sender's are returned; a reset gives everything back.
    """

    def __init__(self, n_senders: int, per_sender: int = 2):
        self.n, self.per_sender = n_senders, max(1, per_sender)
        self.reset()

    def reset(self) -> None:
        every = range(1, self.n + 1)
        self.left = dict.fromkeys(every, self.per_sender)
        self.base, self.extra = set(every), set(every) if self.per_sender > 1 else set()

    def request(self, wanted: set[int], draw: int) -> tuple[int, str]:
        for kind, free in (("base", self.base), ("extra", self.extra if self.per_sender > 1 else set())):
            found = sorted(wanted & free)
            if found:
                got = found[draw % len(found)]
                self.left[got] -= 1
                self.base.discard(got)
                if not self.left[got]:
                    self.extra.discard(got)
                return got, kind
        return 0, "none"

    def release(self, token: int) -> None:
        self.left[token] = min(self.per_sender, self.left[token] + 1)
        self.extra.add(token)
        if self.left[token] == self.per_sender:
            self.base.add(token)


def tokens(requests: DataFrame, n_senders: int, per_sender: int = 2, hold: int = 3, lease: int = 1000, run: str = "run") -> DataFrame:
    """(run, tick, worker, wanted, token, kind): workers fetch from the senders they want, one request at each tick, in turn.

    requests: (run, worker, wanted array<int>). A worker that gets a token fetches from its sender and wants it no more; it
    gives the token back `hold` ticks later. One that gets none asks again at the next tick. After `lease` ticks all tokens are back, so those
    of failed workers aren't lost. The draw is an arithmetic hash of tick and worker. A run's tokens are one state, folded in order.
    """
    columns = [run, "tick", "worker", "wanted", "token", "kind"]

    def fold(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        left = {int(w): {int(x) for x in s if 1 <= x <= n_senders} for w, s in sorted(zip(rows["worker"], rows["wanted"], strict=True), key=lambda r: r[0])}
        state, due, out, tick = Tokens(n_senders, per_sender), deque(), [], 0
        while any(left.values()):
            if tick and tick % lease == 0:
                state.reset()
                due.clear()
            while due and due[0][0] <= tick:
                state.release(due.popleft()[1])
            for w, wanted in left.items():
                if wanted:
                    got, kind = state.request(wanted, (tick * 31 + w) * 7919 % 10007)
                    out.append((keys[0], tick, w, len(wanted), got, kind))
                    if got:
                        wanted.discard(got)
                        due.append((tick + hold, got))
            tick += 1
        return pd.DataFrame(out, columns=columns)

    return requests.groupBy(run).applyInPandas(fold, f"{run} long, tick long, worker long, wanted long, token long, kind string")


def keep_within(stfs: DataFrame, room: int, target_percent: int = 95) -> DataFrame:
    """What stays in each sender's buffer: the highest ids are given up until no more than the target, a share of `room`, is held."""
    w = Window.partitionBy("sender").orderBy("tf_id").rowsBetween(Window.unboundedPreceding, 0)
    return stfs.withColumn("held", F.sum("stf_size").over(w)).withColumn("kept", F.col("held") <= room * target_percent // 100)


def keep_drawn(stfs: DataFrame, room: int, delete_percent: int = 25, target_percent: int = 95) -> DataFrame:
    """(sender, tf_id, seq, fate, until): what becomes of every sub time frame in its sender's buffer when there is no worker, and at which arrival.

    At each arrival, by seq: while more than the target is held, the highest id goes ('target'); by a draw of 0 to 99 that is no more than
    delete_percent, the highest goes ('highest'); by one no more than a quarter of that, one of the lower half goes ('drawn'); then the new one
    comes in, if its id isn't held ('repeated'). What is left at the end is 'held' (until is null). Draws are arithmetic hashes of sender and
    seq. Senders are folded on their own, in order; only what the buffer holds is in memory.
    """
    percent, target = min(100, max(0, delete_percent)), room * target_percent // 100
    columns = ["sender", "tf_id", "seq", "fate", "until"]

    def draw(sender: int, seq: int, k: int) -> int:
        return (seq * 7919 + sender * 104729 + k * 3571) % 10007 % 100

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, ids, held, used, out = None, [], {}, 0, []

        def drop(place: int, fate: str, at: int) -> int:
            tf = ids.pop(place)
            seq, size = held.pop(tf)
            out.append((now, tf, seq, fate, at))
            return size

        for b in batches:
            for sender, seq, tf, size in zip(b["sender"], b["seq"], b["tf_id"], b["stf_size"], strict=True):
                if sender != now:
                    out += [(now, t, held[t][0], "held", None) for t in ids]
                    now, ids, held, used = sender, [], {}, 0
                while ids and used > target:
                    used -= drop(-1, "target", seq)
                if ids and draw(sender, seq, 0) <= percent:
                    used -= drop(-1, "highest", seq)
                if ids and draw(sender, seq, 1) <= percent // 4:
                    used -= drop(len(ids) * draw(sender, seq, 2) // 200, "drawn", seq)
                if tf in held:
                    out.append((sender, tf, seq, "repeated", seq))
                else:
                    insort(ids, tf)
                    held[tf] = (seq, size)
                    used += size
            yield pd.DataFrame(out, columns=columns).astype({"until": "Int64"})
            out.clear()
        if ids:
            yield pd.DataFrame([(now, t, held[t][0], "held", None) for t in ids], columns=columns).astype({"until": "Int64"})

    x = stfs.select("sender", "seq", "tf_id", "stf_size").repartition("sender").sortWithinPartitions("sender", "seq")
    return x.mapInPandas(fold, "sender long, tf_id long, seq long, fate string, until long")


def next_request(requests: DataFrame) -> DataFrame:
    """For each frame the sender to ask next: the largest (linear), and one drawn in proportion to size by a hash of the frame (weighted)."""
    w = Window.partitionBy("tf_id").orderBy("sender").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("tf_id")
    x = requests.withColumns({"upto": F.sum("stf_size").over(w), "total": F.sum("stf_size").over(every)})
    at = F.pmod(F.col("tf_id") * 7919 + 104729, F.greatest(F.col("total"), F.lit(1)))
    x = x.withColumn("hit", (at < F.col("upto")) & (at >= F.col("upto") - F.col("stf_size")))
    return x.groupBy("tf_id").agg(F.max_by("sender", F.struct("stf_size", "sender")).alias("linear"), F.min(F.when(F.col("hit"), F.col("sender"))).alias("weighted"))


def worker_updates(updates: DataFrame) -> DataFrame:
    """(worker, ready, free): what is known of each worker after its updates (worker, seq, state, last_built, last_scheduled, free_memory).

    A worker joins with its first update, also after it has left, and its reported memory is taken. Later, the report is taken if it has built
    the last frame that it was given; if it has not yet, the least of report and estimate; if it is ahead of the record, the estimate stays. A worker
    whose last update isn't 'running' is gone. Sums by worker only: no update is kept.
    """
    x = updates.groupBy("worker").agg(F.max(F.when(F.col("state") != "running", F.col("seq"))).alias("left"), F.max("seq").alias("last"))
    here = updates.join(x, "worker").where(F.col("left").isNull() | (F.col("seq") > F.col("left")))
    y = here.groupBy("worker").agg(F.min("seq").alias("joined"), F.max(F.when(F.col("last_built") == F.col("last_scheduled"), F.col("seq"))).alias("built"))
    y = y.select("worker", F.greatest("joined", "built").alias("since"))
    z = updates.join(y, "worker").where((F.col("seq") == F.col("since")) | ((F.col("seq") > F.col("since")) & (F.col("last_built") < F.col("last_scheduled"))))
    free = z.groupBy("worker").agg(F.min("free_memory").alias("free"))
    return x.join(free, "worker", "left").select("worker", F.col("free").isNotNull().alias("ready"), "free")


def partition_requests(requests: DataFrame) -> DataFrame:
    """Requests with their senders as a sorted list and `valid`: an id that isn't blank, a time of creation, and senders that are named once."""
    ids = id_list(F.col("senders"))
    ok = (F.length(F.trim("partition_id")) > 0) & F.col("created").isNotNull() & ids.isNotNull()
    return requests.select("seq", "partition_id", F.array_join(ids, ",").alias("sender_list"), F.size(json_map(F.col("parameters"))).alias("n_parameters"), F.coalesce(ok, F.lit(False)).alias("valid"))


# What a request's keys end with.
ID_KEY, CREATED_KEY, SENDERS_KEY, TIME_KEY = "partition-id", "request-create-time", "stf-sender-id-list", "request-time"


def filed_requests(items: DataFrame, now: str, requests: str = "requests/", valid: str = "partitions/", invalid: str = "invalid/") -> DataFrame:
    """(old_key, new_key, value, valid): how a store of (key, value) changes when its partition requests are read.

    Keys are requests/<folder>/<field>. A folder of three or more keys is moved: with a valid request (see partition_requests) below
    partitions/<id>, else below invalid/<now>/<folder>; the old key is to be erased, and the time of reading is a key more (old_key null). A
    folder of fewer keys is not finished and stays; other keys of the store give no row.
    """
    rest = F.substring(F.col("key"), len(requests) + 1, 1 << 30)
    x = items.where(F.col("key").startswith(requests)).select("key", "value", F.substring_index(rest, "/", 1).alias("folder"))
    x = x.withColumn("field", F.expr(f"substring(key, {len(requests) + 2} + length(folder))"))
    of = lambda k: F.max(F.when(F.col("field") == k, F.col("value")))
    y = x.groupBy("folder").agg(F.count(F.lit(1)).alias("n"), of(ID_KEY).alias("id"), of(CREATED_KEY).alias("created"), of(SENDERS_KEY).alias("senders")).where("n >= 3")
    ok = F.coalesce((F.length(F.trim("id")) > 0) & F.col("created").isNotNull() & id_list(F.col("senders")).isNotNull(), F.lit(False))
    y = y.select("folder", ok.alias("valid"), F.when(ok, F.concat(F.lit(valid), F.trim("id"))).otherwise(F.concat(F.lit(f"{invalid}{now}/"), "folder")).alias("to"))
    moved = x.join(y, "folder").select(F.col("key").alias("old_key"), F.concat_ws("/", "to", "field").alias("new_key"), "value", "valid")
    read = y.select(F.lit(None).cast("string").alias("old_key"), F.concat_ws("/", "to", F.lit(TIME_KEY)).alias("new_key"), F.lit(now).alias("value"), "valid")
    return moved.unionByName(read)
