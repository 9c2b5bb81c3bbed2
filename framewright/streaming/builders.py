"""Sub time frames from a stream of pages, by id and by count; retries, heartbeats, request and receipt."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _state(state, start):
    return pickle.loads(state.get[0]) if state.exists else start


def building(timeout_ms: int) -> Callable:
    """What sub_time_frames() does with the state of one sender."""
    columns = ["sender", "tf_id", "n_parts", "size", "closed_by"]

    def step(key: tuple, batches: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now, out = _state(state, None), []
        if state.hasTimedOut:
            if now and now[1]:
                out.append((key[0], *now, "idle"))
                now = [now[0], 0, 0]
        else:
            for r in pd.concat(list(batches)).sort_values("seq").itertuples():
                if not getattr(r, "running", True):
                    now = [now[0], 0, 0] if now else now
                    continue
                if now is not None and r.tf_id < now[0]:
                    continue
                if now is None or r.tf_id > now[0]:
                    if now and now[1]:
                        out.append((key[0], *now, "next"))
                    now = [int(r.tf_id), 0, 0]
                now[1], now[2] = now[1] + 1, now[2] + int(r.size)
                if r.last_tf:
                    out.append((key[0], *now, "flag"))
                    now = [now[0], 0, 0]
        state.update((pickle.dumps(now),))
        if now and now[1]:
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(out, columns=columns)

    return step


def sub_time_frames(pages: DataFrame, timeout_ms: int = 2000) -> DataFrame:
    """(sender, tf_id, n_parts, size, closed_by): frames of each sender, closed by a page with last_tf, by a page of another frame, or when idle.

    Input: (sender, seq, tf_id, size, last_tf), and running if there is this column: after a stop, pages and the open frame are discarded.
    Pages of a frame below the one being received are refused.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    return pages.groupBy("sender").applyInPandasWithState(building(timeout_ms), "sender long, tf_id long, n_parts long, size long, closed_by string", "s binary", "append", GroupStateTimeout.ProcessingTimeTimeout)


def windowing(n: int, timeout_ms: int) -> Callable:
    """What topology_frames() does with the state of one source."""
    columns = ["subspec", "window", "n_pages", "size", "first_seq", "last_seq"]

    def step(key: tuple, batches: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        (window, held), out = _state(state, (0, None)), []
        if state.hasTimedOut:
            if held:
                out.append((key[0], window, *held))
                window, held = window + 1, None
        else:
            for r in pd.concat(list(batches)).sort_values("seq").itertuples():
                held = [held[0] + 1, held[1] + int(r.size), held[2], int(r.seq)] if held else [1, int(r.size), int(r.seq), int(r.seq)]
                if held[0] == n or getattr(r, "last", False):
                    out.append((key[0], window, *held))
                    window, held = window + 1, None
        state.update((pickle.dumps((window, held)),))
        if held:
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(out, columns=columns)

    return step


def topology_frames(pages: DataFrame, n: int = 128, timeout_ms: int = 500) -> DataFrame:
    """(subspec, window, n_pages, size, first_seq, last_seq): windows of n pages of each source; what is left over comes at a page with `last` (if there is this column) or when idle."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    return pages.groupBy("subspec").applyInPandasWithState(windowing(n, timeout_ms), "subspec long, window long, n_pages long, size long, first_seq long, last_seq long", "s binary", "append", GroupStateTimeout.ProcessingTimeTimeout)


def watching(timeout_ms: int) -> Callable:
    """What heartbeats() does with the state of one worker."""

    def step(key: tuple, batches: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        events = []
        if state.hasTimedOut:
            events.append("expired")
            state.remove()
        else:
            here = state.exists
            for r in pd.concat(list(batches)).sort_values("seq").itertuples():
                if r.state == "leave":
                    events += ["left"] * here
                    here = False
                elif not here:
                    events.append("joined")
                    here = True
            if here:
                state.update((True,))
                state.setTimeoutDuration(timeout_ms)
            elif state.exists:
                state.remove()
        yield pd.DataFrame([(key[0], e) for e in events], columns=["worker", "event"])

    return step


def heartbeats(updates: DataFrame, timeout_ms: int = 5000) -> DataFrame:
    """(worker, event): joined at the first update, left at one with state 'leave', expired when none comes in time."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    return updates.groupBy("worker").applyInPandasWithState(watching(timeout_ms), "worker long, event string", "here boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)


def once(requests: DataFrame, at: str, keys: list[str], delay: str = "1 minute") -> DataFrame:
    """Requests without their retries: the first within the delay is answered."""
    return requests.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def fetched(requests: DataFrame, receipts: DataFrame, delay: str = "1 minute") -> DataFrame:
    """Streams of (tf_id, sender, requested) and (tf_id, sender, received) joined within the delay: how long each fetch took."""
    a = requests.withWatermark("requested", delay).alias("a")
    b = receipts.withWatermark("received", delay).alias("b")
    on = F.expr(f"a.tf_id = b.tf_id and a.sender = b.sender and b.received >= a.requested and b.received <= a.requested + interval {delay}")
    return a.join(b, on).select("a.tf_id", "a.sender", "requested", "received")
