"""The completer as a stream: announcements in, time frames out.

State is held for each run (or partition of the detector): what each sender announced last, and the frames that are open. It doesn't
grow with the run, since frames leave it when they are given out, dropped or stale.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

OUT = "run long, tf_id long, emit_seq long, n_senders long, tf_size long, complete boolean, outcome string"
COLUMNS = [c.split()[0] for c in OUT.split(", ")]


class Completer:
    """Rules for one run. A frame is given out when all its senders have announced it, or can't any more.

    A sender that goes on to a later frame leaves a blank in those before, which fills its place: a later real announcement for it
    is ignored. When a frame fills up, all open frames up to it are given out, in order. Announcements of frames at or below the highest given
    out are late. The first announcement of a sender counts. Of frames not seen yet, a share of `percent` is taken and others are throttled, all
    senders' alike. An announcement of a higher run starts everything afresh, one of a lower run is refused.
    """

    def __init__(self, senders: int, percent: float = 100, run: int | None = None):
        self.senders, self.percent, self.run, self.last, self.open, self.since, self.done = senders, percent, run, {}, {}, {}, -1

    def announce(self, tf: int, sender: int, size: int, seq: int, now: float = 0.0, run: int | None = None) -> Iterator[tuple]:
        if run is not None and run != self.run:
            if self.run is not None and run < self.run:
                yield tf, seq, 1, size, False, "old_run"
                return
            self.restart(run)
        if (tf * 7919 + 104729) % 10007 >= self.percent * 10007 / 100:
            yield tf, seq, 1, size, False, "throttled"
            return
        self.last[sender] = max(self.last.get(sender, -1), tf)
        if tf <= self.done:
            yield tf, seq, 1, size, False, "late"
            return
        new = tf not in self.open
        frame = self.open.setdefault(tf, {})
        if new:
            self.since[tf] = now
        if sender in frame:
            if frame[sender] is not None:
                yield tf, seq, 1, size, False, "repeated"
            return
        frame[sender] = size
        full = tf if len(frame) == self.senders else None
        if full is None:
            for below in sorted((t for t in self.open if t < tf), reverse=True):
                if sender in self.open[below]:
                    break
                self.open[below][sender] = None
                if len(self.open[below]) == self.senders:
                    full = below if full is None else max(full, below)
            if new:
                for s, t in self.last.items():
                    if t > tf:
                        frame.setdefault(s, None)
                full = tf if len(frame) == self.senders else full
        if full is not None:
            yield from self.give_out(full, seq)

    def give_out(self, upto: int, seq: int | None, outcome: str = "built") -> Iterator[tuple]:
        for t in sorted(t for t in self.open if t <= upto):
            real = [z for z in self.open.pop(t).values() if z is not None]
            self.since.pop(t)
            self.done = max(self.done, t)
            yield t, seq, len(real), sum(real), len(real) == self.senders, outcome

    def stale(self, now: float, timeout: float) -> Iterator[tuple]:
        """Frames whose first announcement is older than the timeout, counted from that one, whatever else is open."""
        for t in sorted(t for t, at in self.since.items() if now - at > timeout):
            real = [z for z in self.open.pop(t).values() if z is not None]
            self.since.pop(t)
            self.done = max(self.done, t)
            yield t, None, len(real), sum(real), len(real) == self.senders, "stale"

    def restart(self, run: int | None = None) -> None:
        self.__init__(self.senders, self.percent, run)


def completing(senders: int, timeout_ms: int, percent: float = 100) -> Callable:
    """What completed() does with the state of one key."""

    def step(key: tuple, batches: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        c = Completer(senders, percent)
        vars(c).update(pickle.loads(state.get[0]) if state.exists else {})
        out: list = []
        now = state.getCurrentProcessingTimeMs()
        if not state.hasTimedOut:
            rows = pd.concat(list(batches)).sort_values("seq")
            for r in rows.itertuples():
                out += [(int(r.run), *x) for x in c.announce(int(r.tf_id), int(r.sender), int(r.stf_size), int(r.seq), now, int(r.run))]
        out += [(c.run, *x) for x in c.stale(now, timeout_ms)]
        state.update((pickle.dumps(vars(c)),))
        if c.open:
            state.setTimeoutDuration(timeout_ms)
        if out:
            yield pd.DataFrame(out, columns=COLUMNS).astype({"emit_seq": "Int64"})

    return step


def completed(info: DataFrame, senders: int, timeout_ms: int = 60_000, percent: float = 100, key: str = "run") -> DataFrame:
    """Outcomes for a stream of (run, seq, tf_id, sender, stf_size): built, stale, late, repeated, throttled or old_run. Rows of one batch are taken by seq.

    key: by what there is a state; where it is a partition of the detector, a higher run in it starts the state afresh.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    return info.groupBy(key).applyInPandasWithState(completing(senders, timeout_ms, percent), OUT, "c binary", "append", GroupStateTimeout.ProcessingTimeTimeout)
