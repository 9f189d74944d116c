"""The receive protocol over streams: one state a chain, exactly-once verdicts over at-least-once delivery."""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from twinloom.streaming import ready

OUT = "chain_id string, sequence long, verdict string, frontier long, taint_size long, taint_age long, taint_density double"


@dataclass
class State:
    """A chain's bookkeeping: `oldest` is when its first taint came, `asked` whether a recovery has been asked for."""

    frontier: int = 0
    closed: bool = False
    floor: int = 0
    taint: int = 0
    oldest: int | None = None
    asked: bool = False
    hold_at: int | None = None
    silent_at: int | None = None


_STATE = "frontier long, closed boolean, floor long, taint long, oldest long, asked boolean, hold_at long, silent_at long"


class ChainProcessor(StatefulProcessor):
    """Frontier and taint per chain; every row gets one verdict, in the order of arrival.

    Rows have chain_id, sequence, kind (delta, snapshot, terminator), recovery (boolean) and arrival. Verdicts are
    applied, gap (applied past a gap), duplicate, late (discarded, stays tainted), anchor (a recovery snapshot), terminator
    and rejected (after an accepted terminator; one that is late or a duplicate ends nothing). Besides, `recover` is told
    once if the taint's size, density (share of the sequences since the anchor) or age (in units of arrival) exceeds its
    limit, until an anchor comes.

    With `jitter`, rows so far ahead of the next are held back so that slightly late ones come in order. They leave when
    the gap closes, a row further ahead, a terminator or an anchor comes, after `hold_ms` (processing time), or, without
    that, at the end of the batch. `silence_ms` without a row closes a chain (processing time), with the verdict silent,
    unless it is closed already. Taint is kept as ranges, one a gap.
    """

    def __init__(self, max_taint: int | None = None, max_density: float | None = None, max_age: int | None = None, jitter: int = 0, hold_ms: int | None = None, silence_ms: int | None = None):
        self.max_taint, self.max_density, self.max_age = max_taint, max_density, max_age
        self.jitter, self.hold_ms, self.silence_ms = jitter, hold_ms, silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", _STATE)
        self.taint = handle.getMapState("taint", "start long", "stop long")
        self.held = handle.getMapState("held", "sequence long", "kind string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self._begin()
        for r in pd.concat(list(rows)).sort_values("arrival", kind="stable").itertuples(index=False):
            self._receive(int(r.sequence), r.kind, bool(r.recovery), int(r.arrival))
        if self.jitter and self.hold_ms is None:
            self._release(None)
        yield self._end(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._begin()
        s, now = self.now, expiredTimerInfo.getExpiryTimeInMs()
        silent = s.silent_at is not None and now >= s.silent_at
        s.hold_at, s.silent_at = (None if s.hold_at is not None and now >= s.hold_at or silent else s.hold_at), (None if silent else s.silent_at)
        if s.hold_at is None:
            self._release(None)
        if silent and not s.closed:
            s.closed = True
            self._tell(s.frontier, "silent")
        yield self._end(key, None)

    # ------------------------------------------------------------ one chain, one batch

    def _begin(self) -> None:
        self.now = State(*self.state.get()) if self.state.exists() else State()
        self.waiting = {k[0]: v[0] for k, v in self.held.iterator()} if self.jitter else {}
        self.known = set(self.waiting)
        self.ranges: list[tuple[int, int]] | None = None  # read when a row asks for them
        self.new: list[tuple[int, int]] = []
        self.out: list[tuple] = []
        self.at = 0

    def _end(self, key, timerValues) -> pd.DataFrame:
        s = self.now
        for k in self.known - set(self.waiting):
            self.held.removeKey((k,))
        for k in set(self.waiting) - self.known:
            self.held.updateValue((k,), (self.waiting[k],))
        for a, b in self.new:
            self.taint.updateValue((a,), (b,))
        if timerValues is not None and (self.silence_ms is not None or self.hold_ms is not None):
            now = timerValues.getCurrentProcessingTimeInMs()
            old = {s.hold_at, s.silent_at} - {None}
            s.silent_at = now + self.silence_ms if self.silence_ms is not None and not s.closed else None
            s.hold_at = (s.hold_at or now + self.hold_ms) if self.hold_ms is not None and self.waiting else None
            for t in old - {s.hold_at, s.silent_at}:
                self.handle.deleteTimer(t)
            for t in {s.hold_at, s.silent_at} - {None} - old:
                self.handle.registerTimer(t)
        self.state.update(tuple(asdict(s).values()))
        return pd.DataFrame([(key[0], *x) for x in self.out], columns=[c.split()[0] for c in OUT.split(", ")]).astype({"taint_age": "Int64"})

    def _receive(self, k: int, kind: str, recovery: bool, at: int) -> None:
        s, self.at = self.now, at
        if s.closed:
            self._tell(k, "rejected")
        elif recovery:
            for x in sorted(x for x in self.waiting if x <= k):
                del self.waiting[x]
                self._tell(x, "duplicate")  # the snapshot has it
            self._clear()
            s.frontier = s.floor = k
            s.closed = kind == "terminator"
            self._tell(k, "anchor")
            if s.closed:
                self._release(None)
            self._follow()
        elif k <= s.frontier:
            self._tell(k, "late" if k > s.floor and self._tainted(k) else "duplicate")
        elif k in self.waiting:
            self._tell(k, "duplicate")
        elif kind != "terminator" and s.frontier + 1 < k <= s.frontier + 1 + self.jitter:
            self.waiting[k] = kind
        else:
            self._release(k)
            self._take(k, kind)
            if s.closed:
                self._release(None)
            self._follow()
        self._ask()

    def _take(self, k: int, kind: str) -> None:
        s = self.now
        if s.closed:
            self._tell(k, "rejected")
            return
        verdict = "applied" if k == s.frontier + 1 else "gap"
        if verdict == "gap":
            self.new.append((s.frontier + 1, k - 1))
            if self.ranges is not None:
                self.ranges.append(self.new[-1])
            s.taint += k - 1 - s.frontier
            s.oldest = self.at if s.oldest is None else s.oldest
        s.frontier = k
        if kind == "terminator":
            s.closed, verdict = True, "terminator"
        self._tell(k, verdict)

    def _release(self, before: int | None) -> None:
        """Held rows below a sequence (all without one) go, in order."""
        for x in sorted(x for x in self.waiting if before is None or x < before):
            self._take(x, self.waiting.pop(x))

    def _follow(self) -> None:
        """Held rows that are next now go."""
        while self.now.frontier + 1 in self.waiting and not self.now.closed:
            self._take(self.now.frontier + 1, self.waiting.pop(self.now.frontier + 1))

    def _clear(self) -> None:
        s = self.now
        if s.taint:
            for k in [k for k, _ in self.taint.iterator()]:
                self.taint.removeKey(k)
        self.new, self.ranges = [], None
        s.taint, s.oldest, s.asked = 0, None, False

    def _tainted(self, k: int) -> bool:
        if not self.now.taint:
            return False
        if self.ranges is None:
            self.ranges = sorted([(a[0], b[0]) for a, b in self.taint.iterator()] + self.new)
        at = bisect(self.ranges, (k, float("inf"))) - 1
        return at >= 0 and self.ranges[at][1] >= k

    def _age(self) -> int | None:
        return None if self.now.oldest is None else max(0, self.at - self.now.oldest)

    def _density(self) -> float:
        return self.now.taint / max(1, self.now.frontier - self.now.floor)

    def _ask(self) -> None:
        s = self.now
        over = [(self.max_taint, s.taint), (self.max_density, self._density()), (self.max_age, self._age() or 0)]
        if s.taint and not s.asked and not s.closed and any(most is not None and value > most for most, value in over):
            s.asked = True
            self._tell(s.frontier, "recover")

    def _tell(self, k: int, verdict: str) -> None:
        s = self.now
        self.out.append((k, verdict, s.frontier, s.taint, self._age(), self._density()))

    def close(self) -> None:
        pass


def receive_stream(rows: DataFrame, mode: str = "None", **options) -> DataFrame:
    """Verdicts of a stream (or a batch) of chain rows: one shuffle on chain_id."""
    return ready(rows).select("chain_id", "sequence", "kind", "recovery", "arrival").groupBy("chain_id").transformWithStateInPandas(ChainProcessor(**options), outputStructType=OUT, outputMode="Append", timeMode=mode)


class CadenceProcessor(StatefulProcessor):
    """Tells when a snapshot of a chain is due: the first row, `changes` rows after the last one, a row that is
    significant, and (with a time mode) `floor_ms` after the last one, if rows came since.

    Rows have chain_id, sequence, at_ms and significant (boolean).
    """

    def __init__(self, floor_ms: int, changes: int, timed: bool = True):
        self.floor_ms, self.changes, self.timed = floor_ms, changes, timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "since long, rows long, sequence long, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        since, n, last, timer = self.state.get() if self.state.exists() else (None, 0, None, None)
        out = []
        for r in pd.concat(list(rows)).sort_values("sequence", kind="stable").itertuples(index=False):
            n, last = n + 1, int(r.sequence)
            why = "birth" if since is None else "significant" if r.significant else "changes" if n >= self.changes else "floor" if int(r.at_ms) - since >= self.floor_ms else None
            if why:
                since, n = int(r.at_ms), 0
                out.append((key[0], last, int(r.at_ms), why))
        want = since + self.floor_ms if n and self.timed else None
        if timer is not None and timer != want:
            self.handle.deleteTimer(timer)
        if want is not None and timer != want:
            self.handle.registerTimer(want)
        self.state.update((since, n, last, want))
        yield self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, n, last, _ = self.state.get()
        at = expiredTimerInfo.getExpiryTimeInMs()
        self.state.update((at, 0, last, None))
        yield self._rows([(key[0], last, at, "floor")] if n else [])

    def _rows(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["chain_id", "sequence", "at_ms", "why"])

    def close(self) -> None:
        pass


def cadence_stream(rows: DataFrame, floor_ms: int, changes: int, mode: str = "EventTime") -> DataFrame:
    """When snapshots are due: chain_id, sequence, at_ms, why. In event time the stream needs a watermark."""
    more = [c for c in rows.columns if c == "ts"] if mode == "EventTime" else []
    return ready(rows).select("chain_id", "sequence", "at_ms", "significant", *more).groupBy("chain_id").transformWithStateInPandas(CadenceProcessor(floor_ms, changes, mode != "None"), outputStructType="chain_id string, sequence long, at_ms long, why string", outputMode="Append", timeMode=mode)
