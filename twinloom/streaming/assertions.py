"""Streams of observations to assertions to relation sets: deduplication, keyed state, lives of keys, expiry by event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from twinloom.operators import relations, rules, tabulate
from twinloom.operators.relations import key_ttl_ms  # noqa: F401
from twinloom.streaming import ready

KEY = relations.KEY
SETS = "sid string, st string, si string, dt string, ts long, di array<string>, ttl array<long>, exp array<long>, gone boolean"
RETRACTIONS = "sid string, st string, si string, dt string, di string, ttl long, exp long"
#: Assertions of equal ids within this time are one.
DEDUP_WINDOW = "1 minute"


def assert_stream(messages: DataFrame, rule_list: list[rules.Rule], at: str = "ts", quantise: bool = False, dedup: str | None = DEDUP_WINDOW) -> DataFrame:
    """Assertions of a stream with an event time; repeats of a msg_id within the window are dropped.

    Every query that reads the stream sees all messages (fan-out); a query's tasks share them (a group of consumers).
    """
    m = messages.withColumn(at, F.col(at).cast("timestamp"))
    if dedup:
        m = m.withWatermark(at, dedup)
    made = rules.valid(rules.assertions(m.withColumn("at_ms", F.unix_millis(at)), rule_list, quantise=quantise))
    return made.dropDuplicatesWithinWatermark(["msg_id"]) if dedup else made


def _in_order(rows: Iterator[pd.DataFrame], order: list[str]) -> Iterator[tuple]:
    """A key's (di, ttl, exp, at_ms) in order; lists, as most keys have few rows in a batch and pandas costs a key more than its rows."""
    parts = list(rows)
    batch = parts[0] if len(parts) == 1 else pd.concat(parts)
    by = list(zip(*([(x is None or x != x, x) for x in batch[c].tolist()] for c in order), strict=True))  # nulls last
    made = list(zip(*(batch[c].tolist() for c in ("di", "ttl", "exp", "at_ms")), strict=True))
    return (made[i] for i in sorted(range(len(by)), key=by.__getitem__))


class SetProcessor(StatefulProcessor):
    """One relation set a key, in a map of destination -> (ttl, exp); every batch emits the sets that it changed.

    Assertions of a batch are applied in the order of (order columns). With `expire`, relations go when the watermark
    passes their expiry. With `key_ttl`, a key lives as long as the ttl of the assertion that creates it says and then
    goes whole (its row has `gone`); the next assertion creates it anew. The same class runs in batch mode.
    """

    def __init__(self, order: list[str], expire: bool = False, key_ttl: bool = False):
        self.order, self.expire, self.key_ttl = order, expire, key_ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.edges = handle.getMapState("edges", "di string", "ttl long, exp long")
        self.meta = handle.getValueState("meta", "ts long, timer long, dies long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.meta.exists()
        ts, timer, dies = self.meta.get() if known else (None, None, None)
        was = self._held() if known else {}
        held = dict(was)
        for di, ttl, exp, at in _in_order(rows, self.order):
            at = int(at)
            if known and dies is not None and at >= dies:
                held.clear()
                known, dies = False, None
            if ttl > 0:
                held[di] = (int(ttl), int(exp))
                if not known and self.key_ttl:
                    dies = at + key_ttl_ms(int(ttl))
                known = True
            elif known:
                held.pop(di, None)
            if known:
                ts = at
        self._keep(was, held)
        if known:
            self.meta.update((ts, self._timer(timer, dies, held), dies))
            yield self._row(key, ts, held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        ts, _, dies = self.meta.get()
        was = self._held()
        if dies is not None and dies <= now:
            self._keep(was, {})
            self.meta.clear()
            yield self._row(key, ts, {}, True)
            return
        held = {di: v for di, v in was.items() if v[1] > now}
        self._keep(was, held)
        self.meta.update((ts, self._timer(None, dies, held), dies))
        yield self._row(key, ts, held)

    def _held(self) -> dict[str, tuple[int, int]]:
        """The set as it stands, read once: a call to the state costs more than a row's work."""
        return {k[0]: (v[0], v[1]) for k, v in self.edges.iterator()}

    def _keep(self, was: dict[str, tuple[int, int]], held: dict[str, tuple[int, int]]) -> None:
        """Write what a batch changed, once a relation."""
        for di in was.keys() - held.keys():
            self.edges.removeKey((di,))
        for di, v in held.items():
            if was.get(di) != v:
                self.edges.updateValue((di,), v)

    def _timer(self, timer: int | None, dies: int | None, held: dict[str, tuple[int, int]]) -> int | None:
        """One timer at the least expiry."""
        least = min((exp for _, exp in held.values()), default=None) if self.expire else None
        least = dies if least is None or dies is not None and dies < least else least
        if timer is not None and timer != least:
            self.handle.deleteTimer(timer)
        if least is not None and timer != least:
            self.handle.registerTimer(least)
        return least

    def _row(self, key, ts, held: dict[str, tuple[int, int]], gone: bool = False) -> pd.DataFrame:
        got = sorted(held.items(), key=lambda x: x[0].encode())
        return pd.DataFrame({**{c: [k] for c, k in zip(KEY, key, strict=True)}, "ts": [ts], "di": [[di for di, _ in got]], "ttl": [[v[0] for _, v in got]], "exp": [[v[1] for _, v in got]], "gone": [gone]})

    def close(self) -> None:
        pass


class ExpiryProcessor(StatefulProcessor):
    """Retractions (ttl 0) of relations that weren't refreshed, when the watermark passes their expiry, or before that when
    the next assertion of the relation comes and is later.

    State is one entry a relation and one a time at which some expire, each touched only when its time comes. A batch reads and
    writes a relation once, and only the assertion that stands after it gets a timer.
    """

    def __init__(self, order: list[str]):
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.edges = handle.getMapState("edges", "di string", "exp long")
        self.due = handle.getMapState("due", "exp long", "di array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        was: dict[str, int | None] = {}
        held: dict[str, int | None] = {}
        made: set[str] = set()
        over = []
        for di, ttl, exp, at in _in_order(rows, self.order):
            if di not in was:
                was[di] = held[di] = self.edges.getValue((di,))[0] if self.edges.containsKey((di,)) else None
            if held[di] is not None and held[di] < at:
                over.append((*key, di, 0, held[di]))
                held[di] = None
            if ttl > 0:
                held[di] = int(exp)
                made.add(di)
            else:
                held[di] = None
        new: dict[int, list[str]] = {}
        for di, exp in held.items():
            if exp is not None and di in made and exp <= timerValues.getCurrentWatermarkInMs():  # its timer would never come
                over.append((*key, di, 0, exp))
                exp = None
            if exp is None and was[di] is not None:
                self.edges.removeKey((di,))
            elif exp != was[di]:
                self.edges.updateValue((di,), (exp,))
                new.setdefault(exp, []).append(di)
        for exp, dis in new.items():
            known = list(self.due.getValue((exp,))[0]) if self.due.containsKey((exp,)) else []
            if not known:
                self.handle.registerTimer(exp)
            self.due.updateValue((exp,), (list(dict.fromkeys([*known, *dis])),))
        if over:
            yield pd.DataFrame(over, columns=[*KEY, "di", "ttl", "exp"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        exp = expiredTimerInfo.getExpiryTimeInMs()
        dis = list(self.due.getValue((exp,))[0]) if self.due.containsKey((exp,)) else []
        if dis:
            self.due.removeKey((exp,))
        yield self._retract(key, [(di, exp) for di in dis if self._stands(di, exp)])

    def _stands(self, di: str, exp: int) -> bool:
        return self.edges.containsKey((di,)) and self.edges.getValue((di,))[0] == exp

    def _retract(self, key, gone: list[tuple[str, int]]) -> pd.DataFrame:
        for di, _ in gone:
            self.edges.removeKey((di,))
        return pd.DataFrame([(*key, di, 0, exp) for di, exp in gone], columns=[*KEY, "di", "ttl", "exp"])

    def close(self) -> None:
        pass


def _input(assertions: DataFrame, order: list[str], mode: str) -> DataFrame:
    at = relations.at_ms(assertions).alias("at_ms")
    more = dict.fromkeys([c for c in order if c != "at_ms"] + (["ts"] if mode == "EventTime" else []))
    return ready(assertions.select(*KEY, "di", "ttl", "exp", at, *more))


def set_stream(assertions: DataFrame, order: list[str], mode: str = "None", expire: bool = False, key_ttl: bool = False) -> DataFrame:
    """Relation sets as they change, from a stream (or a batch) of assertions: one shuffle on the key.

    `expire` and `key_ttl` need mode "EventTime" and a watermark on `ts`.
    """
    return _input(assertions, order, mode).groupBy(*KEY).transformWithStateInPandas(SetProcessor(order, expire, key_ttl), outputStructType=SETS, outputMode="Update", timeMode=mode)


def expiry_stream(assertions: DataFrame, order: list[str]) -> DataFrame:
    """Retractions of expired relations, to be fed back as assertions; needs a watermark on `ts`."""
    return _input(assertions, order, "EventTime").groupBy(*KEY).transformWithStateInPandas(ExpiryProcessor(order), outputStructType=RETRACTIONS, outputMode="Append", timeMode="EventTime")


def as_sets(rows: DataFrame) -> DataFrame:
    """The processor's rows as relation sets; keys that are gone are left out."""
    r = F.transform(F.arrays_zip("di", "ttl", "exp"), lambda x: F.struct(x["di"].alias("di"), x["ttl"].alias("ttl"), x["exp"].alias("exp"))).alias("r")
    return rows.where(~F.col("gone")).select(*KEY, "ts", r)


def follow(batch: DataFrame, path: str, n: int) -> None:
    """For foreachBatch on set_stream's rows: log the keys that changed (gone ones too) in a versioned table."""
    tabulate.record(batch.withColumn("batch", F.lit(n).cast("long")), path, n, KEY, ["batch"], "gone")


def followed(spark, path: str) -> DataFrame:
    """The latest set of each standing key, as routes join it."""
    rows = tabulate.read_table(spark, path, KEY, ["batch"])
    return as_sets(rows if rows is not None else spark.createDataFrame([], f"{SETS}, batch long"))
