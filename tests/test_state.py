"""What the processors of assertions ask of their state: once a relation and batch, whatever the rows."""

import random

import pandas as pd

from test_streaming import Expired, Fake, FakeMap
from twinloom.streaming.assertions import ExpiryProcessor, SetProcessor

KEY, ORDER = ("s", "u", "1", "t"), ["at_us", "event_id"]


class Counted(FakeMap):
    calls = 0

    def _one(name):  # noqa: N805
        def f(self, *a):
            Counted.calls += 1
            return getattr(FakeMap, name)(self, *a)

        return f

    updateValue, removeKey, containsKey, getValue, iterator = map(_one, ("updateValue", "removeKey", "containsKey", "getValue", "iterator"))


class State(Fake):
    watermark = -1

    def getMapState(self, name, _keys, _values):
        return self.maps.setdefault(name, Counted())

    def getCurrentWatermarkInMs(self):
        return self.watermark


def table(rows):
    return pd.DataFrame([(di, ttl, at + ttl, at, at * 1000, n) for n, (di, ttl, at) in enumerate(rows)], columns=["di", "ttl", "exp", "at_ms", "at_us", "event_id"])


def run(made, state, *batches, end=10**9):
    """All rows that come of the batches, in chunks, with the timers that the watermark passes."""
    out = []
    made.init(state)
    for b in (*batches, None):
        if b is not None:
            half = len(b) // 2
            parts = [x for x in (table(b)[:half], table(b)[half:]) if len(x)]
            out += [r for part in made.handleInputRows(KEY, iter(parts), state) for r in part.itertuples(index=False)]
        state.watermark = end if b is None else max(at for *_, at in b)
        while state.timers and min(state.timers) <= state.watermark:
            t = min(state.timers)
            state.timers.remove(t)
            out += [r for part in made.handleExpiredTimer(KEY, state, Expired(t)) for r in part.itertuples(index=False)]
    return out


def test_state_is_asked_once_a_relation():
    rows = [("ab"[i % 2], 0 if i % 7 == 6 else 50, i) for i in range(400)]
    for made in (SetProcessor(ORDER), ExpiryProcessor(ORDER)):
        state, Counted.calls = State(), 0
        made.init(state)
        list(made.handleInputRows(KEY, iter([table(rows)]), state))
        assert Counted.calls <= 10 and len(state.timers) <= 2


def test_expiries_in_any_batches():
    """Each assertion that no later one reaches in time is retracted, once."""
    rng = random.Random(5)
    for _ in range(300):
        rows = sorted(((rng.choice("abc"), rng.choice([0, 3, 9]), rng.randrange(40)) for _ in range(rng.randrange(1, 25))), key=lambda x: x[2])
        want = []
        for i, (di, ttl, at) in enumerate(rows):
            after = next((a for d, _, a in rows[i + 1 :] if d == di), None)
            if ttl and (after is None or after > at + ttl):
                want.append((di, 0, at + ttl))
        cut = rng.choice([x[2] for x in rows])
        batches = [b for b in ([x for x in rows if x[2] <= cut], [x for x in rows if x[2] > cut]) if b]
        state = State()
        got = run(ExpiryProcessor(ORDER), state, *batches)
        assert sorted((r.di, r.ttl, r.exp) for r in got) == sorted(want)
        assert not state.maps["edges"] and not state.maps["due"]


def test_sets_in_any_batches():
    rng = random.Random(6)
    for _ in range(200):
        rows = [(rng.choice("abc"), rng.choice([0, 3, 9]), i) for i in range(rng.randrange(1, 25))]
        held, ts = {}, None
        for di, ttl, at in rows:
            if ttl:
                held[di] = (ttl, at + ttl)
            elif ts is not None:
                held.pop(di, None)
            ts = at if ttl or ts is not None else None
        cut = rng.randrange(len(rows))
        got = run(SetProcessor(ORDER), State(), *(b for b in (rows[:cut], rows[cut:]) if b))
        assert [ts, held] == ([None, {}] if not got else [got[-1].ts, dict(zip(got[-1].di, zip(got[-1].ttl, got[-1].exp)))])
