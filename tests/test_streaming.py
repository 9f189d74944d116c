"""Streams against their batch twins."""

import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from twinloom.operators import chain, relations, routes, rules
from twinloom.plans import catalogue
from twinloom.streaming import assertions, chains, routing

SF = "/root/testdata/sf0.001"
TABLE = "sid string, st string, si string, dt string, di string, ttl long, exp long, at_us long, event_id long"


@pytest.fixture(scope="module")
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def as_files(df, path, by, n):
    """The rows in n files, one micro-batch each."""
    rows = df.orderBy(*by).collect()
    size = -(-len(rows) // n)
    for i in range(n):
        part = rows[i * size : (i + 1) * size]
        if part:
            df.sparkSession.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(f"{path}")
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def finish(stream, name, tmp_path, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def facts(sets):
    return sorted((r.si, r.ts, tuple((x.di, x.ttl, x.exp) for x in r.r)) for r in sets.collect())


def small(spark):
    return catalogue.asserted(spark, SF).where("event_id < 300").select(*[c.split()[0] for c in TABLE.split(", ")])


def test_sets_in_batch_mode(rocks):
    a = small(rocks)
    assert facts(assertions.as_sets(assertions.set_stream(a, catalogue.ORDER))) == facts(relations.relation_sets(a, catalogue.ORDER))


def test_sets_over_a_stream(rocks, tmp_path):
    a = small(rocks)
    got = finish(assertions.set_stream(as_files(a, str(tmp_path / "in"), catalogue.ORDER, 2), catalogue.ORDER), "sets", tmp_path, "update")
    last = got.withColumn("n", F.size("di")).groupBy(*relations.KEY).agg(F.max_by(F.struct("ts", "di", "ttl", "exp", "gone"), "ts").alias("x")).select(*relations.KEY, "x.*")
    assert facts(assertions.as_sets(last)) == facts(relations.relation_sets(a, catalogue.ORDER))


def test_dedup_and_assert(rocks, tmp_path):
    m = catalogue.observations(rocks, SF).where("event_id < 60").withColumn("ts", F.timestamp_micros("at_us")).select("ts", "subject")
    twice = m.unionAll(m)
    got = finish(assertions.assert_stream(as_files(twice, str(tmp_path / "in"), ["ts"], 1), catalogue.RULES), "asserted", tmp_path, "append")
    assert got.count() == rules.assertions(m.withColumn("at_ms", F.unix_millis("ts")), catalogue.RULES).select("msg_id").distinct().count()


def test_key_ttl():
    assert [assertions.key_ttl_ms(x) for x in (0, 1, 999, 1000, 5000)] == [0, 2000, 2000, 1000, 5000]


def test_chain_processor_equals_windows(rocks):
    rows = catalogue._arrivals(rocks, SF).where("user_id < 6")
    order = ["arrival", "copy", "sequence"]
    want = sorted((str(r.user_id), r.sequence, r.verdict) for r in chain.receive(rows, "user_id", "sequence", order).collect())
    n = F.row_number().over(__import__("pyspark.sql", fromlist=["Window"]).Window.partitionBy("user_id").orderBy(*order)).cast("long")
    d = rows.select(F.col("user_id").cast("string").alias("chain_id"), "sequence", F.lit("delta").alias("kind"), F.lit(False).alias("recovery"), n.alias("arrival"))
    got = sorted((r.chain_id, r.sequence, r.verdict) for r in chains.receive_stream(d).collect())
    assert got == want


def verdicts(spark, rows, **options):
    df = spark.createDataFrame([("c", k, kind, rec, i) for i, (k, kind, rec) in enumerate(rows)], "chain_id string, sequence long, kind string, recovery boolean, arrival long")
    return [(r.sequence, r.verdict) for r in chains.receive_stream(df, **options).collect()]


def test_anchor_terminator_and_recovery(rocks):
    d, s, t = ("delta", False), ("snapshot", True), ("terminator", False)
    assert verdicts(rocks, [(1, *d), (4, *d), (3, *d), (1, *d), (9, *s), (8, *d), (10, *d), (11, *t), (12, *d)]) == [(1, "applied"), (4, "gap"), (3, "late"), (1, "duplicate"), (9, "anchor"), (8, "duplicate"), (10, "applied"), (11, "terminator"), (12, "rejected")]


class Fake:
    """State and timers of one key, without Spark."""

    def __init__(self):
        self.maps, self.timers, self.clock = {}, set(), 0

    def getValueState(self, name, _schema):
        return FakeValue()

    def getMapState(self, name, _keys, _values):
        return self.maps.setdefault(name, FakeMap())

    def registerTimer(self, t):
        self.timers.add(t)

    def deleteTimer(self, t):
        self.timers.remove(t)

    def getCurrentProcessingTimeInMs(self):
        return self.clock


class FakeValue:
    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class FakeMap(dict):
    def iterator(self):
        return iter(list(self.items()))

    def updateValue(self, k, v):
        self[k] = v

    def removeKey(self, k):
        del self[k]

    def containsKey(self, k):
        return k in self

    def getValue(self, k):
        return self[k]


class Expired:
    def __init__(self, t):
        self.t = t

    def getExpiryTimeInMs(self):
        return self.t


class Chain:
    """A processor on one key."""

    def __init__(self, made):
        self.made, self.fake, self.n = made, Fake(), 0
        made.init(self.fake)

    def rows(self, *rows, at=0):
        self.fake.clock = at
        table = pd.DataFrame([(k, kind, rec, self.n + i) for i, (k, kind, rec) in enumerate(rows)], columns=["sequence", "kind", "recovery", "arrival"])
        self.n += len(rows)
        return [(int(r.sequence), r.verdict) for part in self.made.handleInputRows(("c",), iter([table]), self.fake) for r in part.itertuples()]

    def pass_to(self, t):
        out = []
        while self.fake.timers and min(self.fake.timers) <= t:
            at = min(self.fake.timers)
            self.fake.timers.remove(at)
            out += [(int(r.sequence), r.verdict) for part in self.made.handleExpiredTimer(("c",), self.fake, Expired(at)) for r in part.itertuples()]
        return out


D, S, T = ("delta", False), ("snapshot", True), ("terminator", False)


def test_processor_equals_windows_on_random_chains(spark):
    """Both forms and both kinds, in one batch or many, with anchors that go back and late terminators."""
    rng = random.Random(3)
    rows, want = [], {}
    for c in range(150):
        one = Chain(chains.ChainProcessor())
        plan = [(rng.randrange(1, 14), *rng.choices([D, S, T, ("terminator", True)], [12, 2, 1, 0.3])[0]) for _ in range(rng.randrange(1, 25))]
        got = []
        while len(got) < len(plan):
            got += one.rows(*plan[len(got) : len(got) + rng.randrange(1, 9)])
        want[c] = got
        rows += [(c, k, i, kind == "terminator", rec) for i, (k, kind, rec) in enumerate(plan)]
    df = spark.createDataFrame(rows, "chain long, sequence long, arrival long, ends boolean, rec boolean")
    batch = {}
    for r in chain.receive(df, "chain", "sequence", ["arrival"], F.col("rec"), F.col("ends")).orderBy("chain", "arrival").collect():
        batch.setdefault(r.chain, []).append((r.sequence, r.verdict))
    assert batch == want


def test_jitter_reorders_and_loses_nothing(rocks):
    assert verdicts(rocks, [(1, *D), (3, *D), (2, *D), (4, *D)], jitter=2) == [(1, "applied"), (2, "applied"), (3, "applied"), (4, "applied")]
    assert verdicts(rocks, [(1, *D), (3, *D), (3, *D), (4, *D)], jitter=3) == [(1, "applied"), (3, "duplicate"), (3, "gap"), (4, "applied")]
    rng = random.Random(4)
    for hold in (None, 50):
        for _ in range(200):
            one = Chain(chains.ChainProcessor(jitter=rng.randrange(1, 5), hold_ms=hold))
            plan = [(rng.randrange(1, 14), *rng.choices([D, S, T], [12, 1, 1])[0]) for _ in range(rng.randrange(1, 20))]
            got = [v for i in range(0, len(plan), 3) for v in one.rows(*plan[i : i + 3], at=10 * i)] + one.pass_to(10**6)
            assert Counter(k for k, _ in got) == Counter(k for k, *_ in plan) and not one.fake.maps["held"]


def test_held_rows_wait_for_their_time():
    one = Chain(chains.ChainProcessor(jitter=5, hold_ms=100))
    assert one.rows((1, *D), (3, *D), at=10) == [(1, "applied")]
    assert one.pass_to(109) == [] and one.pass_to(110) == [(3, "gap")]
    assert one.rows((5, *D), at=200) == [] and one.rows((4, *D), at=220) == [(4, "applied"), (5, "applied")] and one.fake.timers == set()
    assert one.rows((8, *D), (7, *T), (9, *D), at=300) == [(7, "terminator"), (8, "rejected"), (9, "rejected")]


def test_silence_closes():
    one = Chain(chains.ChainProcessor(silence_ms=1000, jitter=3, hold_ms=5000))
    assert one.rows((1, *D), (3, *D), at=0) == [(1, "applied")]
    assert one.rows((4, *D), at=900) == [] and one.pass_to(1899) == []
    assert one.pass_to(1900) == [(3, "gap"), (4, "applied"), (4, "silent")]
    assert one.rows((5, *D), at=2000) == [(5, "rejected")] and one.pass_to(10**6) == []
    done = Chain(chains.ChainProcessor(silence_ms=1000))
    assert done.rows((1, *T), at=0) == [(1, "terminator")] and done.pass_to(10**6) == []


def test_recovery_is_asked_for_by_size_density_and_age():
    recover = lambda rows, **o: [k for k, v in Chain(chains.ChainProcessor(**o)).rows(*rows) if v == "recover"]
    assert recover([(5, *D), (6, *D), (9, *D)], max_taint=3) == [5]  # asked once
    assert recover([(5, *D), (5, *S), (9, *D), (20, *D)], max_taint=3) == [5, 20]
    assert recover([(1, *D), (2, *D), (4, *D), (8, *D)], max_density=0.4) == [8]
    assert recover([(2, *D), (3, *D), (4, *D), (5, *D)], max_age=2) == [5]
    assert recover([(1, *D), (2, *D)], max_taint=0, max_density=0.0, max_age=0) == []


def test_a_long_gap_is_one_range():
    one = Chain(chains.ChainProcessor())
    assert one.rows((1, *D), (10**9, *D), (5, *D), (10**9 - 1, *D)) == [(1, "applied"), (10**9, "gap"), (5, "late"), (10**9 - 1, "late")]
    assert one.fake.maps["taint"] == {(2,): (10**9 - 1,)}


def test_cadence_by_rows_and_time():
    made = chains.CadenceProcessor(100, 3)
    fake = Fake()
    made.init(fake)
    told = lambda *rows: [(int(r.sequence), r.why) for part in made.handleInputRows(("c",), iter([pd.DataFrame(rows, columns=["sequence", "at_ms", "significant"])]), fake) for r in part.itertuples()]
    assert told((1, 0, False), (2, 10, False), (3, 20, False), (4, 30, False)) == [(1, "birth"), (4, "changes")]
    assert told((5, 40, True), (6, 50, False)) == [(5, "significant")] and fake.timers == {140}
    fake.timers.clear()
    assert [(int(r.sequence), r.at_ms, r.why) for part in made.handleExpiredTimer(("c",), fake, Expired(140)) for r in part.itertuples()] == [(6, 140, "floor")]
    assert told((7, 260, False)) == [(7, "floor")]


def test_routes_over_a_stream(rocks, tmp_path):
    m = catalogue.observations(rocks, SF).where("event_id < 80").select("event_id", "subject")
    rel = catalogue.keyed(catalogue.user_edges(rocks, SF))
    r = [catalogue._route("out.${5}.${types}", types=catalogue.USER_TYPES), routes.Route("off", "twin.>", "x", disabled=True)]
    got = finish(routing.route_stream(as_files(m, str(tmp_path / "in"), ["event_id"], 2), r, rel), "routed", tmp_path, "append")
    want = routes.expand_all(m, r, rel)
    assert sorted((x.event_id, x.egress) for x in got.collect()) == sorted((x.event_id, x.egress) for x in want.collect())


def test_routes_change_between_batches(rocks, tmp_path):
    m = as_files(catalogue.observations(rocks, SF).where("event_id < 40").select("event_id", "subject"), str(tmp_path / "in"), ["event_id"], 2)
    rel, seen = catalogue.keyed(catalogue.user_edges(rocks, SF)), []
    plans = iter([[routes.Route("a", "twin.>", "one.${5}")], [routes.Route("a", "twin.>", "two.${5}")]])
    q = routing.route_batches(m, lambda: next(plans), lambda: rel, lambda df, n: seen.append({r.egress.split(".")[0] for r in df.collect()}), str(tmp_path / "ck"))
    q.awaitTermination()
    assert seen == [{"one"}, {"two"}]
