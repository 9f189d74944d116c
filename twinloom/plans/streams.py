"""Streams as queries: each runs until its source has no more, over state and timers, and gives what SQL gives for the whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinloom.operators import relations, routes, rules
from twinloom.plans import catalogue as C
from twinloom.plans.oracle import ARRIVALS, ASSERTED, EDGES, OBS, SETS
from twinloom.sources import files
from twinloom.streaming import assertions, chains, finished, routing

CUT = 1_705_276_800_000_000
#: A last message far in the future, at which all timers have come.
END_US = 4_102_444_800_000_000


def source(spark, rows: DataFrame, *cuts) -> DataFrame:
    """The rows as a stream of one micro-batch a cut: four files each in a folder, in this order."""
    path, left = files.scratch(spark, "stream"), rows
    for i, cut in enumerate((*cuts, F.lit(True))):
        left.where(cut).repartition(4).write.parquet(f"{path}/{i}")
        left = left.where(~cut)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).option("recursiveFileLookup", "true").parquet(path)


def _messages(spark, sf_dir) -> DataFrame:
    return C.observations(spark, sf_dir).withColumn("ts", F.timestamp_micros("at_us"))


def _early():
    return F.col("at_us") < CUT


@C.query
def stream_assertions(spark, sf_dir):
    """Every message comes twice; repeats of an assertion within the window go."""
    m = _messages(spark, sf_dir).select("ts", "subject", "event_id", "at_us").unionAll(_messages(spark, sf_dir).select("ts", "subject", "event_id", "at_us"))
    made = finished(assertions.assert_stream(source(spark, m, _early()), C.RULES), "asserted")
    return made.select("msg_id", "si", "di", "ttl", "exp")


@C.query
def stream_sets(spark, sf_dir):
    """Relation sets in keyed state, over two micro-batches; the last row of each key."""
    a = C.asserted(spark, sf_dir).select(*relations.KEY, "di", "ttl", "exp", "at_ms", "at_us", "event_id")
    rows = finished(assertions.set_stream(source(spark, a, _early()), C.ORDER), "sets", "update")
    last = rows.groupBy(*relations.KEY).agg(F.max_by(F.struct("ts", "di", "ttl", "exp", "gone"), "batch").alias("x")).select(*relations.KEY, "x.*")
    return C._flat(assertions.as_sets(last))


@C.query
def stream_followed(spark, sf_dir):
    """The same sets as a follower keeps them: changed keys alone are logged, and readers see the latest of each."""
    a = C.asserted(spark, sf_dir).select(*relations.KEY, "di", "ttl", "exp", "at_ms", "at_us", "event_id")
    path = files.scratch(spark, "followed")
    from twinloom.streaming import started

    started(assertions.set_stream(source(spark, a, _early()), C.ORDER), lambda rows, n: assertions.follow(rows, f"{path}/table", n), f"{path}/checkpoint", "update").awaitTermination()
    return C._flat(assertions.followed(spark, f"{path}/table"))


@C.query
def stream_expiries(spark, sf_dir):
    """Retractions of relations that nothing refreshed in time, from event-time timers; a last message makes all of them due."""
    a = C.asserted(spark, sf_dir).select(*relations.KEY, "di", "ttl", "exp", "at_ms", "at_us", "event_id", F.timestamp_micros("at_us").alias("ts"))
    end = a.limit(1).select(*(F.lit("end").alias(c) for c in (*relations.KEY, "di")), F.lit(0).cast("long").alias("ttl"), F.lit(END_US // 1000).alias("exp"), F.lit(END_US // 1000).alias("at_ms"), F.lit(END_US).alias("at_us"), F.lit(0).cast("long").alias("event_id"), F.timestamp_micros(F.lit(END_US)).alias("ts"))
    s = source(spark, a.unionByName(end), F.col("at_us") < END_US).withWatermark("ts", "0 seconds")
    return finished(assertions.expiry_stream(s, C.ORDER), "expiries").select("si", "di", "ttl", "exp")


@C.query
def stream_key_ttl(spark, sf_dir):
    """Keys go whole when the ttl of the assertion that created them is over: the rows that say so."""
    m = _messages(spark, sf_dir).where("value >= 20 and event_id % 5 = 0")
    short = [rules.Rule(r.match, 36_000_000, "user", "type", 5, 7) for r in C.RULES[:1]]
    a = rules.assertions(m, short).select(*relations.KEY, "di", "ttl", "exp", "at_ms", "at_us", "event_id", "ts")
    end = a.limit(1).select(*(F.lit("end").alias(c) for c in (*relations.KEY, "di")), F.lit(0).cast("long").alias("ttl"), F.lit(END_US // 1000).alias("exp"), F.lit(END_US // 1000).alias("at_ms"), F.lit(END_US).alias("at_us"), F.lit(0).cast("long").alias("event_id"), F.timestamp_micros(F.lit(END_US)).alias("ts"))
    s = source(spark, a.unionByName(end), F.col("at_us") < END_US).withWatermark("ts", "0 seconds")
    rows = finished(assertions.set_stream(s, C.ORDER, "EventTime", key_ttl=True), "lives", "update")
    return rows.where("gone").groupBy("si").agg(F.max("ts").alias("last_ms"), F.max(F.size("di")).cast("long").alias("n"))


@C.query
def stream_routes(spark, sf_dir):
    """Routes over a stream, joined with a static table of relations."""
    s = source(spark, C.observations(spark, sf_dir).select("event_id", "subject", "at_us"), _early())
    r = [C._route("out.user.${5}.to.${types}", types=C.USER_TYPES), routes.Route("off", "twin.>", "x", disabled=True)]
    return finished(routing.route_stream(s, r, C.keyed(C.user_edges(spark, sf_dir))), "routed").select("event_id", "egress")


@C.query
def stream_routes_changed(spark, sf_dir):
    """Routes and relations that change between batches: each batch sees those that stand when it begins."""
    s = source(spark, C.observations(spark, sf_dir).select("event_id", "subject", "at_us"), _early())
    path, rel = files.scratch(spark, "changed"), C.keyed(C.user_edges(spark, sf_dir))
    plans = iter([[routes.Route("a", "twin.>", "one.${5}")], [routes.Route("a", "twin.>", "one.${5}"), C._route("two.${types}", types=C.USER_TYPES), routes.Route("a", "twin.>", "gone", disabled=True)]])

    def sink(rows: DataFrame, n: int) -> None:
        rows.select("event_id", "egress").write.mode("overwrite").parquet(f"{path}/rows/batch={n}")

    routing.route_batches(s, lambda: next(plans), lambda: rel, sink, f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/rows").select("event_id", "egress")


@C.query
def stream_receive(spark, sf_dir):
    """The receive protocol in keyed state, with anchors and terminators: the same verdicts as in batch."""
    order = ["arrival", "copy", "sequence"]
    rows = C._arrivals(spark, sf_dir)
    w = C.Window.partitionBy("user_id").orderBy(*order)
    kind = F.when(F.col("event_id") % 37 == 0, "terminator").otherwise("delta")
    d = rows.select(F.col("user_id").cast("string").alias("chain_id"), "sequence", kind.alias("kind"), ((F.col("event_id") % 31 == 0) & (F.col("copy") == 0)).alias("recovery"), F.row_number().over(w).cast("long").alias("arrival"))
    got = finished(chains.receive_stream(source(spark, d, F.col("arrival") <= 20)), "received")
    return got.groupBy(F.col("chain_id").cast("long").alias("user_id"), "sequence", "verdict").agg(F.count("*").alias("n"))


@C.query
def stream_cadence(spark, sf_dir):
    """When snapshots are due, by rows and time since the last one: the same in a stream and by a fold of each chain."""
    o = C.observations(spark, sf_dir).select(F.col("user_id").cast("string").alias("chain_id"), F.col("event_id").alias("sequence"), "at_ms", F.lit(False).alias("significant"), "at_us")
    got = finished(chains.cadence_stream(source(spark, o, F.col("sequence") <= 500), 10**15, 10, "None"), "cadence")
    return got.select(F.col("chain_id").cast("long").alias("chain_id"), "sequence", "why")


@C.query
def stream_bronze(spark, sf_dir):
    """Assertions into the bronze tier of a lake, partitioned by destination, and read back."""
    a = C.asserted(spark, sf_dir).select("sid", "si", "di", "ttl", "exp", "at_us")
    path = files.scratch(spark, "lake")
    files.bronze(source(spark, a, _early()), path, "deltaflow", "assertions", f"{path}/checkpoint", ["di"]).awaitTermination()
    return spark.read.parquet(files.lake_path(path, "bronze", "deltaflow", "assertions")).groupBy("di").agg(F.count("*").alias("n"), F.sum("ttl").alias("ttl"), F.max("exp").alias("exp"))


ORACLE_SQL: dict[str, str] = {
    "stream_assertions": f"""with {ASSERTED} select distinct sha1(concat_ws(chr(31), sid, st, si, dt, di, ttl::varchar, exp::varchar)) as msg_id, si, di, ttl, exp from a""",
    "stream_sets": f"with {SETS} select * from s",
    "stream_followed": f"with {SETS} select * from s",
    "stream_expiries": f"""with {ASSERTED}, n as (select *, lead(at_ms) over (partition by si, di order by at_us, event_id) as nxt from a) select si, di, 0::bigint as ttl, exp from n where ttl > 0 and (nxt is null or nxt > exp)""",
    "stream_key_ttl": f"""with recursive {OBS}, a as (select user_id::varchar as si, at_ms, row_number() over (partition by user_id order by at_us, event_id) as rn from o where value >= 20 and event_id % 5 = 0),
      l as (select si, rn, at_ms, at_ms + 36000000 as dies from a where rn = 1 union all select a.si, a.rn, a.at_ms, case when a.at_ms >= l.dies then a.at_ms + 36000000 else l.dies end from l join a on a.si = l.si and a.rn = l.rn + 1)
      select si, max(at_ms) as last_ms, 0::bigint as n from l group by si""",
    "stream_routes": f"with {EDGES} select event_id, 'out.user.' || user_id || '.to.' || coalesce(di, '') as egress from o left join e on e.si = o.user_id::varchar",
    "stream_routes_changed": f"""with {EDGES} select event_id, 'one.' || user_id as egress from o where at_us < {CUT} union all select event_id, 'two.' || coalesce(di, '') from o left join e on e.si = o.user_id::varchar where at_us >= {CUT}""",
    "stream_receive": f"""with {ARRIVALS}, a as (select *, event_id % 31 = 0 and copy = 0 as anchor, event_id % 37 = 0 as closes from r),
      p as (select *, sum(anchor::int) over w as part, row_number() over w as rn from a window w as (partition by user_id order by arrival, copy, sequence rows unbounded preceding)),
      q as (select *, max(sequence) over (partition by user_id, part order by rn rows unbounded preceding) as after, coalesce(max(case when anchor then sequence end) over (partition by user_id, part), 0) as floor from p),
      f as (select *, coalesce(lag(after) over (partition by user_id order by rn), 0) as fr from q),
      e as (select *, min(case when (anchor or sequence > fr) and closes then rn end) over (partition by user_id) as ended from f),
      g as (select *, coalesce(max((anchor or sequence > fr)::int) over (partition by user_id, part, sequence order by rn rows between unbounded preceding and 1 preceding), 0) as seen from e),
      v as (select user_id, sequence, case when rn > ended then 'rejected' when anchor then 'anchor' when sequence > fr and closes then 'terminator' when sequence = fr + 1 then 'applied'
      when sequence > fr then 'gap' when seen = 1 or sequence <= floor then 'duplicate' else 'late' end as verdict from g) select user_id, sequence, verdict, count(*) as n from v group by all""",
    "stream_cadence": f"""with {OBS}, c as (select user_id as chain_id, event_id as sequence, row_number() over (partition by user_id order by event_id) as rn from o) select chain_id, sequence, case when rn = 1 then 'birth' else 'changes' end as why from c where (rn - 1) % 10 = 0""",
    "stream_bronze": f"with {ASSERTED} select di, count(*) as n, sum(ttl)::bigint as ttl, max(exp) as exp from a group by di",
}
