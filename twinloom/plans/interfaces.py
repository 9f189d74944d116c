"""Queries over the engine's edges: deltas with headers, anchors, sources and sinks, schema tools, codecs, simulation."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinloom.functions import subjects as S
from twinloom.operators import chain, delta, header, relations, rules, routes, schema, tabulate, transform
from twinloom.plans import catalogue as C
from twinloom.plans.oracle import ASSERTED, EDGES, HEADERS, OBS, PAIRS, SETS
from twinloom.sources import codecs, config, files, simulate

# ---------------------------------------------------------------- deltas with headers

EVENT_TWIN = schema.TwinSchema(
    T.StructType([
        T.StructField("header", header.SCHEMA), schema.tagged("key", T.LongType(), schema.KEY), schema.tagged("kind", T.StringType()), schema.tagged("value", T.DoubleType()),
        schema.tagged("kinds", T.ArrayType(T.StringType()), schema.NESTED), schema.tagged("hidden", T.LongType(), schema.OMIT),
    ])
)


def _snapshot(h, e="event_type"):
    return F.struct(h.alias("header"), F.col("user_id").alias("key"), F.col(e).alias("kind"), F.col("value").alias("value"), F.array(F.col(e)).alias("kinds"), F.col("event_id").alias("hidden"))


def _twins(spark, sf_dir):
    """Events as snapshots with headers that break in turn, each (b) with the one before it (a)."""
    o = C.observations(spark, sf_dir).select("event_id", "event_type", "value")
    rows = C._headers(spark, sf_dir, whole=True).join(o, "event_id")
    b = rows.select("event_id", "user_id", "at_us", _snapshot(F.col("d")).alias("b"))
    return b.withColumn("a", F.lag("b").over(Window.partitionBy("user_id").orderBy("at_us", "event_id"))).where("a is not null")


@C.query
def diff_with_header(spark, sf_dir):
    """The delta between snapshots with headers, or the first check that fails and no delta."""
    d = _twins(spark, sf_dir).withColumn("d", delta.diff(F.col("a"), F.col("b"), EVENT_TWIN))
    return d.select("event_id", F.col("d.error").alias("error"), F.col("d.delta.header.sequence").alias("sequence"), F.size("d.delta.header.provenance").cast("long").alias("origins"), F.col("d.delta.kind.op").alias("kind_op"), F.col("d.delta.value.value").alias("value"), F.array_join("d.delta.kinds.added", ",").alias("added"), F.array_join("d.delta.kinds.removed", ",").alias("removed"))


@C.query
def apply_with_header(spark, sf_dir):
    """A snapshot after the delta to the next one: header checks first, then lineage and fields; the suppressed field stays."""
    d = _twins(spark, sf_dir)
    body = delta.diff(F.col("a").withField("header", F.lit(None).cast(header.SCHEMA)), F.col("b"), BARE)["delta"]
    d = d.withColumn("d", F.struct(F.col("b.header").alias("header"), *(body[k.name].alias(k.name) for k in EVENT_TWIN.fields if k.kind != "suppressed")))
    r = d.withColumn("r", delta.apply(F.col("a"), F.col("d"), EVENT_TWIN))
    return r.select("event_id", F.col("r.error").alias("error"), F.col("r.snapshot.header.sequence").alias("sequence"), F.unix_micros("r.snapshot.header.effective_at").alias("effective_us"), F.array_join(F.transform("r.snapshot.header.provenance", lambda x: x["component"]), ">").alias("lineage"), F.col("r.snapshot.kind").alias("kind"), F.array_join("r.snapshot.kinds", ",").alias("kinds"), F.col("r.snapshot.hidden").alias("hidden"))


BARE = schema.TwinSchema(T.StructType([f for f in EVENT_TWIN.schema.fields if f.name != "header"]), header=False)


@C.query
def coalesce_with_header(spark, sf_dir):
    """A user's deltas, composed by day and then folded: the first header that breaks ends the fold with its error."""
    o = C.observations(spark, sf_dir)
    w = Window.partitionBy("user_id").orderBy("at_us", "event_id")
    at = F.timestamp_micros("at_us")
    origin = F.array(F.struct(at.alias("published_at"), F.lit(None).cast("timestamp").alias("valid_until"), F.lit("s").alias("solution"), F.col("event_type").alias("component"), F.lit("i").alias("instance"), F.create_map().cast("map<string,string>").alias("metadata")))
    chain_id = F.when((F.col("user_id") % 7 == 0) & (F.expr(f"at_us div {24 * C.HOUR_US}") == 19_732), "other").otherwise("c")
    values = {"entity_id": F.unhex(F.sha2(F.col("user_id").cast("string"), 256)), "chain_id": chain_id, "sequence": F.row_number().over(w).cast("long"), "effective_at": at, "published_at": at, "provenance": origin}
    head = lambda v: F.struct(*(v.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in header.SCHEMA.fields)).alias("header")
    strings = T.ArrayType(T.StringType())
    one = lambda c, t: F.struct(F.lit(1).cast("byte").alias("op"), c.cast(t).alias("value"))
    d = F.struct(head(values), F.col("user_id").alias("key"), one(F.col("event_type"), "string").alias("kind"), one(F.col("value"), "double").alias("value"), F.struct(F.array("event_type").alias("added"), F.array("event_type").alias("removed")).alias("kinds"))
    days = o.select("user_id", "at_us", "event_id", F.expr(f"at_us div {24 * C.HOUR_US}").alias("slot"), d.alias("d"))
    days = days.groupBy("user_id", "slot").agg(F.array_sort(F.collect_list(F.struct("at_us", "event_id", "d")), C._by_time).alias("c"))
    part = days.select("user_id", "slot", delta.compose(F.transform("c", lambda x: x["d"]), EVENT_TWIN).alias("d"))
    chains = part.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("slot", "d")), lambda x, y: F.when(x["slot"] < y["slot"], -1).otherwise(1)).alias("c"))
    birth = {"entity_id": F.unhex(F.sha2(F.col("user_id").cast("string"), 256)), "chain_id": F.lit("c"), "sequence": F.lit(0), "effective_at": F.timestamp_micros(F.lit(0)), "published_at": F.timestamp_micros(F.lit(0))}
    zero = F.struct(head(birth), F.col("user_id").alias("key"), F.lit("").alias("kind"), F.lit(0.0).alias("value"), F.array().cast(strings).alias("kinds"), F.lit(-1).cast("long").alias("hidden"))
    r = chains.select("user_id", delta.coalesce_fold(zero, F.transform("c", lambda x: x["d"]), EVENT_TWIN).alias("r"))
    return r.select("user_id", F.col("r.error").alias("error"), F.col("r.snapshot.header.sequence").alias("sequence"), F.array_join(F.transform("r.snapshot.header.provenance", lambda x: x["component"]), ">").alias("lineage"), F.array_join(F.array_sort("r.snapshot.kinds"), ",").alias("kinds"), F.col("r.snapshot.hidden").alias("hidden"))


@C.query
def full_deltas(spark, sf_dir):
    """Snapshots as deltas that assert all of them; applied to nothing they give the snapshot (but the suppressed field)."""
    d = C.order_pairs(spark, sf_dir).withColumn("d", delta.full_delta(F.col("b"), C.ORDER_TWIN))
    zero = F.struct(F.col("o_custkey").alias("key"), F.lit("").alias("status"), F.lit(0.0).alias("price"), F.lit("").alias("priority"), F.lit(-7).cast("long").alias("hidden"))
    r = d.withColumn("r", delta.apply(zero, F.col("d"), C.ORDER_TWIN)["snapshot"])
    return r.select("o_orderkey", F.col("d.status.op").alias("status_op"), F.col("d.priority.op").alias("priority_op"), F.col("r.status").alias("status"), F.col("r.price").alias("price"), F.col("r.priority").alias("priority"), F.col("r.hidden").alias("hidden"))


@C.query
def empty_deltas(spark, sf_dir):
    """Which deltas change nothing."""
    d = C.order_pairs(spark, sf_dir).withColumn("d", delta.diff(F.col("a"), F.col("b"), C.ORDER_TWIN)["delta"])
    kind = {k.name: k for k in C.ORDER_TWIN.fields}
    return d.select("o_orderkey", delta.is_empty(F.col("d.status"), kind["status"]).alias("same_status"), delta.unchanged(F.col("d"), C.ORDER_TWIN).alias("unchanged"))


@C.query
def delta_schemas(spark, sf_dir):
    """The table of changes that a snapshot schema gives, and what its key may be."""
    keys = {"string": T.StringType(), "struct": C.KEY_TYPE, "double": T.DoubleType(), "array": T.ArrayType(T.LongType()), "nested": T.StructType([T.StructField("x", C.KEY_TYPE)])}

    def may(t) -> str:
        try:
            schema.check_key(t)
        except schema.SchemaError:
            return "refused"
        return "key"

    rows = [(f"{name}.{f.name}", f.dataType.simpleString()) for name, twin in (("order", C.ORDER_TWIN), ("state", C.STATE_TWIN)) for f in twin.delta_schema().fields]
    return spark.createDataFrame(rows + [(f"may be {k}", may(t)) for k, t in keys.items()], "name string, kind string")


@C.query
def chain_anchors(spark, sf_dir):
    """Birth, cadence and terminator snapshots, a handover and a rotation made from a header, and what is wrong with each as another kind."""
    o = C.observations(spark, sf_dir).select("event_id", F.struct(F.unhex(F.sha2(F.col("user_id").cast("string"), 256)).alias("id"), F.timestamp_micros("at_us").alias("at")).alias("e"))
    b = o.withColumn("birth", header.birth(F.col("e.id"), F.lit("one"), F.col("e.at"), F.col("e.at")))
    c = b.withColumn("cadence", header.cadence(F.col("birth"), F.col("event_id"), F.col("e.at")))
    ends = header.reset(F.col("cadence"), F.col("event_id") + 1, F.col("e.at"), F.col("e.at"), F.lit("two"))
    r = c.withColumns({"end": ends[0], "next": ends[1], "turned": header.rotated(F.col("cadence"), F.lit(3), F.col("e.at"), "s", "c", "i")})
    kinds = {f"{n}_{k}": header.anchor_error(F.col(n), k) for n, k in (("birth", "birth"), ("cadence", "birth"), ("cadence", "cadence"), ("end", "terminator"), ("end", "cadence"), ("next", "birth"))}
    return r.select("event_id", *(v.alias(k) for k, v in kinds.items()), F.col("end.next_chain_id").alias("successor"), F.col("next.previous_chain_id").alias("predecessor"), F.col("next.sequence").alias("next_sequence"), F.col("turned.sequence").alias("turned_sequence"), F.col("turned.provenance")[0]["component"].alias("writer"))


@C.query
def provenance_elision(spark, sf_dir):
    """A producer's own last origin is left out of its rows, and readers carry the last one forward."""
    o = C.observations(spark, sf_dir)
    at = F.timestamp_micros("at_us")
    origin = lambda c: F.struct(at.alias("published_at"), F.lit(None).cast("timestamp").alias("valid_until"), F.lit("s").alias("solution"), c.alias("component"), F.lit("i").alias("instance"), F.create_map().cast("map<string,string>").alias("metadata"))
    p = F.array(origin(F.lit("source")), origin(F.col("event_type")))
    kept = o.select("event_id", "user_id", "at_us", F.transform(header.elided_provenance(p, "s", "view", "i"), lambda x: x["component"]).alias("p"))
    rows = kept.withColumn("last", F.when(F.size("p") == 2, F.get("p", 1)))
    return chain.carry_forward(rows, "user_id", ["at_us", "event_id"], "last").select("event_id", F.array_join("p", ">").alias("kept"), "last")


# ---------------------------------------------------------------- sources and sinks


@C.query
def rules_from_json(spark, sf_dir):
    """Rules from a file of JSON, durations in nanoseconds."""
    path = files.scratch(spark, "rules")
    given = [{"match": r.match, "duration": r.ttl_ms * 10**6, "quantisation": r.quantum_ms * 10**6, "sourceType": r.source_type, "destinationType": r.destination_type, "sourceToken": r.source_token, "destinationToken": r.destination_token} for r in C.RULES]
    spark.createDataFrame([(json.dumps(given),)], "value string").coalesce(1).write.text(f"{path}/rules.json")
    return rules.assertions(C.observations(spark, sf_dir), config.load_rules(spark, f"{path}/rules.json")).select("event_id", "si", "di", "ttl", "exp")


@C.query
def routes_from_json(spark, sf_dir):
    path = files.scratch(spark, "routes")
    given = [{"id": "a", "match": "twin.sol.s1.obs.user.*.type.>", "transform": "out.user.${5}.to.${types}", "references": {"types": C.USER_TYPES}}, {"id": "b", "match": "twin.>", "transform": "never", "disabled": True}]
    spark.createDataFrame([(json.dumps(given),)], "value string").coalesce(1).write.text(f"{path}/routes.json")
    made = config.load_routes(spark, f"{path}/routes.json", strict=True)
    return routes.expand_all(C.observations(spark, sf_dir), made, C.keyed(C.user_edges(spark, sf_dir))).select("event_id", "egress")


@C.query
def parquet_roundtrip(spark, sf_dir):
    """Nested and repetitive columns through sorted, partitioned Parquet and back by a schema; a missing column is zero, a wrong type an error."""
    path = files.scratch(spark, "files")
    files.write_parquet(C.user_sets(spark, sf_dir), f"{path}/sets", sort=["si"], partition=["dt"])
    t = T.StructType([*C.user_sets(spark, sf_dir).schema.fields, T.StructField("absent", T.LongType())])
    back = files.read_parquet(spark, f"{path}/sets", t, zero=True)
    try:
        files.read_parquet(spark, f"{path}/sets", T.StructType([T.StructField("si", T.LongType())]))
        wrong = "read"
    except schema.SchemaError:
        wrong = "refused"
    return C._flat(back.where("absent = 0")).withColumn("wrong", F.lit(wrong))


@C.query
def sets_json_files(spark, sf_dir):
    """Relation sets as lines of JSON in files, and back; a line that isn't one is told apart."""
    path = files.scratch(spark, "json")
    lines = files.sets_to_json(C.user_sets(spark, sf_dir))
    lines.unionByName(spark.createDataFrame([("{broken",)], "value string")).write.text(path + "/sets")
    back = files.sets_from_json(spark.read.text(path + "/sets"))
    return C._flat(back.where("corrupt is null"))


@C.query
def upsert_table(spark, sf_dir):
    """The latest order of each customer, recorded in two versions, with deletions."""
    path = files.scratch(spark, "table")
    o = C.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("at"), (F.col("o_orderstatus") == "F").alias("gone"))
    for part in (F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 2 == 1):
        tabulate.upsert(spark, f"{path}/orders", o.where(part), ["o_custkey"], ["at", "o_orderkey"])
    rows = tabulate.read_table(spark, f"{path}/orders", ["o_custkey"], ["at", "o_orderkey"])
    return rows.where("not gone").select("o_custkey", "o_orderkey", "o_orderstatus")


@C.query
def served_view(spark, sf_dir):
    """A table served as a view that SQL asks."""
    tabulate.serve({"latest_by_user": tabulate.latest(C.observations(spark, sf_dir).select("user_id", "event_id", "event_type", "at_us"), ["user_id"], ["at_us", "event_id"])})
    return spark.sql("select event_type, count(*) as n, max(event_id) as last from latest_by_user group by event_type")


@C.query
def key_lives(spark, sf_dir):
    """When each key was created and when it goes, if nothing else counts."""
    return relations.key_lives(C.asserted(spark, sf_dir), C.ORDER).select("si", "created_ms", "dies_ms")


@C.query
def relation_sets_quantised(spark, sf_dir):
    """Expiries are rounded, the time of a set's last assertion isn't."""
    return C._flat(relations.relation_sets(C.asserted(spark, sf_dir, True), C.ORDER))


@C.query
def relation_reverse_edges(spark, sf_dir):
    return relations.reverse_edges(C.user_edges(spark, sf_dir)).select("di", "si")


# ---------------------------------------------------------------- schema tools, types, codecs


@C.query
def schema_annotation(spark, sf_dir):
    """Fields renamed for files, with origin and physical type; names in snake case; a key that an option overrides."""
    c = C.table(spark, sf_dir, "customer")
    t = schema.annotate(T.StructType([*c.schema.fields, T.StructField("Tags", T.ArrayType(T.StringType()))]), {"c_custkey": "key"})
    rows = [(f.name, f.metadata["origin"], f.metadata["physical"]) for f in t.fields]
    rows += [(schema.snake_case(x), x, "snake") for x in ("PumpSnapshot", "HTTPServer", "arSnapshot2", "plain")]
    twin = schema.TwinSchema(T.StructType([schema.tagged("a", T.LongType(), schema.KEY), schema.tagged("b", T.StringType())]), header=False, key_field="b", hash="sha256")
    return spark.createDataFrame([*rows, (twin.key, "a", f"{len(twin.warnings)} warning"), (twin.hash, "hash", "option")], "name string, origin string, physical string")


@C.query
def explicit_types(spark, sf_dir):
    """Durations as nanoseconds, unsigned 64-bit numbers as long where they fit."""
    e = C.observations(spark, sf_dir)
    big = F.when(F.col("event_id") % 3 == 0, F.lit("18446744073709551615").cast("decimal(20,0)")).otherwise(F.col("event_id").cast("decimal(20,0)"))
    return files.explicit(e.select("event_id", big.alias("u"), F.expr("make_dt_interval(0, 0, 0, cast(event_id as decimal(18,6)) / 1000)").alias("took")))


@C.query
def codec_roundtrip(spark, sf_dir):
    """Nested, binary and typed values as text, by codecs that fields name or types give, and back; a codec of one's own."""
    if "hex of the engine" not in codecs.CODECS:
        codecs.register("hex of the engine", codecs.Codec(lambda c, t: F.lower(F.hex(c)), lambda c, t: F.unhex(c)))
    c = C.table(spark, sf_dir, "customer")
    own = F.encode("c_name", "UTF-8").alias("raw", metadata={"codec": "hex of the engine"})
    d = c.select("c_custkey", F.struct("c_mktsegment", "c_nationkey").alias("place"), F.create_map(F.lit("balance"), F.col("c_acctbal")).alias("amounts"), F.encode("c_mktsegment", "UTF-8").alias("bytes"), own)
    text = codecs.encoded(d, ["place", "amounts", "bytes"])
    path = files.scratch(spark, "codecs")
    text.write.csv(path + "/c", header=True)
    back = codecs.decoded(spark.read.schema("c_custkey long, place string, amounts string, bytes string, raw string").csv(path + "/c", header=True).select(*(F.col(f.name).alias(f.name, metadata=f.metadata) for f in text.schema.fields)))
    return back.select("c_custkey", F.col("place.c_mktsegment").alias("segment"), F.col("place.c_nationkey").alias("nation"), F.col("amounts")["balance"].alias("balance"), F.decode("bytes", "UTF-8").alias("bytes"), F.decode("raw", "UTF-8").alias("name"))


@C.query
def ipv6_base64url(spark, sf_dir):
    """Addresses with colons as URL-safe base64 and back, in canonical text."""
    e = F.col("event_id")
    parts = [F.lower(F.hex(x)) for x in (e % 7 + 1, e * 0, e % 3 * 0, e % 5, e * 0, e * 0, e % 2, e % 65535 + 1)]
    text = F.concat_ws(":", *parts)
    rows = C.observations(spark, sf_dir).select("event_id", text.alias("given")).withColumn("raw", S.ip_bytes(F.col("given"))).withColumn("text", S.ip_text(F.col("raw")))
    return rows.select("event_id", "given", S.base64url(F.col("raw")).alias("token"), (S.ip_bytes(F.col("text")) == F.col("raw")).alias("same"), F.length("text").cast("long").alias("n"))


@C.query
def domains(spark, sf_dir):
    """Which values are in a domain of simulated traffic."""
    e = C.observations(spark, sf_dir)
    p = F.element_at(F.array(*map(F.lit, ("udp", "tcp", "http", "icmp"))), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select("event_id", simulate.in_domain(p, simulate.PROTOCOLS).alias("protocol"), simulate.valid_port(F.col("event_id") * 97 - 50).alias("port"))


@C.query
def address_pool(spark, sf_dir):
    """Addresses issued and released by events: out now, ever out, capacity."""
    e = C.observations(spark, sf_dir).select(F.concat(F.lit("ip-"), (F.col("event_id") % 97).cast("string")).alias("value"), F.struct("at_us", "event_id").alias("at"), F.when(F.col("value") < 50, 1).otherwise(-1).alias("change"))
    return simulate.pool_counts(e, 100)


@C.query
def simulated_draws(spark, sf_dir):
    """Distributions of drawn values: their means and bounds, and that a draw depends on its row alone."""
    d = spark.range(50_000)
    draws = {"p": simulate.poisson(5, 1, "id"), "u": simulate.uniform_int(2, 4, 2, "id"), "n": simulate.bounded_normal_int(10, 3, 0, 20, 3, "id"), "c": simulate.bounded_normal_int(10, 3, 0, 12, 3, "id"), "q": simulate.uniform_probability(0.2, 0.4, 4, "id"), "m": simulate.uniform_millis(5, 9, 5, "id"), "r": simulate.fixed_rate(3)}
    v = d.select("id", *(x.alias(k) for k, x in draws.items()))
    again = d.repartition(7).select("id", *(x.alias(f"{k}2") for k, x in draws.items()))
    near = lambda c, mean, by: (F.abs(F.avg(c) - mean) < by)
    same = F.min(F.when(F.struct(*draws) == F.struct(*(F.col(f"{k}2") for k in draws)), 1).otherwise(0)) == 1
    return v.join(again, "id").agg(
        near("p", 5, 0.1).alias("poisson"), (F.abs(F.var_pop("p") - 5) < 0.3).alias("poisson_spread"), ((F.min("u") == 2) & (F.max("u") == 4) & near("u", 3, 0.05)).alias("uniform"), near("n", 10, 0.1).alias("normal"),
        (F.max("c") == 12).alias("clipped"), ((F.min("q") >= 0.2) & (F.max("q") < 0.4)).alias("probability"), ((F.min("m") == 5) & (F.max("m") == 8)).alias("millis"), (F.max("r") == 3).alias("rate"), same.alias("repeatable"),
    )


@C.query
def simulated_events(spark, sf_dir):
    """Messages of each epoch: as many as its rate, within its time."""
    e = simulate.epochs(spark, 0, 3_600_000, 60_000, inclusive_end=True)
    m = simulate.events(spark, e, F.col("epoch") % 4, F.concat(F.lit("twin.sim."), F.col("n").cast("string")))
    return m.groupBy("epoch").agg(F.count("*").alias("n"), F.max("subject").alias("last"), F.min((F.col("at_ms") >= F.col("epoch") * 60_000) & (F.col("at_ms") < (F.col("epoch") + 1) * 60_000)).alias("inside"))


@C.query
def issued_values(spark, sf_dir):
    """Values that a pool issues: distinct and of one width."""
    return simulate.pool(spark, 1000, "imsi-").agg(F.count("*").alias("n"), F.count_distinct("value").alias("values"), F.max(F.length("value")).cast("long").alias("width"))


@C.query
def grouping_sets(spark, sf_dir):
    """Aggregates over named sets of columns in one pass."""
    C.table(spark, sf_dir, "lineitem").createOrReplaceTempView("grouped_lines")
    return spark.sql("select l_returnflag, l_linestatus, cast(year(l_shipdate) as bigint) as y, count(*) as n, max(l_quantity) as most from grouped_lines group by grouping sets ((l_returnflag, l_linestatus), (l_returnflag, year(l_shipdate)), ())")


@C.query
def approximate_aggregates(spark, sf_dir):
    """Sketches of distinct counts and quantiles, merged from parts, against the exact values."""
    e = C.table(spark, sf_dir, "lineitem")
    parts = e.groupBy("l_returnflag").agg(F.hll_sketch_agg("l_partkey").alias("s"))
    whole = parts.agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("n"))
    q = e.agg(F.percentile_approx("l_quantity", 0.5, 10_000).alias("median"), F.approx_count_distinct("l_partkey", 0.02).alias("d"), F.percentile("l_quantity", 0.5).alias("middle"))
    # Beside the sketches, count_distinct would keep a set of them for each distinct value.
    exact = e.select("l_partkey").distinct().agg(F.count("l_partkey").alias("exact"))
    return whole.crossJoin(F.broadcast(q)).crossJoin(F.broadcast(exact)).select((F.abs(F.col("n") - F.col("exact")) <= 0.05 * F.col("exact")).alias("sketch"), (F.abs(F.col("d") - F.col("exact")) <= 0.08 * F.col("exact")).alias("distinct_count"), (F.abs(F.col("median") - F.col("middle")) <= 1).alias("quantile"), "exact")  # one row each


@C.query
def downsample_kinds(spark, sf_dir):
    """Slots and their aggregates beside the comparison with the slot before."""
    d = transform.aggregate(C.observations(spark, sf_dir), ["event_type"], "at_us", 24 * C.HOUR_US, [F.count("*").alias("n")])
    return transform.compare(d, ["event_type"], ["slot"], ["n"]).select("event_type", "slot", "n", "n_before", "n_changed")


_HEADER_ERROR = """case when eid0 = 'zero' then '{a} entity id is zero' when eid = 'zero' then '{b} entity id is zero' when eid0 <> eid then 'entity id mismatch' when cid0 <> cid then 'chain id mismatch'"""
_TWINS = f"{HEADERS}, v as (select p.*, o.value, lag(o.value) over (partition by p.user_id order by p.at_us, p.event_id) as value0 from p join o using (event_id))"

ORACLE_SQL: dict[str, str] = {
    "diff_with_header": f"""with {_TWINS}, c as (select *, {_HEADER_ERROR.format(a='first', b='second')} when seq < seq0 then 'sequence decreasing' when eff < eff0 then 'effective time before the first''s' end as error from v where id0 is not null)
      select event_id, error, case when error is null then seq end as sequence, case when error is null then null end::bigint as origins, case when error is null then (event_type <> type0)::tinyint end as kind_op, case when error is null and value <> value0 then value end as value,
      case when error is null then case when event_type <> type0 then event_type else '' end end as added, case when error is null then case when event_type <> type0 then type0 else '' end end as removed from c""",
    "apply_with_header": f"""with {_TWINS}, c as (select *, {_HEADER_ERROR.format(a='snapshot', b='delta')} when seq <= seq0 then 'sequence not increasing' when eff < eff0 then 'effective time before the snapshot''s' when closed0 then 'chain closed' end as error from v where id0 is not null)
      select event_id, error, case when error is null then seq end as sequence, case when error is null then eff end as effective_us, case when error is null then type0 || '>' || event_type end as lineage, case when error is null then event_type end as kind,
      case when error is null then event_type end as kinds, case when error is null then id0 end as hidden from c""",
    "coalesce_with_header": f"""with {OBS}, n as (select *, row_number() over (partition by user_id order by at_us, event_id) as seq, at_us // 86400000000 as slot from o),
      b as (select user_id, min(slot) filter (where user_id % 7 = 0 and slot = 19732) as bad from n group by user_id),
      k as (select n.user_id, bad, seq, event_type, at_us, event_id from n join b using (user_id) where bad is null or slot < bad)
      select b.user_id, case when b.bad is not null then 'chain id mismatch' end as error, case when b.bad is null then max(seq) end as sequence, case when b.bad is null then string_agg(event_type, '>' order by at_us, event_id) end as lineage,
      case when b.bad is null then string_agg(distinct event_type, ',' order by event_type) end as kinds, case when b.bad is null then -1 end::bigint as hidden from b left join k using (user_id) group by b.user_id, b.bad""",
    "full_deltas": f"with {PAIRS} select o_orderkey, 1::tinyint as status_op, 1::tinyint as priority_op, s as status, t as price, pr as priority, -7::bigint as hidden from d where k0 is not null",
    "empty_deltas": f"with {PAIRS} select o_orderkey, s is not distinct from s0 as same_status, s is not distinct from s0 and t is not distinct from t0 and pr is not distinct from pr0 as unchanged from d where k0 is not null",
    "delta_schemas": """select * from (values ('order.key', 'bigint'), ('order.status', 'struct<op:tinyint,value:string>'), ('order.price', 'struct<op:tinyint,value:double>'), ('order.priority', 'struct<op:tinyint,value:string>'), ('state.key', 'bigint'),
      ('state.kinds', 'struct<added:array<string>,removed:array<string>>'), ('state.last', 'struct<removed:array<string>,updated:map<string,bigint>>'), ('state.seen', 'struct<op:tinyint,value:bigint>'),
      ('may be string', 'key'), ('may be struct', 'key'), ('may be double', 'refused'), ('may be array', 'refused'), ('may be nested', 'refused')) t(name, kind)""",
    "chain_anchors": """select event_id, null::varchar as birth_birth, case when event_id <> 0 then 'a birth has sequence 0' end as cadence_birth, case when event_id <= 0 then 'a cadence snapshot has a sequence above 0' end as cadence_cadence, null::varchar as end_terminator,
      'a cadence snapshot has no anchor fields' as end_cadence, null::varchar as next_birth, 'two' as successor, 'one' as predecessor, 0::bigint as next_sequence, event_id + 3 as turned_sequence, 'c' as writer from events""",
    "provenance_elision": f"""with {OBS} select event_id, case when event_type = 'view' then 'source' else 'source>' || event_type end as kept, last_value(case when event_type <> 'view' then event_type end ignore nulls) over (partition by user_id order by at_us, event_id rows unbounded preceding) as last from o""",
    "rules_from_json": f"with {ASSERTED} select event_id, si, di, ttl, exp from a",
    "routes_from_json": f"with {EDGES} select event_id, 'out.user.' || user_id || '.to.' || coalesce(di, '') as egress from o left join e on e.si = o.user_id::varchar",
    "parquet_roundtrip": f"with {SETS} select *, 'refused' as wrong from s",
    "sets_json_files": f"with {SETS} select * from s",
    "upsert_table": "select o_custkey, o_orderkey, o_orderstatus from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders) where rn = 1 and o_orderstatus <> 'F'",
    "served_view": f"with {OBS} select event_type, count(*) as n, max(event_id) as last from (select *, row_number() over (partition by user_id order by at_us desc, event_id desc) as rn from o) where rn = 1 group by event_type",
    "key_lives": f"with {ASSERTED} select si, min(at_ms) as created_ms, min(at_ms) + 86400000 as dies_ms from a where ttl > 0 group by si",
    "relation_sets_quantised": f"""with {ASSERTED}, l as (select *, row_number() over (partition by si, di order by at_us desc, event_id desc) as rn from a), e as (select * from l where rn = 1 and ttl > 0),
      k as (select sid, st, si, dt, max_by(at_ms, (at_us, event_id)) as ts, max(ttl) as most from a group by all)
      select k.sid, k.st, k.si, k.dt, k.ts, count(e.di) as n, coalesce(string_agg(e.di, ',' order by e.di), '') as members, coalesce(string_agg(e.q::varchar, ',' order by e.di), '') as exps from k left join e using (sid, st, si, dt) where most > 0 group by k.sid, k.st, k.si, k.dt, k.ts""",
    "relation_reverse_edges": f"with {EDGES} select distinct di, si from e",
    "schema_annotation": """select * from (values ('key', 'c_custkey', 'INT64'), ('c_name', 'c_name', 'BYTE_ARRAY/String'), ('c_nationkey', 'c_nationkey', 'INT32'), ('c_acctbal', 'c_acctbal', 'DOUBLE'), ('c_mktsegment', 'c_mktsegment', 'BYTE_ARRAY/String'), ('Tags', 'Tags', 'LIST'),
      ('pump_snapshot', 'PumpSnapshot', 'snake'), ('http_server', 'HTTPServer', 'snake'), ('ar_snapshot2', 'arSnapshot2', 'snake'), ('plain', 'plain', 'snake'), ('b', 'a', '1 warning'), ('sha256', 'hash', 'option')) t(name, origin, physical)""",
    "explicit_types": "select event_id, case when event_id % 3 <> 0 then event_id end as u, event_id * 1000000 as took from events",
    "codec_roundtrip": "select c_custkey, c_mktsegment as segment, c_nationkey as nation, c_acctbal as balance, c_mktsegment as bytes, c_name as name from customer",
    "ipv6_base64url": r"""with e as (select event_id, [event_id % 7 + 1, 0, 0, event_id % 5, 0, 0, event_id % 2, event_id % 65535 + 1] as g from events),
      t as (select event_id, g, lower(array_to_string(list_transform(g, lambda x: printf('%x', x)), ':')) as given from e),
      r as (select *, case when event_id % 5 = 0 and event_id % 2 = 0 then [1, 6] when event_id % 5 = 0 then [1, 5] else case when event_id % 2 = 0 then [4, 3] else [1, 2] end end as z from t)
      select event_id, given, translate(to_base64(from_hex(array_to_string(list_transform(g, lambda x: printf('%04x', x)), ''))), '+/', '-_') as token, true as same,
      length(array_to_string(list_transform(g[:z[1]], lambda x: printf('%x', x)), ':') || '::' || array_to_string(list_transform(g[z[1] + z[2] + 1:], lambda x: printf('%x', x)), ':'))::bigint as n from r""",
    "domains": "select event_id, event_id % 4 <> 2 as protocol, event_id * 97 - 50 between 0 and 65535 as port from events",
    "address_pool": f"with {OBS}, l as (select event_id % 97 as v, max_by(case when value < 50 then 1 else -1 end, (at_us, event_id)) as c from o group by 1) select count(*) filter (where c > 0) as issued, count(*) as visited, 100::bigint as capacity from l",
    "simulated_draws": "select true as poisson, true as poisson_spread, true as uniform, true as normal, true as clipped, true as probability, true as millis, true as rate, true as repeatable",
    "simulated_events": "select epoch, epoch % 4 as n, 'twin.sim.' || (epoch % 4 - 1) as last, true as inside from range(61) t(epoch) where epoch % 4 > 0",
    "issued_values": "select 1000::bigint as n, 1000::bigint as values, 17::bigint as width",
    "grouping_sets": "select l_returnflag, l_linestatus, year(l_shipdate) as y, count(*) as n, max(l_quantity) as most from lineitem group by grouping sets ((l_returnflag, l_linestatus), (l_returnflag, year(l_shipdate)), ())",
    "approximate_aggregates": "select true as sketch, true as distinct_count, true as quantile, count(distinct l_partkey) as exact from lineitem",
    "downsample_kinds": f"""with {OBS}, d as (select event_type, (at_us // 86400000000) * 86400000000 as slot, count(*) as n from o group by all)
      select event_type, slot, n, lag(n) over w as n_before, lag(n) over w <> n as n_changed from d window w as (partition by event_type order by slot)""",
}
