"""Queries over the driver's tables, by name, and the SQL that says the same.

Results are flat: arrays and maps are joined to text, hashes are hex, so that both engines compare by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinloom.functions import collections as K
from twinloom.functions import encoding, lineprotocol
from twinloom.functions import subjects as S
from twinloom.operators import chain, delta, header, relations, routes, rules, schema, tabulate, transform
from twinloom.plans.oracle import ORACLE_SQL  # noqa: F401
from twinloom.sources import files, simulate

DAY = 86_400_000
HOUR_US = 3_600_000_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with files.option(spark, "spark.sql.session.timeZone", "UTC"):
            return f(spark, sf_dir)

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    QUERIES[f.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


RULES = [
    rules.Rule("twin.sol.*.obs.user.*.type.*.*.attach", DAY, "user", "type", 5, 7, quantum_ms=60_000),
    rules.Rule("twin.sol.*.obs.user.*.type.*.*.detach", 0, "user", "type", 5, 7, quantum_ms=60_000),
]
ORDER = ["at_us", "event_id"]


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages: values under 20 detach what the others attach."""
    e = table(spark, sf_dir, "events").withColumn("at_us", F.unix_micros(F.col("ts").cast("timestamp")))
    action = F.when(F.col("value") < 20, "detach").otherwise("attach")
    parts = F.concat_ws(".", F.lit("twin.sol.s1.obs.user"), F.col("user_id").cast("string"), F.lit("type"), "event_type", F.col("event_id").cast("string"), action)
    return e.select("event_id", "user_id", "event_type", "value", "props", "at_us", F.expr("at_us div 1000").alias("at_ms"), parts.alias("subject"))


def asserted(spark: SparkSession, sf_dir: str, quantise: bool = False) -> DataFrame:
    return rules.assertions(observations(spark, sf_dir), RULES, quantise=quantise)


def user_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.relation_sets(asserted(spark, sf_dir), ORDER)


def user_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.edges(asserted(spark, sf_dir), ORDER)


def keyed(edges: DataFrame) -> DataFrame:
    return edges.select(S.relation_key(F.col("sid"), F.col("st"), F.col("si"), F.col("dt")).alias("key"), "di", "exp")


def joined(field: str, column: str = "r") -> Column:
    return F.array_join(F.transform(column, lambda x: x[field].cast("string")), ",")


# ---------------------------------------------------------------- subjects


@query
def subject_tokens(spark, sf_dir):
    t, b = S.tokens(F.col("subject")), S.bounded_tokens(F.col("subject"), 5)
    return observations(spark, sf_dir).select("event_id", F.size(t).cast("long").alias("n"), S.token(t, 5).alias("t5"), S.token(t, 9).alias("t9"), S.token(t, 10).alias("t10"), F.size(b).cast("long").alias("n_bounded"), S.token(b, 6).alias("rest"))


@query
def subject_match(spark, sf_dir):
    s = F.col("subject")
    d = observations(spark, sf_dir)
    flags = {"one": "twin.sol.*.obs.user.*.type.click.>", "tail": "twin.sol.s1.>", "short": "twin.sol.*", "exact": "twin.sol.s1.obs.user.1.type.view.1.attach"}
    return d.select("event_id", *(S.matches(s, p).alias(k) for k, p in flags.items()))


@query
def pushed_match(spark, sf_dir):
    """A pattern on a stored column: its literal head is pushed to the scan."""
    return table(spark, sf_dir, "customer").where(S.matches(F.col("c_name"), "Customer#000000001")).select("c_custkey", "c_name")


# ---------------------------------------------------------------- assertions


@query
def assertions(spark, sf_dir):
    a = asserted(spark, sf_dir)
    return a.select("event_id", "sid", "st", "si", "dt", "di", "ttl", "exp", S.relation_key(F.col("sid"), F.col("st"), F.col("si"), F.col("dt")).alias("kv_key"), S.assertion_subject(F.col("sid"), F.col("st"), F.col("dt")).alias("assert_subject"))


@query
def assertions_quantised(spark, sf_dir):
    return asserted(spark, sf_dir, True).select("event_id", "si", "di", "ttl", "exp")


@query
def assertion_errors(spark, sf_dir):
    """Matches with too few tokens go aside with an error."""
    m = observations(spark, sf_dir).select("event_id", "at_ms", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("twin.sol.s1.obs.user."), F.col("user_id").cast("string"))).otherwise(F.col("subject")).alias("subject"))
    return rules.assertions(m, [rules.Rule("twin.sol.>", DAY, "user", "type", 5, 7)]).select("event_id", "si", "di", "error")


@query
def assertion_dedup(spark, sf_dir):
    a = rules.deduplicated(asserted(spark, sf_dir, True), ORDER)
    return a.select("msg_id", "event_id", "si", "di", "ttl", "exp")


# ---------------------------------------------------------------- relation sets


def _flat(sets: DataFrame) -> DataFrame:
    return sets.select("sid", "st", "si", "dt", "ts", F.size("r").cast("long").alias("n"), joined("di").alias("members"), joined("exp").alias("exps"))


@query
def relation_sets(spark, sf_dir):
    return _flat(user_sets(spark, sf_dir))


@query
def relation_sets_incremental(spark, sf_dir):
    """Half of the history folded first, the rest applied to its sets: the same result."""
    a = asserted(spark, sf_dir)
    cut = 1_705_276_800_000_000
    return _flat(relations.apply_assertions(relations.relation_sets(a.where(F.col("at_us") < cut), ORDER), a.where(F.col("at_us") >= cut), ORDER))


@query
def relation_sets_phantom(spark, sf_dir):
    a = asserted(spark, sf_dir).withColumn("si", F.concat("si", F.lit("-"), (F.col("event_id") % 7).cast("string")))
    return _flat(relations.relation_sets(a, ORDER, phantom=True))


@query
def relation_live_asof(spark, sf_dir):
    return relations.live(user_edges(spark, sf_dir), F.lit(1_706_600_000_000)).select("si", "di", "exp")


@query
def relation_expiries(spark, sf_dir):
    return relations.expiries(user_edges(spark, sf_dir), F.lit(1_706_600_000_000)).select("si", "di", "ttl", "exp")


@query
def retractions_of_unknown(spark, sf_dir):
    a = asserted(spark, sf_dir).withColumn("si", F.concat("si", F.lit("-"), (F.col("event_id") % 23).cast("string")))
    return relations.unknown_retractions(a, relations.relation_sets(a, ORDER)).select("event_id", "si", "di")


@query
def relation_reverse(spark, sf_dir):
    return relations.reverse(user_edges(spark, sf_dir)).select("di", F.size("sources").cast("long").alias("n"), F.array_join("sources", ",").alias("sources"))


@query
def constraint_one_to_one(spark, sf_dir):
    e = table(spark, sf_dir, "orders").groupBy(F.lit("s1").alias("sid"), F.lit("customer").alias("st"), F.col("o_custkey").cast("string").alias("si"), F.lit("priority").alias("dt"), F.col("o_orderpriority").alias("di"))
    rows = e.agg(F.max("o_orderkey").alias("exp")).withColumn("ttl", F.lit(1).cast("long"))
    kept, gone = relations.constrain(rows, order=["exp"])
    return kept.select("si", "di", "exp", F.lit("kept").alias("verdict")).unionByName(gone.select("si", "di", "exp", F.lit("retracted").alias("verdict")))


@query
def relation_set_json(spark, sf_dir):
    s = user_sets(spark, sf_dir).select(F.to_json(F.struct("sid", "st", "si", "dt", "ts", "r")).alias("json"))
    back = s.select(F.from_json("json", f"sid string, st string, si string, dt string, ts bigint, r {relations.RELATION}").alias("s")).select("s.*")
    return _flat(back)


# ---------------------------------------------------------------- routes


def _route(transform_: str, **references: str) -> routes.Route:
    return routes.Route("r", "twin.sol.s1.obs.user.*.type.>", transform_, references)


USER_TYPES = "twin.sol.${2}.r.kv.user.${5}.type.set"


@query
def route_token_only(spark, sf_dir):
    return routes.expand(observations(spark, sf_dir), _route("out.${7}.user-${5}.${9}"), keyed(user_edges(spark, sf_dir))).select("event_id", "egress")


@query
def route_fanout(spark, sf_dir):
    """Each message to every type that its user relates to."""
    return routes.expand(observations(spark, sf_dir), _route("out.user.${5}.to.${types}", types=USER_TYPES), keyed(user_edges(spark, sf_dir))).select("event_id", "egress")


@query
def route_live(spark, sf_dir):
    r = routes.expand(observations(spark, sf_dir), _route("out.${5}.${types}", types=USER_TYPES), keyed(user_edges(spark, sf_dir)), as_of_ms=F.lit(1_706_600_000_000))
    return r.select("event_id", "egress")


@query
def route_cross_product(spark, sf_dir):
    """Two relation sets: all combinations of a user's types and its nation's suppliers.

    The nation is looked up on a level of its own, so suppliers are kept once a nation and not once a customer.
    """
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    nations = c.select(F.concat(F.lit("twin.sol.s1.r.kv.user."), F.col("c_custkey").cast("string"), F.lit(".nation.set")).alias("key"), F.col("c_nationkey").cast("string").alias("di"))
    suppliers = s.select(F.concat(F.lit("twin.sol.s1.r.kv.nation."), F.col("s_nationkey").cast("string"), F.lit(".supplier.set")).alias("key"), F.col("s_suppkey").cast("string").alias("di"))
    one = routes.expand(observations(spark, sf_dir), _route("at.${2}.${5}.${nation}", nation="twin.sol.${2}.r.kv.user.${5}.nation.set"), nations, on_empty="blank").select("event_id", F.col("egress").alias("subject"))
    r = routes.Route("x", "at.*.*.*", "x.${types}.y.${suppliers}.z.${2}", {"types": "twin.sol.${1}.r.kv.user.${2}.type.set", "suppliers": "twin.sol.${1}.r.kv.nation.${3}.supplier.set"})
    return routes.expand(one, r, keyed(user_edges(spark, sf_dir)).select("key", "di").unionByName(suppliers)).select("event_id", "egress")


def _sparse(spark, sf_dir) -> DataFrame:
    return keyed(user_edges(spark, sf_dir)).where(F.col("di").isin("click", "view") & ~F.col("key").contains("user.1"))


@query
def route_elide(spark, sf_dir):
    return routes.expand(observations(spark, sf_dir), _route("out.${types}.${5}", types=USER_TYPES), _sparse(spark, sf_dir)).select("event_id", "egress")


@query
def route_blank(spark, sf_dir):
    return routes.expand(observations(spark, sf_dir), _route("out.${types}.${5}", types=USER_TYPES), _sparse(spark, sf_dir), on_empty="blank").select("event_id", "egress")


@query
def route_out_of_range(spark, sf_dir):
    return routes.expand(observations(spark, sf_dir), _route("out.${5}.${12}"), keyed(user_edges(spark, sf_dir))).select("event_id", "egress", "route_error")


@query
def route_hierarchy(spark, sf_dir):
    """Nation subjects to their customers' orders, over two levels of relations."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    of_nation = c.select(F.concat(F.lit("twin.n."), F.col("c_nationkey").cast("string")).alias("key"), F.col("c_custkey").cast("string").alias("di"))
    of_customer = o.select(F.concat(F.lit("twin.c."), F.col("o_custkey").cast("string")).alias("key"), F.col("o_orderkey").cast("string").alias("di"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("geo."), F.col("n_nationkey").cast("string")).alias("subject"))
    one = routes.expand(n, routes.Route("n", "geo.*", "geo.${1}.${customers}", {"customers": "twin.n.${1}"}), of_nation).select(F.col("egress").alias("subject"))
    return routes.expand(one, routes.Route("c", "geo.*.*", "geo.${1}.${2}.${orders}", {"orders": "twin.c.${2}"}), of_customer).select("egress")


@query
def route_many(spark, sf_dir):
    """Several routes: one is disabled, one replaces an earlier one of the same id."""
    rs = [
        routes.Route("a", "twin.sol.*.obs.user.*.type.click.>", "old.${5}"),
        routes.Route("b", "twin.sol.*.obs.user.*.type.view.>", "b.${5}"),
        routes.Route("c", "twin.sol.>", "c.${5}", disabled=True),
        routes.Route("a", "twin.sol.*.obs.user.*.type.click.>", "a.${5}.${types}", {"types": USER_TYPES}),
    ]
    return routes.expand_all(observations(spark, sf_dir), rs, keyed(user_edges(spark, sf_dir))).select("event_id", "route_id", "egress")


@query
def payload_pass_through(spark, sf_dir):
    """Payload and columns of a message stand unchanged beside each of its expansions."""
    m = observations(spark, sf_dir).withColumnRenamed("props", "payload")
    return routes.expand(m, _route("p.${5}.${types}", types=USER_TYPES), keyed(user_edges(spark, sf_dir))).select("event_id", "egress", "payload", "value", "at_us")


# ---------------------------------------------------------------- tables


@query
def latest_per_key(spark, sf_dir):
    return tabulate.latest(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice", F.col("o_orderdate").cast("timestamp").alias("at")), ["o_custkey"], ["at", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")


@query
def latest_with_deletes(spark, sf_dir):
    rows = observations(spark, sf_dir).select("user_id", "event_id", "at_us", "event_type", (F.col("event_type") == "error").alias("gone"))
    return tabulate.latest(rows, ["user_id"], ["at_us", "event_id"], "gone").select("user_id", "event_id", "event_type")


@query
def view_containment(spark, sf_dir):
    sets = user_sets(spark, sf_dir).select("si", F.transform("r", lambda x: x["di"]).alias("members"))
    wanted = table(spark, sf_dir, "region").select(F.element_at(F.array(*map(F.lit, ("click", "view", "error", "signup", "purchase"))), (F.col("r_regionkey") + 1).cast("int")).alias("member"), "r_name")
    return tabulate.containing(sets, wanted).select("si", "member", "r_name")


@query
def view_superset(spark, sf_dir):
    sets = user_sets(spark, sf_dir).select(F.col("si").alias("k"), F.transform("r", lambda x: x["di"]).alias("members"))
    return tabulate.superset_pairs(sets, sets.where(F.size("members") > 0), "k", "members")


@query
def synthesise_mapping(spark, sf_dir):
    s = user_sets(spark, sf_dir)
    return transform.synthesise(s, F.concat(F.lit("user="), "si", F.lit(";types="), joined("di"), F.lit(";n="), F.size("r").cast("string"))).select("si", "payload")


# ---------------------------------------------------------------- entity ids


@query
def entity_id_sha256_scalar(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", F.lower(F.hex(encoding.entity_id(F.col("c_name"), T.StringType(), "sha256"))).alias("by_name"), F.lower(F.hex(encoding.entity_id(F.col("c_custkey") - 500, T.LongType(), "sha256"))).alias("by_key"))


KEY_TYPE = T.StructType([T.StructField("order", T.LongType(), True, {"origin": "Order"}), T.StructField("line", T.IntegerType(), True, {"origin": "Line"}), T.StructField("flag", T.StringType(), True, {"origin": "Flag"})])


@query
def entity_id_sha256_struct(spark, sf_dir):
    k = F.struct(F.col("l_orderkey").alias("order"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("flag"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.lower(F.hex(encoding.entity_id(k, KEY_TYPE, "sha256"))).alias("id"))


@query
def entity_id_blake2b(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.lower(F.hex(encoding.entity_id(F.col("c_name"), T.StringType()))).alias("id"))


# ---------------------------------------------------------------- deltas

ORDER_TWIN = schema.TwinSchema(
    T.StructType([schema.tagged("key", T.LongType(), schema.KEY), schema.tagged("status", T.StringType()), schema.tagged("price", T.DoubleType()), schema.tagged("priority", T.StringType(), schema.COMMUTATIVE), schema.tagged("hidden", T.LongType(), schema.OMIT)]),
    header=False, hash="sha256",
)


def order_pairs(spark, sf_dir) -> DataFrame:
    """Orders of a customer as snapshots; each with the one before it."""
    o = table(spark, sf_dir, "orders").withColumn("at", F.unix_micros(F.col("o_orderdate").cast("timestamp")))
    low = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority"))
    s = o.select("o_custkey", "o_orderkey", "at", F.struct(F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), low.alias("priority"), F.col("o_orderkey").alias("hidden")).alias("b"))
    w = Window.partitionBy("o_custkey").orderBy("at", "o_orderkey")
    return s.withColumn("a", F.lag("b").over(w)).where(F.col("a").isNotNull())


@query
def diff_atomic(spark, sf_dir):
    d = order_pairs(spark, sf_dir).withColumn("d", delta.diff(F.col("a"), F.col("b"), ORDER_TWIN)["delta"])
    return d.select("o_orderkey", F.col("d.key").alias("key"), *(F.col(f"d.{f}.{p}").alias(f"{f}_{p}") for f in ("status", "price", "priority") for p in ("op", "value")))


@query
def apply_roundtrip(spark, sf_dir):
    """apply(a, diff(a, b)) is b but for the suppressed field, which stays a's."""
    d = order_pairs(spark, sf_dir).withColumn("d", delta.diff(F.col("a"), F.col("b"), ORDER_TWIN)["delta"])
    return d.withColumn("r", delta.apply(F.col("a"), F.col("d"), ORDER_TWIN)["snapshot"]).select("o_orderkey", "r.key", "r.status", "r.price", "r.priority", "r.hidden")


PROFILE = T.StructType([T.StructField("segment", T.StringType()), T.StructField("nation", T.IntegerType())])
CUSTOMER_TWIN = schema.TwinSchema(T.StructType([schema.tagged("key", T.LongType(), schema.KEY), schema.tagged("profile", PROFILE, schema.NESTED), schema.tagged("home", PROFILE, f"{schema.NESTED},{schema.CLEARABLE}")]), header=False)


@query
def diff_nested_struct(spark, sf_dir):
    """Each customer against the next of its nation, as if one had become the other."""
    c = table(spark, sf_dir, "customer")
    p = F.struct(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    home = F.when(F.col("c_custkey") % 3 == 0, F.struct(F.lit("").alias("segment"), F.lit(0).alias("nation"))).otherwise(p)
    s = c.select("c_custkey", "c_nationkey", F.struct(F.col("c_nationkey").cast("long").alias("key"), p.alias("profile"), home.alias("home")).alias("b"))
    s = s.withColumn("a", F.lag("b").over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))).where("a is not null")
    d = s.withColumn("d", delta.diff(F.col("a"), F.col("b"), CUSTOMER_TWIN)["delta"])
    r = d.withColumn("r", delta.apply(F.col("a"), F.col("d"), CUSTOMER_TWIN)["snapshot"])
    return r.select("c_custkey", F.col("d.profile.segment.op").alias("segment_op"), F.col("d.profile.segment.value").alias("segment"), F.col("d.profile.nation.op").alias("nation_op"), F.col("d.home.op").alias("home_op"), F.col("d.home.value.segment.value").alias("home_segment"), F.col("r.home.segment").alias("result_segment"))


def _part_sets(spark, sf_dir) -> DataFrame:
    """Brands that a supplier shipped in a year, and in the year before it shipped."""
    l, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    j = l.join(p, l.l_partkey == p.p_partkey).groupBy("l_suppkey", F.year("l_shipdate").alias("y"))
    s = j.agg(F.array_sort(F.collect_set("p_brand")).alias("b"), F.array_sort(F.collect_list(F.struct("p_brand", "l_quantity"))).alias("all"))
    m = s.withColumn("m", F.map_from_entries(F.transform("b", lambda x: F.struct(x, F.size(F.filter("all", lambda q: q["p_brand"] == x)))))).drop("all")
    w = Window.partitionBy("l_suppkey").orderBy("y")
    return m.withColumn("a", F.lag("b").over(w)).withColumn("n", F.lag("m").over(w)).where("a is not null")


@query
def diff_set(spark, sf_dir):
    s = _part_sets(spark, sf_dir)
    added, removed = K.minus(F.col("b"), F.col("a")), K.minus(F.col("a"), F.col("b"))
    back = F.array_sort(K.array_apply(F.col("a"), added, removed))
    return s.select("l_suppkey", "y", F.array_join(added, ",").alias("added"), F.array_join(removed, ",").alias("removed"), F.array_join(back, ",").alias("applied"))


@query
def diff_map(spark, sf_dir):
    s = _part_sets(spark, sf_dir)
    gone, new = K.map_removed(F.col("n"), F.col("m")), K.map_updated(F.col("n"), F.col("m"))
    return s.select("l_suppkey", "y", F.array_join(gone, ",").alias("removed"), K.map_as_text(new).alias("updated"), K.map_as_text(K.map_apply(F.col("n"), gone, new)).alias("applied"))


def _deltas(spark, sf_dir) -> DataFrame:
    """Events of a user as deltas of two fields."""
    o = observations(spark, sf_dir)
    op = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "error", 2).otherwise(1).cast("byte")
    second = F.when(F.col("event_type").isin("click", "view"), 1).otherwise(0).cast("byte")
    return o.select("user_id", F.struct("at_us", "event_id").alias("o"), F.struct(op.alias("op"), F.when(op == 1, F.col("value")).alias("value")).alias("x"), F.struct(second.alias("op"), F.when(second == 1, F.col("event_id")).alias("value")).alias("y"))


@query
def coalesce_deltas(spark, sf_dir):
    d = delta.coalesce_rows(_deltas(spark, sf_dir), ["user_id"], "o", {"x": T.DoubleType(), "y": T.LongType()})
    return d.select("user_id", F.col("x.op").alias("x_op"), F.col("x.value").alias("x_value"), F.col("y.value").alias("y_value"), F.col("o.event_id").alias("last_event"))


@query
def coalesce_partition(spark, sf_dir):
    """Coalescing two parts and then their results gives what coalescing all gives."""
    d, f = _deltas(spark, sf_dir), {"x": T.DoubleType(), "y": T.LongType()}
    cut = F.col("o.at_us") < 1_705_276_800_000_000
    parts = [delta.coalesce_rows(d.where(c), ["user_id"], "o", f) for c in (cut, ~cut)]
    none = F.struct(F.lit(0).cast("byte").alias("op"), F.lit(None).alias("value"))
    both = delta.coalesce_rows(parts[0].unionByName(parts[1]), ["user_id"], "o", f)
    return both.select("user_id", F.coalesce("x.op", none["op"]).alias("x_op"), F.col("x.value").alias("x_value"), F.col("y.value").alias("y_value"))


STATE_TWIN = schema.TwinSchema(T.StructType([schema.tagged("key", T.LongType(), schema.KEY), schema.tagged("kinds", T.ArrayType(T.StringType()), schema.NESTED), schema.tagged("last", T.MapType(T.StringType(), T.LongType()), schema.NESTED), schema.tagged("seen", T.LongType())]), header=False)


def _by_time(x: Column, y: Column) -> Column:
    a, b = (F.struct(v["at_us"], v["event_id"]) for v in (x, y))
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


@query
def coalesce_nested(spark, sf_dir):
    """Events of a user folded in order into a set, a map and a counter-like field."""
    o = observations(spark, sf_dir)
    s, strings, longs = F.col("event_type"), T.ArrayType(T.StringType()), T.MapType(T.StringType(), T.LongType())
    gone = F.when(s == "error", F.array(F.lit("click"), F.lit("view"))).otherwise(F.array(s))
    d = F.struct(
        F.col("user_id").alias("key"), F.struct(F.when(s == "error", F.array().cast(strings)).otherwise(F.array(s)).alias("added"), gone.alias("removed")).alias("kinds"),
        F.struct(F.when(s == "signup", F.array(F.lit("view"))).otherwise(F.array().cast(strings)).alias("removed"), F.create_map(s, F.col("event_id")).cast(longs).alias("updated")).alias("last"),
        F.struct(F.lit(1).cast("byte").alias("op"), F.col("event_id").alias("value")).alias("seen"),
    )
    slot = F.expr(f"at_us div {24 * HOUR_US}").alias("slot")
    days = o.groupBy("user_id", slot).agg(F.array_sort(F.collect_list(F.struct("at_us", "event_id", d.alias("d"))), _by_time).alias("c"))
    one = days.select("user_id", "slot", delta.compose(F.transform("c", lambda x: x["d"]), STATE_TWIN).alias("d"))  # a day's deltas at most in one array
    chains = one.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("slot", "d")), lambda x, y: F.when(x["slot"] < y["slot"], -1).otherwise(1)).alias("c"))
    zero = F.struct(F.col("user_id").alias("key"), F.array().cast(strings).alias("kinds"), F.create_map().cast(longs).alias("last"), F.lit(0).cast("long").alias("seen"))
    r = chains.select("user_id", delta.coalesce_fold(zero, F.transform("c", lambda x: x["d"]), STATE_TWIN)["snapshot"].alias("s"))
    return r.select("user_id", F.array_join(F.array_sort("s.kinds"), ",").alias("kinds"), K.map_as_text(F.col("s.last")).alias("last"), F.col("s.seen").alias("seen"))


@query
def clearable_truth_table(spark, sf_dir):
    """Zero to zero, zero to x, x to x, x to y, x to zero, for a struct, an array and a map."""
    t = T.StructType([schema.tagged("key", T.StringType(), schema.KEY)] + [schema.tagged(n, k, f"{schema.NESTED},{schema.CLEARABLE}") for n, k in (("place", PROFILE), ("tags", T.ArrayType(T.StringType())), ("labels", T.MapType(T.StringType(), T.StringType())))])
    twin = schema.TwinSchema(t, header=False)
    values = {"zero": ("", 0, None, None), "x": ("x", 1, ["x"], {"k": "x"}), "y": ("y", 2, ["y"], {"k": "y"})}
    cases = [("zero", "zero"), ("zero", "x"), ("x", "x"), ("x", "y"), ("x", "zero")]
    row = lambda c, v: (c, (v[0], v[1]), v[2], v[3])
    plain = T.StructType([T.StructField("c", T.StringType()), T.StructField("a", t), T.StructField("b", t)])
    df = spark.createDataFrame([(f"{i}:{a}-{b}", row("k", values[a]), row("k", values[b])) for i, (a, b) in enumerate(cases)], plain)
    d = df.withColumn("d", delta.diff(F.col("a"), F.col("b"), twin)["delta"]).withColumn("r", delta.apply(F.col("a"), F.col("d"), twin)["snapshot"])
    return d.select("c", F.col("d.place.op").alias("place"), F.col("d.tags.op").alias("tags"), F.col("d.labels.op").alias("labels"), (F.col("r.place").eqNullSafe(F.col("b.place")) & F.col("r.tags").eqNullSafe(F.col("b.tags"))).alias("round_trip"))


# ---------------------------------------------------------------- headers and chains


def _headers(spark, sf_dir, whole: bool = False) -> DataFrame:
    """Events as headers, broken in turn so that each check fails somewhere, paired with the one before (`whole`: the first ones too)."""
    o = observations(spark, sf_dir)
    k = F.col("event_id") % 11
    at = F.timestamp_micros(F.when(k == 4, F.col("at_us") - 40 * 24 * HOUR_US).otherwise(F.col("at_us")))
    eid = F.when(k == 1, F.unhex(F.lit("00" * 32))).otherwise(F.unhex(F.sha2(F.when(k == 2, F.lit("other")).otherwise(F.col("user_id").cast("string")), 256)))
    origin = F.array(F.struct(at.alias("published_at"), F.lit(None).cast("timestamp").alias("valid_until"), F.lit("s").alias("solution"), F.col("event_type").alias("component"), F.lit("i").alias("instance"), F.create_map().cast("map<string,string>").alias("metadata")))
    values = {"entity_id": eid, "chain_id": F.when(k == 3, F.lit("z")).otherwise(F.lit("c")), "sequence": F.when(k == 5, F.lit(-1)).otherwise(F.col("event_id")), "effective_at": at, "published_at": at, "provenance": origin, "closed": F.when(k == 6, at)}
    h = F.struct(*(values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in header.SCHEMA.fields))
    w = Window.partitionBy("user_id").orderBy("at_us", "event_id")
    paired = o.select("event_id", "user_id", "at_us", h.alias("d")).withColumn("s", F.lag("d").over(w))
    return paired if whole else paired.where("s is not null")


@query
def header_after_apply(spark, sf_dir):
    r = _headers(spark, sf_dir).withColumn("h", header.header_after_apply(F.col("s"), F.col("d")))
    return r.select("event_id", F.col("h.error").alias("error"), F.col("h.header.sequence").alias("sequence"), F.unix_micros("h.header.effective_at").alias("effective_us"), F.array_join(F.transform("h.header.provenance", lambda x: x["component"]), ">").alias("lineage"))


@query
def header_for_diff(spark, sf_dir):
    r = _headers(spark, sf_dir).withColumn("h", header.header_for_diff(F.col("s"), F.col("d")))
    return r.select("event_id", F.col("h.error").alias("error"), F.col("h.header.sequence").alias("sequence"))


def _chains(spark, sf_dir) -> DataFrame:
    return observations(spark, sf_dir).select(F.col("user_id").alias("chain_id"), F.col("event_id").alias("sequence"), F.col("at_us").alias("published_at"), F.col("at_us").alias("effective_at"), "event_type", "value")


@query
def chain_validation(spark, sf_dir):
    rows = _chains(spark, sf_dir).withColumn("sequence", F.expr("sequence div 2"))
    return chain.validate(rows.withColumn("effective_at", F.when(F.col("value") < 10, 0).otherwise(F.col("effective_at"))).groupBy("chain_id", "sequence").agg(F.max("effective_at").alias("effective_at"))).groupBy("chain_id", "error").agg(F.count("*").alias("n"))


@query
def chain_gaps(spark, sf_dir):
    return chain.gaps(_chains(spark, sf_dir))


@query
def chain_quality(spark, sf_dir):
    q = chain.quality(_chains(spark, sf_dir))
    return q.select("chain_id", F.size("gaps").cast("long").alias("n"), F.array_join(F.transform("gaps", lambda g: F.concat(g["start"].cast("string"), F.lit("-"), g["end"].cast("string"))), ",").alias("gaps"))


@query
def taint_metrics(spark, sf_dir):
    m = chain.taint_metrics(_chains(spark, sf_dir))
    return m.select("chain_id", "frontier", "taint_size", "taint_age", F.round("taint_density", 9).alias("taint_density"))


def _arrivals(spark, sf_dir) -> DataFrame:
    """Sequences per user from 1, some twice, out of order within nearby buckets."""
    o = observations(spark, sf_dir)
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    rows = o.select("user_id", "event_id", seq.alias("sequence"))
    late = F.when(F.col("event_id") % 5 == 0, F.col("sequence") + 4).otherwise(F.col("sequence"))
    once = rows.select("user_id", "sequence", late.alias("arrival"), F.lit(0).alias("copy"), "event_id")
    return once.unionByName(rows.where(F.col("event_id") % 7 == 0).select("user_id", "sequence", (F.col("sequence") + 2).alias("arrival"), F.lit(1).alias("copy"), "event_id"))


@query
def receive_protocol(spark, sf_dir):
    r = chain.receive(_arrivals(spark, sf_dir), "user_id", "sequence", ["arrival", "copy", "sequence"])
    return r.select("user_id", "sequence", "arrival", "copy", "frontier", "verdict")


@query
def receive_with_anchors(spark, sf_dir):
    """Recovery snapshots move the frontier; an accepted terminator ends the chain, a late one doesn't."""
    r = chain.receive(_arrivals(spark, sf_dir), "user_id", "sequence", ["arrival", "copy", "sequence"], recovery=(F.col("event_id") % 31 == 0) & (F.col("copy") == 0), closed=F.col("event_id") % 37 == 0)
    return r.select("user_id", "sequence", "arrival", "copy", "frontier", "verdict")


@query
def materialise_versions(spark, sf_dir):
    v = delta.versions(_deltas(spark, sf_dir), ["user_id"], "o", ["x", "y"])
    return v.select("user_id", F.col("o.event_id").alias("event_id"), "x", "y")


@query
def origin_carry_forward(spark, sf_dir):
    rows = observations(spark, sf_dir).select("event_id", "user_id", "at_us", F.when(F.col("event_id") % 4 == 0, F.col("props")).alias("origin"))
    return chain.carry_forward(rows, "user_id", ["at_us", "event_id"], "origin").select("event_id", "origin")


@query
def provenance_concat(spark, sf_dir):
    o = observations(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("at_us", "event_id", "event_type"))).alias("p"))
    return o.select("user_id", F.array_join(F.transform("p", lambda x: x["event_type"]), ">").alias("lineage"))


@query
def silence_as_close(spark, sf_dir):
    return chain.silence_as_close(observations(spark, sf_dir), "user_id", "at_us", ["event_id"], 3 * HOUR_US).select("user_id", "session", "opened", "last_seen", "n", "closed_at")


@query
def cadence_snapshots(spark, sf_dir):
    rows = observations(spark, sf_dir).select(F.col("user_id").alias("chain_id"), F.col("event_id").alias("sequence"), "at_us")
    return chain.cadence_points(rows, "chain_id", "sequence", "at_us", 24 * HOUR_US, 10).where("due").select("chain_id", "sequence")


@query
def chain_succession(spark, sf_dir):
    """A customer's orders as chains, each naming the next; every fourth forgets its predecessor."""
    o = table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    c = o.select(F.col("o_orderkey").alias("chain_id"), F.lead("o_orderkey").over(w).alias("next_chain_id"), F.when(F.col("o_orderkey") % 4 != 0, F.lag("o_orderkey").over(w)).alias("previous_chain_id"))
    return chain.succession(c)


@query
def chain_disposal(spark, sf_dir):
    rows = _chains(spark, sf_dir)
    return chain.dispose(rows, rows.where("event_type = 'signup' and value < 4")).groupBy("chain_id").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- transformations


@query
def downsample_tumbling(spark, sf_dir):
    d = transform.aggregate(observations(spark, sf_dir), ["event_type"], "at_us", 24 * HOUR_US, [F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max("value").alias("most")])
    return d.select("event_type", "slot", "n", "total", "most")


@query
def downsample_sliding(spark, sf_dir):
    return transform.aggregate(observations(spark, sf_dir), ["event_type"], "at_us", 24 * HOUR_US, [F.count("*").alias("n"), F.min("value").alias("least")], slide=6 * HOUR_US)


@query
def downsample_squash(spark, sf_dir):
    return transform.squash(observations(spark, sf_dir), ["user_id"], "at_us", 24 * HOUR_US, ["at_us", "event_id"]).select("user_id", "slot", "event_id", "value")


@query
def downsample_drop(spark, sf_dir):
    return transform.drop_all_but(observations(spark, sf_dir), ["user_id"], ["at_us", "event_id"], 5).select("user_id", "event_id")


@query
def downsample_rollup(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return transform.roll_up(c, ["r_name", "n_name", "c_mktsegment"], [F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance")])


@query
def compare_predecessor(spark, sf_dir):
    return transform.compare(observations(spark, sf_dir), ["user_id"], ["at_us", "event_id"], ["event_type"]).select("event_id", "event_type_before", "event_type_changed")


@query
def line_protocol(spark, sf_dir):
    o = observations(spark, sf_dir)
    tags = F.create_map(F.lit("user id"), F.col("user_id").cast("string"), F.lit("kind"), F.concat(F.lit("a=b, "), "event_type"))
    fields = {"props": (F.col("props"), T.StringType()), "id": (F.col("event_id"), T.LongType()), "low": (F.col("value") < 20, T.BooleanType())}
    return o.select("event_id", lineprotocol.to_line(F.lit("obs events"), tags, fields, F.col("at_us") * 1000).alias("line"))


@query
def ip_base64url(spark, sf_dir):
    o = observations(spark, sf_dir)
    octets = [(F.col("event_id") * m + a) % 256 for m, a in ((7, 10), (13, 200), (251, 3), (1, 0))]
    text = F.concat_ws(".", *(x.cast("string") for x in octets))
    raw = S.ipv4_bytes(text)
    return o.select("event_id", text.alias("ip"), S.base64url(raw).alias("token"), S.ipv4_text(S.unbase64url(S.base64url(raw))).alias("back"))


@query
def zero_defaults(spark, sf_dir):
    """Missing values of a left join as zeros; a pointer field keeps its null, a missing column is zero."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    j = c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", "o_orderkey", "o_totalprice", "o_orderstatus")
    t = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("o_orderkey", T.LongType(), True, {"pointer": True}), T.StructField("o_totalprice", T.DoubleType()), T.StructField("o_orderstatus", T.StringType()), T.StructField("absent", T.IntegerType())])
    return schema.with_zero_defaults(j, t)


@query
def schema_projection(spark, sf_dir):
    """An embedded struct flattened, outer columns shadowing it, private columns left out."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.lit("outer").alias("c_name"), F.struct(F.lit("inner").alias("c_name"), "c_mktsegment", F.lit(1).alias("_private")).alias("base"))
    return schema.exported(schema.flattened(c, "base"))


@query
def bad_values(spark, sf_dir):
    """Values that don't parse are zero and reported."""
    o = observations(spark, sf_dir)
    v = o.select("event_id", F.when(F.col("event_id") % 9 == 0, "n/a").otherwise(F.col("event_id").cast("string")).alias("a"), F.when(F.col("event_id") % 10 == 0, "x").otherwise(F.col("user_id").cast("string")).alias("b"))
    return schema.try_columns(v, {"a": T.LongType(), "b": T.IntegerType()}).select("event_id", "a", "b", F.array_join("errors", ",").alias("errors"))


@query
def simulation_epochs(spark, sf_dir):
    e = simulate.epochs(spark, 1_704_067_200_000, 3_600_000, 60_000)
    return e.join(table(spark, sf_dir, "region"), F.col("epoch") % 5 == F.col("r_regionkey")).select("epoch", "start_ms", "end_ms", "r_name")


# ---------------------------------------------------------------- relational operators beside the engine's own


@query
def semi_anti(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_totalprice > 400000")
    has = c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey", F.lit("has").alias("kind"))
    return has.unionByName(c.join(o, c.c_custkey == o.o_custkey, "left_anti").where("c_acctbal < 0").select("c_custkey", F.lit("has not").alias("kind")))


@query
def asof_state(spark, sf_dir):
    """The state of a user at each error: the last other event before it, by union and last value."""
    o = observations(spark, sf_dir)
    state = F.when(F.col("event_type") != "error", F.struct("event_id", "event_type"))
    w = Window.partitionBy("user_id").orderBy("at_us", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return o.withColumn("s", F.last(state, True).over(w)).where("event_type = 'error'").select("event_id", F.col("s.event_id").alias("state_event"), F.col("s.event_type").alias("state"))


@query
def interval_join(spark, sf_dir):
    """Purchases within an hour after a click of the same user: equi-join on the user and the slot, then the bounds."""
    o = observations(spark, sf_dir)
    c = o.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click"), F.col("at_us").alias("c"), F.explode(F.array(transform.slots(F.col("at_us"), HOUR_US), transform.slots(F.col("at_us"), HOUR_US) + HOUR_US)).alias("slot"))
    p = o.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase"), F.col("at_us").alias("p"), transform.slots(F.col("at_us"), HOUR_US).alias("slot"))
    return c.join(p, ["user_id", "slot"]).where("p >= c and p <= c + 3600000000").select("click", "purchase")


@query
def set_operations(spark, sf_dir):
    o = observations(spark, sf_dir)
    a, b = (o.where(f"event_type = '{t}'").select("user_id") for t in ("click", "error"))
    tag = lambda d, n: d.select("user_id", F.lit(n).alias("op"))
    return tag(a.intersect(b), "intersect").unionByName(tag(a.exceptAll(b), "except all")).unionByName(tag(a.subtract(b), "except"))


@query
def full_outer(spark, sf_dir):
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    return c.join(s, "k", "full")


@query
def cube_counts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("suppliers"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query
def top_k(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query
def ranking(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(w).cast("long").alias("rn"), F.dense_rank().over(w).cast("long").alias("dr")).where("rn <= 3")


@query
def session_windows(spark, sf_dir):
    """Spark's own session windows; an event exactly at the gap starts anew."""
    o = observations(spark, sf_dir).withColumn("at", F.timestamp_micros("at_us"))
    s = o.groupBy("user_id", F.session_window("at", "3 hours").alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.unix_micros("w.start").alias("opened"), "n")
