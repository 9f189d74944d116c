"""Units of the engine: fixtures and laws."""

import ipaddress
import itertools

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinloom.functions import collections, encoding, lineprotocol
from twinloom.functions import subjects as S
from twinloom.operators import delta, header, relations, routes, rules, schema, tabulate
from twinloom.sources import config, files, simulate

RULES = [rules.Rule("twin.sol.*.obs.3gpp.imei.*.imsi.*.attach", 1_800_000, "imei", "imsi", 6, 8), rules.Rule("twin.sol.*.obs.3gpp.imei.*.imsi.*.detach", 0, "imei", "imsi", 6, 8)]


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_rule_makes_assertion(spark):
    m = spark.createDataFrame([("twin.sol.test-solution.obs.3gpp.imei.28712576071100.imsi.545591184331028.attach", 1000)], "subject string, at_ms long")
    a = one(rules.assertions(m, RULES))
    assert (a.sid, a.st, a.si, a.dt, a.di, a.ttl, a.exp) == ("test-solution", "imei", "28712576071100", "imsi", "545591184331028", 1_800_000, 1_801_000)


@pytest.mark.parametrize(("limit", "parts"), [(2, 4), (4, 6), (8, 6)])
def test_bounded_tokens(spark, limit, parts):
    t = one(spark.range(1).select(S.bounded_tokens(F.lit("a.b.c.d.e.f"), limit).alias("t"))).t
    assert len(t) == parts


def test_quantised_expiry_rounds_half_up(spark):
    got = [r[0] for r in spark.createDataFrame([(29,), (30,), (89,), (90,)], "e long").select(rules.quantised(F.col("e"), 60)).collect()]
    assert got == [0, 60, 60, 120]


def fold(spark, events, phantom=False):
    rows = [("s", "a", "k", "b", di, ttl, 1000 * i + ttl, i) for i, (di, ttl) in enumerate(events)]
    df = spark.createDataFrame(rows, "sid string, st string, si string, dt string, di string, ttl long, exp long, n long")
    return df, relations.relation_sets(df, ["n"], phantom)


@pytest.mark.parametrize(
    ("events", "want"),
    [
        ([("di1", 100)], [("di1", 100)]),
        ([("di1", 100), ("di2", 200)], [("di1", 100), ("di2", 200)]),
        ([("di1", 100), ("di1", 200)], [("di1", 200)]),
        ([("di1", 100), ("di2", 0)], [("di1", 100)]),
        ([("di1", 100), ("di3", 300), ("di2", 200)], [("di1", 100), ("di2", 200), ("di3", 300)]),
        ([("di1", 100), ("di2", 200), ("di1", 150)], [("di1", 150), ("di2", 200)]),
        ([("di1", 100), ("di1", 0)], []),
        ([("di1", 100), ("di1", -5)], []),
        ([("di9", 1), ("di10", 1)], [("di10", 1), ("di9", 1)]),
    ],
)
def test_merge(spark, events, want):
    r = one(fold(spark, events)[1])
    assert [(x.di, x.ttl) for x in r.r] == want and r.ts == 1000 * (len(events) - 1)


def test_retraction_of_unknown_key(spark):
    assert fold(spark, [("di1", 0)])[1].count() == 0
    assert [(x.di, x.ttl) for x in one(fold(spark, [("di1", 0)], True)[1]).r] == [("di1", 0)]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), st.sampled_from([0, 5, 7])), min_size=1, max_size=9), st.integers(0, 9))
def test_incremental_equals_whole(spark, events, cut):
    df, whole = fold(spark, events)
    parts = relations.apply_assertions(relations.relation_sets(df.where(F.col("n") < cut), ["n"]), df.where(F.col("n") >= cut), ["n"])
    assert [r.asDict(True) for r in parts.collect()] == [r.asDict(True) for r in whole.collect()]


ROUTE = routes.Route("fleet", "yard.*.truck.>", "dock.${crew}.of.${1}.near.${bay}.row.${4}.end", {"crew": "yard.kv.${1}.crew", "bay": "yard.kv.${5}.bays"})
HELD = [("yard.kv.north.crew", x) for x in ("ida", "omar", "lin")] + [("yard.kv.cold.bays", x) for x in ("b7", "b9")]


def test_route_cross_product(spark):
    m = spark.createDataFrame([("yard.north.truck.t4.steel.cold",)], "subject string")
    got = sorted(r.egress for r in routes.expand(m, ROUTE, spark.createDataFrame(HELD, "key string, di string")).collect())
    assert got == sorted(f"dock.{a}.of.north.near.{b}.row.steel.end" for a in ("ida", "omar", "lin") for b in ("b7", "b9"))


def test_route_compiles_to_pieces():
    c = routes.compile_route(ROUTE)
    assert [p.kind for p in c.pieces] == ["literal", "relation", "literal", "token", "literal", "relation", "literal", "token", "literal"]
    assert c.lookups["crew"] == [routes.Piece("literal", "yard.kv."), routes.Piece("token", 1), routes.Piece("literal", ".crew")] and c.last_token() == 5


def test_route_errors():
    with pytest.raises(routes.RouteError):
        routes.compile_route(routes.Route("r", "a.>", "x.${name}"))
    with pytest.raises(routes.RouteError):
        routes.compile_route(routes.Route("r", "a.>", "x.${foo-bar}"), strict=True)
    assert routes.parse("x.${foo-bar}", routes.TRANSFORM) == [routes.Piece("literal", "x.foo-bar")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_routing_plan_has_no_nested_loops(spark):
    """And one read of the messages however many routes there are."""
    m = spark.createDataFrame([("yard.north.truck.t4.steel.cold",)], "subject string")
    p = plan(routes.expand_all(m, [ROUTE, routes.Route("two", "yard.>", "x.${1}"), routes.Route("three", "yard.*.truck.>", "y.${crew}", {"crew": "yard.kv.${1}.crew"})], spark.createDataFrame(HELD, "key string, di string")))
    assert "NestedLoop" not in p and "Cartesian" not in p and p.count("Join") == 2


def test_many_routes_of_one_message(spark):
    m = spark.createDataFrame([("yard.north.truck.t4.steel.cold",), ("yard.south",)], "subject string")
    rs = [ROUTE, routes.Route("two", "yard.>", "x.${1}"), routes.Route("far", "yard.*", "z.${7}"), routes.Route("off", "yard.>", "w", disabled=True), routes.Route("two", "yard.>", "v.${1}")]
    got = sorted((r.route_id, r.egress, r.route_error) for r in routes.expand_all(m, rs, spark.createDataFrame(HELD[:1], "key string, di string"), on_empty="blank").collect())
    assert got == [("far", None, "token out of range"), ("fleet", "dock.ida.of.north.near._.row.steel.end", None), ("two", "v.north", None), ("two", "v.south", None)]
    assert routes.expand_all(m, rs[3:4], spark.createDataFrame(HELD, "key string, di string")).count() == 0


def test_tokens_match_as_patterns_do(spark):
    subjects = [".".join(x) for n in (1, 2, 3, 4) for x in itertools.product(["a", "b", ""], repeat=n)]
    d = spark.createDataFrame([(x,) for x in subjects], "subject string").withColumn("t", S.tokens(F.col("subject")))
    pats = ["a.*.b", "a.>", ">", "*.a", "*.>", "a.b", "*.*.a.>", "a.*", "b.*.>", "*.b.*"]
    wrong = [~S.matches(F.col("subject"), p).eqNullSafe(S.matches(F.col("subject"), p, F.col("t"))) for p in pats]
    assert d.select(*(F.count_if(w).alias(str(i)) for i, w in enumerate(wrong))).first() == tuple([0] * len(pats))


def test_addresses(spark):
    given = ["::", "::1", "1::", "fe80::1", "1:0:0:2:0:0:0:3", "1:2:3:4:5:6:7:8", "1::2::3", "1:2:3", "g::1", "", "9.8.7.6", "1.2.3.256", "1:2:3:4:5:6:7:8:9", "0:0:1:0:0:1:0:0", ":1:2:3:4:5:6:7", "12345::", "64:ff9b::9.8.7.6"]
    rows = spark.createDataFrame([(x,) for x in given], "t string").withColumn("b", S.ip_bytes(F.col("t"))).withColumn("x", S.ip_text(F.col("b")))
    for r in rows.collect():
        try:
            want = ipaddress.ip_address(r.t)
        except ValueError:
            assert (r.b, r.x) == (None, None)
            continue
        assert (bytes(r.b), r.x) == (want.packed, str(want))


@pytest.mark.parametrize(("pattern", "subject", "want"), [("a.*.c", "a.b.c", True), ("a.*.c", "a.b.b.c", False), ("a.>", "a.b.c", True), ("a.>", "a", False), ("a.b", "a.b", True), (">", "x", True), ("a.*", "aab", False), ("a+.b", "aa.b", False)])
def test_patterns(spark, pattern, subject, want):
    assert one(spark.range(1).select(S.matches(F.lit(subject), pattern).alias("m"))).m is want


def test_line_protocol(spark):
    f = {"left": (F.lit(12), T.LongType()), "level": (F.lit(0.25), T.DoubleType()), "mass": (F.lit(3.1e45), T.DoubleType()), "open": (F.lit(False), T.BooleanType()), "shift": (F.lit(-7), T.IntegerType()), "note": (F.lit('a "b", c'), T.StringType())}
    tags = F.create_map(F.lit("tank no"), F.lit("7=x"), F.lit("area"), F.lit("west,1"))
    line = one(spark.range(1).select(lineprotocol.to_line(F.lit("tank state"), tags, f, F.lit(1700000000000000000), frozenset({"left"})).alias("x"))).x
    assert line == 'tank\\ state,area=west\\,1,tank\\ no=7\\=x left=12u,level=0.25,mass=3.1e+45,note="a \\"b\\", c",open=false,shift=-7i 1700000000000000000'
    with pytest.raises(ValueError):
        lineprotocol.to_line(F.lit("m"), None, {})


@pytest.mark.parametrize(("value", "text"), [(85.1, "85.1"), (3.0, "3"), (1e20, "100000000000000000000"), (1e21, "1e+21"), (0.0001, "0.0001"), (0.00001, "1e-05"), (1.5e-7, "1.5e-07"), (12345678.25, "12345678.25")])
def test_doubles(spark, value, text):
    assert one(spark.range(1).select(lineprotocol.field(F.lit(value), T.DoubleType()).alias("x"))).x == text


def test_frozen_digests(spark):
    h = spark.range(1).select(
        F.lower(F.hex(encoding._blake2b(F.concat(encoding.unsigned(F.lit(42), 8), encoding.string(F.lit("imsi-001010123456789")))))).alias("a"),
        F.lower(F.hex(encoding._blake2b(F.concat(encoding.boolean(F.lit(True)), encoding.unsigned(F.lit(0xDEAD), 4))))).alias("b"),
        F.lower(F.hex(encoding._blake2b(encoding.presence(F.lit(None))))).alias("c"),
    )
    # Digests that any implementation of the encoding gives.
    assert list(one(h)) == [
        "eb968ca0a538c9d1cb08213311c0896d156710f4023dcdc0444a02c3b819a03a",
        "deb3c6a8f65c1819d67315d9002c60d26699fb1ce3c3b158d54806a550d3a817",
        "03170a2e7597b7b7e3d84c05391d139a62b157e78786d8c082f29dcf4c111314",
    ]


@pytest.mark.parametrize(
    "fields",
    [
        [], [("k", T.StringType(), "entity.key"), ("l", T.StringType(), "entity.key")], [("k", T.DoubleType(), "entity.key")], [("k", T.ArrayType(T.StringType()), "entity.key")],
        [("k", T.StringType(), "entity.key"), ("n", T.LongType(), "delta.nested")], [("k", T.StringType(), "entity.key"), ("n", T.StringType(), "delta.clearable")],
        [("k", T.StringType(), "entity.key"), ("n", T.StringType(), "delta.omit,delta.retired")],
    ],
)
def test_bad_schemas(fields):
    with pytest.raises(schema.SchemaError):
        schema.TwinSchema(T.StructType([schema.tagged(*f) for f in fields]), header=False)


def test_key_override_warns():
    t = schema.TwinSchema(T.StructType([schema.tagged("k", T.StringType(), schema.KEY), schema.tagged("l", T.LongType())]), header=False, key_field="l")
    assert t.key == "l" and t.warnings


TWIN = schema.TwinSchema(
    T.StructType(
        [
            schema.tagged("key", T.LongType(), schema.KEY), schema.tagged("name", T.StringType()), schema.tagged("tags", T.ArrayType(T.StringType()), schema.NESTED),
            schema.tagged("attrs", T.MapType(T.StringType(), T.LongType()), schema.NESTED), schema.tagged("groups", T.ArrayType(T.StringType()), f"{schema.NESTED},{schema.CLEARABLE}"),
        ]
    ),
    header=False,
)
SNAPSHOT = st.tuples(st.just(1), st.none() | st.sampled_from(["x", "y"]), st.lists(st.sampled_from("abc"), unique=True, max_size=3), st.dictionaries(st.sampled_from("pq"), st.integers(0, 2), max_size=2), st.lists(st.sampled_from("ab"), unique=True, max_size=2))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(SNAPSHOT, SNAPSHOT), min_size=5, max_size=25))
def test_apply_of_diff_gives_the_second(spark, pairs):
    df = spark.createDataFrame(pairs, T.StructType([T.StructField("a", TWIN.schema), T.StructField("b", TWIN.schema)]))
    r = df.withColumn("d", delta.diff(F.col("a"), F.col("b"), TWIN)["delta"]).withColumn("r", delta.apply(F.col("a"), F.col("d"), TWIN)["snapshot"])
    for x in r.collect():
        assert (x.r.name, sorted(x.r.tags), x.r.attrs, sorted(x.r.groups or [])) == (x.b.name, sorted(x.b.tags), x.b.attrs, sorted(x.b.groups or []))
    same = df.withColumn("d", delta.diff(F.col("b"), F.col("b"), TWIN)["delta"]).select("d.*").collect()
    assert all(x.name.op == 0 and not x.tags.added and not x.tags.removed and not x.attrs.updated and x.groups.op == 0 for x in same)


CHANGE = st.tuples(st.none() | st.sampled_from(["x", "y"]), st.lists(st.sampled_from("abc"), max_size=2), st.lists(st.sampled_from("abc"), max_size=2), st.lists(st.sampled_from("pq"), max_size=2), st.dictionaries(st.sampled_from("pqr"), st.integers(0, 3), max_size=2))
PLAIN = schema.TwinSchema(T.StructType(TWIN.schema.fields[:4]), header=False)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(CHANGE, min_size=1, max_size=5), min_size=5, max_size=20))
def test_composed_deltas_do_the_same(spark, chains):
    delta_of = lambda c: (1, (1, c[0]) if c[0] else (0, None), (c[1], c[2]), (c[3], c[4]))
    df = spark.createDataFrame([((1, "n", ["a", "b"], {"p": 9, "q": 8}), [delta_of(c) for c in chain]) for chain in chains], T.StructType([T.StructField("s", PLAIN.schema), T.StructField("d", T.ArrayType(PLAIN.delta_schema()))]))
    one_by_one = delta.coalesce_fold(F.col("s"), F.col("d"), PLAIN)["snapshot"].alias("one")
    at_once = delta.apply(F.col("s"), delta.compose(F.col("d"), PLAIN), PLAIN)["snapshot"].alias("two")
    for r in df.select(one_by_one, at_once).collect():
        assert (r.one.name, sorted(r.one.tags), r.one.attrs) == (r.two.name, sorted(r.two.tags), r.two.attrs)


def test_anchors(spark):
    at = F.timestamp_micros(F.lit(10))
    b = header.birth(F.unhex(F.lit("ab" * 32)), F.lit("c"), at, at)
    h = spark.range(1).select(b.alias("b")).select("b", header.terminator(F.col("b"), F.lit(5), at, at, F.lit("next")).alias("t"))
    r = one(h.select(header.anchor_error(F.col("b"), "birth").alias("ok"), header.anchor_error(F.col("t"), "birth").alias("bad"), header.anchor_error(F.col("t"), "terminator").alias("end"), "t.next_chain_id", header.header_after_apply(F.col("t"), F.col("b"))["error"].alias("error")))
    assert (r.ok, r.bad, r.end, r.next_chain_id, r.error) == (None, "a birth has sequence 0", None, "next", "sequence not increasing")


def test_files_and_config(spark, tmp_path):
    p = tmp_path / "rules.json"
    p.write_text('[{"match": "a.>", "duration": 1800000000000, "quantisation": 1000000000, "sourceType": "x", "destinationType": "y", "sourceToken": 1, "destinationToken": 2}]')
    r = config.load_rules(spark, str(p))[0]
    assert (r.ttl_ms, r.quantum_ms) == (1_800_000, 1000)
    p.write_text("[{")
    with pytest.raises(ValueError):
        config.load_rules(spark, str(p))
    s = fold(spark, [("a", 5)])[1]
    assert [x.asDict(True) for x in files.sets_from_json(files.sets_to_json(s)).drop("corrupt").collect()] == [x.asDict(True) for x in s.collect()]
    files.write_parquet(s, str(tmp_path / "t"), sort=["si"])
    back = files.read_parquet(spark, str(tmp_path / "t"), T.StructType([T.StructField("si", T.StringType()), T.StructField("more", T.LongType())]), zero=True)
    assert [tuple(x) for x in back.collect()] == [("k", 0)]
    with pytest.raises(schema.SchemaError):
        files.read_parquet(spark, str(tmp_path / "t"), T.StructType([T.StructField("si", T.LongType())]))


def test_upsert(spark, tmp_path):
    p = str(tmp_path / "u")
    rows = lambda: sorted((r.k, r.x) for r in tabulate.read_table(spark, p, ["k"], ["v"]).collect())
    assert tabulate.read_table(spark, p, ["k"], ["v"]) is None
    tabulate.upsert(spark, p, spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, v int, x string"), ["k"], ["v"])
    before = tabulate.read_table(spark, p, ["k"], ["v"])
    tabulate.upsert(spark, p, spark.createDataFrame([(1, 2, "c"), (3, 1, "d")], "k int, v int, x string"), ["k"], ["v"])
    assert rows() == [(1, "c"), (2, "b"), (3, "d")] and sorted(r.x for r in before.collect()) == ["a", "b"]  # a reader that had begun goes on


def test_a_crash_leaves_the_last_table(spark, tmp_path, monkeypatch):
    p = str(tmp_path / "u")
    tabulate.upsert(spark, p, spark.createDataFrame([(1, 1)], "k int, v int"), ["k"], ["v"])
    with monkeypatch.context() as m:
        m.setattr(tabulate, "_point", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            tabulate.upsert(spark, p, spark.createDataFrame([(1, 2)], "k int, v int"), ["k"], ["v"])
    assert [r.v for r in tabulate.read_table(spark, p, ["k"], ["v"]).collect()] == [1]


def test_changes_are_logged_once_and_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tabulate, "COMPACT", 3)
    p, kind = str(tmp_path / "t"), "k int, x string, gone boolean, batch int"
    plan = [[(1, "a"), (2, "a")], [(1, "b")], [(2, None)], [(3, "c")], [(1, "d"), (2, "e")]]
    for n, rows in enumerate(plan):
        batch = spark.createDataFrame([(k, x, x is None, n) for k, x in rows], kind)
        tabulate.record(batch, p, n, ["k"], ["batch"], "gone")
        tabulate.record(batch, p, n, ["k"], ["batch"], "gone")  # a batch that comes again
        want = dict(kv for part in plan[: n + 1] for kv in part)
        got = tabulate.read_table(spark, p, ["k"], ["batch"])
        assert {r.k: r.x for r in got.where("not gone").collect()} == {k: x for k, x in want.items() if x is not None}
    assert len(tabulate._pointer(spark, p)["log"]) == 2
    tabulate.record(spark.createDataFrame([(9, "late", False, 1)], kind), p, 1, ["k"], ["batch"], "gone")
    assert tabulate.read_table(spark, p, ["k"], ["batch"]).where("k = 9").count() == 0


def test_constraint_of_ties(spark):
    rows = [("s", "a", si, "b", di, 1, exp) for si, di, exp in (("1", "x", 5), ("1", "y", 5), ("2", "x", 5), ("3", "z", 1), ("3", "z2", 2), ("4", "z2", 9))]
    kept, gone = relations.constrain(spark.createDataFrame(rows, "sid string, st string, si string, dt string, di string, ttl long, exp long"))
    assert sorted((r.si, r.di) for r in kept.collect()) == [("1", "y"), ("2", "x"), ("4", "z2")]
    assert sorted((r.si, r.di, r.ttl) for r in gone.collect()) == [("1", "x", 0), ("3", "z", 0), ("3", "z2", 0)]


def test_differences_of_repeated_and_null_elements(spark):
    d = spark.createDataFrame([([1, 1, None, 2, None], [2, 3]), ([], [1]), ([1], []), ([None], [None])], "a array<int>, b array<int>")
    assert [r[0] for r in d.select(collections.minus(F.col("a"), F.col("b"))).collect()] == [[1, 1, None, None], [], [1], []]


def test_equality_of_maps_at_any_depth(spark):
    t = T.StructType([schema.tagged("key", T.LongType(), schema.KEY), schema.tagged("deep", T.ArrayType(T.StructType([T.StructField("m", T.MapType(T.StringType(), T.ArrayType(T.MapType(T.StringType(), T.LongType()))))])))])
    twin = schema.TwinSchema(t, header=False)
    one_, two, other = ([({"a": [{"x": 1, "y": 2}], "b": None},)], [({"b": None, "a": [{"y": 2, "x": 1}]},)], [({"a": [{"x": 1, "y": 3}], "b": None},)])
    df = spark.createDataFrame([((1, a), (1, b)) for a, b in ((one_, two), (one_, other), (None, one_), (None, None))], T.StructType([T.StructField("a", t), T.StructField("b", t)]))
    assert [r[0] for r in df.select(delta.diff(F.col("a"), F.col("b"), twin)["delta"]["deep"]["op"]).collect()] == [0, 1, 1, 0]


def test_simulation(spark):
    d = spark.range(20000)
    r = one(d.select(F.avg(simulate.poisson(5, 1, "id")).alias("p"), F.min(simulate.uniform_int(2, 4, 2, "id")).alias("lo"), F.max(simulate.uniform_int(2, 4, 2, "id")).alias("hi"), F.avg(simulate.bounded_normal_int(10, 3, 0, 20, 3, "id")).alias("n"), F.max(simulate.bounded_normal_int(10, 3, 0, 12, 3, "id")).alias("cap")))
    assert abs(r.p - 5) < 0.1 and (r.lo, r.hi, r.cap) == (2, 4, 12) and abs(r.n - 10) < 0.2
    assert simulate.epochs(spark, 0, 100, 10).count() == 10 and simulate.epochs(spark, 0, 100, 10, inclusive_end=True).count() == 11
    e = simulate.events(spark, simulate.epochs(spark, 0, 100, 10), simulate.fixed_rate(3), F.concat(F.lit("twin.sim."), F.col("n").cast("string")))
    assert e.count() == 30 and e.where("at_ms < epoch * 10 or at_ms >= epoch * 10 + 10").count() == 0


def test_snake_case_and_annotation():
    assert [schema.snake_case(x) for x in ("PumpSnapshot", "HTTPServer", "arSnapshot2")] == ["pump_snapshot", "http_server", "ar_snapshot2"]
    t = schema.annotate(T.StructType([T.StructField("Name", T.StringType()), T.StructField("Tags", T.ArrayType(T.StringType()))]), {"Name": "name"})
    assert [(f.name, f.metadata["origin"], f.metadata["physical"]) for f in t.fields] == [("name", "Name", "BYTE_ARRAY/String"), ("Tags", "Tags", "LIST")]
