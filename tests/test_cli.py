"""The command line end to end."""

from pyspark.sql import functions as F

from twinloom.__main__ import main
from twinloom.operators import relations, tabulate
from twinloom.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_relate_and_route(spark, tmp_path, capsys):
    m = catalogue.observations(spark, SF).select("subject", "at_ms").where("event_id < 200")
    m.write.parquet(str(tmp_path / "m"))
    (tmp_path / "rules.json").write_text('[{"match": "twin.sol.*.obs.user.*.type.*.*.attach", "duration": 86400000000000, "sourceType": "user", "destinationType": "type", "sourceToken": 5, "destinationToken": 7}]')
    (tmp_path / "routes.json").write_text('[{"id": "r", "match": "twin.>", "transform": "out.${5}.${types}", "references": {"types": "twin.sol.${2}.r.kv.user.${5}.type.set"}}]')
    p = lambda x: str(tmp_path / x)
    main(["relate", p("m"), p("rules.json"), p("sets")])
    main(["route", p("m"), p("routes.json"), p("sets"), p("routed")])
    main(["decode", p("sets"), p("json")])
    sets, routed = spark.read.parquet(p("sets")), spark.read.parquet(p("routed"))
    assert spark.read.text(p("json")).count() == sets.count() > 0
    assert routed.count() >= m.count() and routed.where(F.col("egress").isNull()).count() == 0
    main(["ip", "10.190.185.231"])
    assert capsys.readouterr().out.strip() == "Cr655w=="
    main(["ip", "Cr655w==", "--back"])
    assert capsys.readouterr().out.strip() == "10.190.185.231"
    main(["record", p("m"), p("latest"), "--key", "subject", "--order", "at_ms"])
    assert tabulate.read_table(spark, p("latest"), ["subject"], ["at_ms"]).count() == m.count()


def test_transform_constrain_expire_and_encode(spark, tmp_path):
    p = lambda x: str(tmp_path / x)
    rows = [("s", "a", "1", "b", "x", 10, 100, 90), ("s", "a", "2", "b", "x", 10, 50, 40), ("s", "a", "3", "b", "y", 10, 70, 60)]
    a = spark.createDataFrame(rows, "sid string, st string, si string, dt string, di string, ttl long, exp long, at_ms long")
    relations.relation_sets(a, ["at_ms", "di"]).write.parquet(p("sets"))
    main(["expire", p("sets"), p("due"), "--as-of", "60"])
    assert [(r.si, r.ttl) for r in spark.read.parquet(p("due")).collect()] == [("2", 0)]
    main(["constrain", p("sets"), p("excess"), "--side", "backward"])
    assert [(r.si, r.di) for r in spark.read.parquet(p("excess")).collect()] == [("2", "x")]
    main(["decode", p("sets"), p("json")])
    main(["encode", p("json"), p("back")])
    assert sorted(map(str, spark.read.parquet(p("back")).collect())) == sorted(map(str, spark.read.parquet(p("sets")).collect()))
    a.write.parquet(p("rows"))
    main(["downsample", p("rows"), p("slots"), "--by", "di", "--at", "at_ms", "--width", "50", "--value", "exp"])
    assert sorted((r.di, r.slot, r.n, r["total"], r.most) for r in spark.read.parquet(p("slots")).collect()) == [("x", 0, 1, 50, 50), ("x", 50, 1, 100, 100), ("y", 50, 1, 70, 70)]
    main(["compare", p("rows"), p("seen"), "--by", "di", "--order", "at_ms", "--columns", "exp"])
    assert sorted((r.si, r.exp_before) for r in spark.read.parquet(p("seen")).collect()) == [("1", 50), ("2", None), ("3", None)]
    main(["annotate", p("rows"), p("named"), "--names", '{"si": "source"}'])
    assert "source" in spark.read.parquet(p("named")).columns
