"""Thin command line: python -m twinloom COMMAND ... (relate, route, tabulate, transform, tools)."""

from __future__ import annotations

import argparse
import base64
import ipaddress
import json

from pyspark.sql import SparkSession


def _session() -> SparkSession:
    return SparkSession.builder.appName("twinloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def relate(args: argparse.Namespace) -> None:
    """Messages (subject, at_ms) to relation sets."""
    from twinloom.operators import relations, rules
    from twinloom.sources import config

    spark = _session()
    made = rules.valid(rules.assertions(spark.read.parquet(args.messages), config.load_rules(spark, args.rules), quantise=args.quantise))
    relations.relation_sets(made, ["at_ms", "subject"]).write.mode("overwrite").parquet(args.out)


def decode(args: argparse.Namespace) -> None:
    """Relation sets as JSON lines."""
    from twinloom.sources import files

    files.sets_to_json(_session().read.parquet(args.sets)).write.mode("overwrite").text(args.out)


def encode(args: argparse.Namespace) -> None:
    """JSON lines back to relation sets; lines that aren't any are left out."""
    from twinloom.sources import files

    files.sets_from_json(_session().read.text(args.lines)).where("corrupt is null").drop("corrupt").write.mode("overwrite").parquet(args.out)


def expire(args: argparse.Namespace) -> None:
    """Retractions of relations that have expired."""
    from pyspark.sql import functions as F

    from twinloom.operators import relations

    relations.expiries(relations.edges_of(_session().read.parquet(args.sets)), F.lit(args.as_of)).write.mode("overwrite").parquet(args.out)


def constrain(args: argparse.Namespace) -> None:
    """Retractions that leave each source, destination or both with its newest relation."""
    from twinloom.operators import relations

    rows = relations.edges_of(_session().read.parquet(args.sets))
    relations.constrain(rows, args.side != "backward", args.side != "forward")[1].write.mode("overwrite").parquet(args.out)


def downsample(args: argparse.Namespace) -> None:
    """Count, sum and extremes of a value in slots of time."""
    from pyspark.sql import functions as F

    from twinloom.operators import transform

    v = [F.count("*").alias("n"), F.sum(args.value).alias("total"), F.min(args.value).alias("least"), F.max(args.value).alias("most")]
    transform.aggregate(_session().read.parquet(args.rows), args.by.split(","), args.at, args.width, v, args.slide).write.mode("overwrite").parquet(args.out)


def compare(args: argparse.Namespace) -> None:
    """Rows beside their predecessors."""
    from twinloom.operators import transform

    transform.compare(_session().read.parquet(args.rows), args.by.split(","), args.order.split(","), args.columns.split(",")).write.mode("overwrite").parquet(args.out)


def annotate(args: argparse.Namespace) -> None:
    """Rows with renamed fields that keep origin and physical type."""
    from pyspark.sql import functions as F

    from twinloom.operators import schema

    df = _session().read.parquet(args.rows)
    t = schema.annotate(df.schema, json.loads(args.names))
    df.select(*(F.col(f"`{f.metadata['origin']}`").alias(f.name, metadata=f.metadata) for f in t.fields)).write.mode("overwrite").parquet(args.out)


def route(args: argparse.Namespace) -> None:
    """Messages (subject, ...) to expansions over relation sets."""
    from twinloom.operators import routes
    from twinloom.sources import config
    from twinloom.streaming import routing

    spark = _session()
    lookup = routing.relations_of(spark.read.parquet(args.sets))
    routes.expand_all(spark.read.parquet(args.messages), config.load_routes(spark, args.routes), lookup, on_empty=args.on_empty).write.mode("overwrite").parquet(args.out)


def record(args: argparse.Namespace) -> None:
    """Upsert rows into a table of the latest per key."""
    from twinloom.operators import tabulate

    spark = _session()
    tabulate.upsert(spark, args.out, spark.read.parquet(args.rows), args.key.split(","), args.order.split(","))


def ip(args: argparse.Namespace) -> None:
    """An address as URL-safe base64, or back."""
    if args.back:
        print(ipaddress.ip_address(base64.urlsafe_b64decode(args.value)))
    else:
        print(base64.urlsafe_b64encode(ipaddress.ip_address(args.value).packed).decode())


def main(argv: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="twinloom", description=__doc__)
    commands = top.add_subparsers(required=True)
    for f, options in (
        (relate, ("messages", "rules", "out")), (decode, ("sets", "out")), (route, ("messages", "routes", "sets", "out")), (record, ("rows", "out")), (ip, ("value",)),
        (encode, ("lines", "out")), (expire, ("sets", "out")), (constrain, ("sets", "out")), (downsample, ("rows", "out")), (compare, ("rows", "out")), (annotate, ("rows", "out")),
    ):
        p = commands.add_parser(f.__name__, help=f.__doc__)
        p.set_defaults(run=f)
        for o in options:
            p.add_argument(o)
        if f is relate:
            p.add_argument("--quantise", action="store_true")
        elif f is route:
            p.add_argument("--on-empty", default="elide", choices=["elide", "blank"])
        elif f is record:
            p.add_argument("--key", required=True)
            p.add_argument("--order", required=True)
        elif f is expire:
            p.add_argument("--as-of", type=int, required=True)
        elif f is constrain:
            p.add_argument("--side", default="both", choices=["both", "forward", "backward"])
        elif f is annotate:
            p.add_argument("--names", default="{}")
        elif f in (downsample, compare):
            for o in ("--by", *(("--at", "--value") if f is downsample else ("--order", "--columns"))):
                p.add_argument(o, required=True)
            if f is downsample:
                p.add_argument("--width", type=int, required=True)
                p.add_argument("--slide", type=int)
        elif f is ip:
            p.add_argument("--back", action="store_true")
    args = top.parse_args(argv)
    args.run(args)


if __name__ == "__main__":
    main()
