"""Rules and routes from JSON files. Durations in the files are nanoseconds; bad JSON or fields are errors."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from twinloom.operators.routes import Route, compile_route
from twinloom.operators.rules import Rule

NANOS_PER_MS = 1_000_000


def _load(spark: SparkSession, path: str) -> list[dict]:
    """The file's list of objects, from any store that Spark reads."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    got = json.loads(text)
    if not isinstance(got, list):
        raise ValueError(f"{path}: not a list")
    return got


def rule_of(x: dict) -> Rule:
    r = Rule(
        match=x["match"], ttl_ms=int(x.get("duration", 0)) // NANOS_PER_MS, source_type=x["sourceType"], destination_type=x["destinationType"], source_token=int(x["sourceToken"]),
        destination_token=int(x["destinationToken"]), quantum_ms=int(x.get("quantisation", 0)) // NANOS_PER_MS, description=x.get("description", ""),
    )
    if min(r.source_token, r.destination_token) < 0:
        raise ValueError(f"negative token in rule {r.match}")
    return r


def load_rules(spark: SparkSession, path: str) -> list[Rule]:
    return [rule_of(x) for x in _load(spark, path)]


def route_of(x: dict, strict: bool = False) -> Route:
    r = Route(id=x["id"], match=x["match"], transform=x["transform"], references=dict(x.get("references") or {}), disabled=bool(x.get("disabled", False)))
    compile_route(r, strict)
    return r


def load_routes(spark: SparkSession, path: str, strict: bool = False) -> list[Route]:
    return [route_of(x, strict) for x in _load(spark, path)]
