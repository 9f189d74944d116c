"""Routing of streams: stream-static joins on the latest relations, rules that change while the stream runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from twinloom.functions import subjects as S
from twinloom.operators import relations, routes
from twinloom.streaming import started


def relations_of(sets: DataFrame) -> DataFrame:
    """Relation sets as routes look them up: key, di, exp."""
    from pyspark.sql import functions as F

    e = relations.edges_of(sets)
    return e.select(S.relation_key(F.col("sid"), F.col("st"), F.col("si"), F.col("dt")).alias("key"), "di", "exp")


def route_stream(messages: DataFrame, route_list: list[routes.Route], lookup: DataFrame, **options) -> DataFrame:
    """Expansions of a stream; headers and payload pass through. `lookup` is a static table, read anew by every batch."""
    return routes.expand_all(messages, route_list, lookup, **options)


def route_batches(messages: DataFrame, load_routes: Callable[[], list[routes.Route]], load_relations: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None, **options) -> StreamingQuery:
    """As route_stream, with the routes and relations that stand when a batch begins (add, replace, disable).

    `trigger` as in streaming.started(); by default all there is, then stop.
    """

    def run(batch: DataFrame, n: int) -> None:
        standing = [r for r in {r.id: r for r in load_routes()}.values() if not r.disabled]
        if standing:
            sink(routes.expand_all(batch, standing, load_relations(), **options), n)

    return started(messages, run, checkpoint, **(trigger or {}))
