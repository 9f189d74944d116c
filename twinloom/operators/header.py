"""Headers of snapshots and deltas: their schema, the checks of the algebra, and constructors of a chain's anchors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_fields = lambda **kinds: T.StructType([T.StructField(k, t) for k, t in kinds.items()])
ORIGIN = _fields(published_at=T.TimestampType(), valid_until=T.TimestampType(), solution=T.StringType(), component=T.StringType(), instance=T.StringType(), metadata=T.MapType(T.StringType(), T.StringType()))
QUALITY = _fields(gaps=T.ArrayType(_fields(start=T.LongType(), end=T.LongType())))
SCHEMA = T.StructType(
    [
        T.StructField("entity_id", T.BinaryType()), T.StructField("chain_id", T.StringType()), T.StructField("previous_chain_id", T.StringType()),
        T.StructField("next_chain_id", T.StringType()), T.StructField("closed", T.TimestampType()), T.StructField("sequence", T.LongType()),
        T.StructField("effective_at", T.TimestampType()), T.StructField("published_at", T.TimestampType()), T.StructField("provenance", T.ArrayType(ORIGIN)), T.StructField("quality", QUALITY),
    ]
)
ZERO_ID = "00" * 32


def is_zero(entity_id: Column) -> Column:
    return entity_id.isNull() | (F.hex(entity_id) == ZERO_ID)


def _checked(first: list[tuple[Column, str]], made: Column) -> Column:
    """Struct error, header: the first check that fails, else the header made."""
    error = F.coalesce(*(F.when(bad, F.lit(text)) for bad, text in first), F.lit(None).cast("string"))
    return F.struct(error.alias("error"), F.when(error.isNull(), made).alias("header"))


def _made(s: Column, d: Column, provenance: Column, **more: Column) -> Column:
    parts = {"entity_id": s["entity_id"], "chain_id": s["chain_id"], "sequence": d["sequence"], "effective_at": d["effective_at"], "published_at": d["published_at"], "provenance": provenance} | more
    return F.struct(*(parts.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMA.fields))


def _shared(s: Column, d: Column, left: str, right: str) -> list[tuple[Column, str]]:
    return [
        (is_zero(s["entity_id"]), f"{left} entity id is zero"),
        (is_zero(d["entity_id"]), f"{right} entity id is zero"),
        (~s["entity_id"].eqNullSafe(d["entity_id"]), "entity id mismatch"),
        (~s["chain_id"].eqNullSafe(d["chain_id"]), "chain id mismatch"),
    ]


def concatenated(s: Column, d: Column) -> Column:
    """The provenance of one header and then of another; null if neither has one."""
    none = F.array().cast(T.ArrayType(ORIGIN))
    return F.when(s["provenance"].isNotNull() | d["provenance"].isNotNull(), F.concat(*(F.coalesce(x["provenance"], none) for x in (s, d))))


def header_after_apply(s: Column, d: Column) -> Column:
    """The header of snapshot s after delta d: sequences rise (gaps are allowed), effective times don't fall, and a
    closed chain takes no more. Provenance is appended; anchors' and quality fields are empty."""
    checks = [
        *_shared(s, d, "snapshot", "delta"),
        (d["sequence"] <= s["sequence"], "sequence not increasing"),
        (d["effective_at"] < s["effective_at"], "effective time before the snapshot's"),
        (s["closed"].isNotNull(), "chain closed"),
    ]
    return _checked(checks, _made(s, d, concatenated(s, d)))


def header_for_diff(a: Column, b: Column) -> Column:
    """The header of the delta from a to b: as after apply, but equal sequences pass and nothing is closed; no provenance."""
    checks = [
        *_shared(a, b, "first", "second"),
        (b["sequence"] < a["sequence"], "sequence decreasing"),
        (b["effective_at"] < a["effective_at"], "effective time before the first's"),
    ]
    return _checked(checks, _made(a, b, F.lit(None).cast(T.ArrayType(ORIGIN))))


def birth(entity_id: Column, chain_id: Column, effective_at: Column, published_at: Column, previous_chain_id: Column | None = None) -> Column:
    """Sequence 0 of a new chain."""
    return _anchor(entity_id=entity_id, chain_id=chain_id, effective_at=effective_at, published_at=published_at, sequence=F.lit(0), previous_chain_id=previous_chain_id)


def cadence(h: Column, sequence: Column, published_at: Column) -> Column:
    """A snapshot between: no anchor fields."""
    return _anchor(entity_id=h["entity_id"], chain_id=h["chain_id"], effective_at=h["effective_at"], published_at=published_at, sequence=sequence, provenance=h["provenance"], quality=h["quality"])


def terminator(h: Column, sequence: Column, closed: Column, published_at: Column, next_chain_id: Column | None = None) -> Column:
    """The last snapshot of a chain, with its successor if it has one."""
    return _anchor(entity_id=h["entity_id"], chain_id=h["chain_id"], effective_at=closed, published_at=published_at, sequence=sequence, closed=closed, next_chain_id=next_chain_id)


def reset(h: Column, sequence: Column, at: Column, published_at: Column, successor: Column) -> tuple[Column, Column]:
    """A handover: the predecessor's terminator and the successor's birth, each naming the other."""
    return terminator(h, sequence, at, published_at, successor), birth(h["entity_id"], successor, at, published_at, h["chain_id"])


def rotated(h: Column, offset: Column, published_at: Column, solution: str, component: str, instance: str) -> Column:
    """The header of a new writer's delta, `offset` (1 or more) after the last one: same chain, no anchor fields, its own origin."""
    origin = F.struct(published_at.alias("published_at"), F.lit(None).cast("timestamp").alias("valid_until"), F.lit(solution).alias("solution"), F.lit(component).alias("component"), F.lit(instance).alias("instance"), F.lit(None).cast("map<string,string>").alias("metadata"))
    return _anchor(entity_id=h["entity_id"], chain_id=h["chain_id"], sequence=h["sequence"] + F.greatest(offset, F.lit(1)), effective_at=h["effective_at"], published_at=published_at, provenance=F.array(origin))


def _anchor(**parts: Column | None) -> Column:
    return F.struct(*((parts[f.name] if parts.get(f.name) is not None else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMA.fields))


def anchor_error(h: Column, kind: str) -> Column:
    """What breaks the shape of a birth, cadence or terminator snapshot; null if nothing does."""
    rules = {
        "birth": [(h["sequence"] != 0, "a birth has sequence 0"), (h["closed"].isNotNull() | h["next_chain_id"].isNotNull(), "a birth isn't closed")],
        "cadence": [(h["sequence"] <= 0, "a cadence snapshot has a sequence above 0"), (h["closed"].isNotNull() | h["next_chain_id"].isNotNull() | h["previous_chain_id"].isNotNull(), "a cadence snapshot has no anchor fields")],
        "terminator": [(h["closed"].isNull(), "a terminator is closed"), (h["previous_chain_id"].isNotNull(), "a terminator has no predecessor")],
    }[kind]
    return F.coalesce(*(F.when(bad, F.lit(text)) for bad, text in rules), F.lit(None).cast("string"))


def elided_provenance(provenance: Column, solution: str, component: str, instance: str) -> Column:
    """Without a last origin that is the producer's own, which readers carry forward."""
    last = F.element_at(provenance, -1)
    own = (last["solution"] == solution) & (last["component"] == component) & (last["instance"] == instance)
    return F.when((F.size(provenance) > 0) & own, F.slice(provenance, F.lit(1), F.size(provenance) - 1)).otherwise(provenance)
