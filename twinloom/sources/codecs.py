"""Codecs for values that files or messages can't carry as they are: text or bytes out, the typed value back.

A field names its codec in its metadata (`codec`); fields without one fall back by their types: what can be cast to text
and back is text, what has an inside is JSON. Decoding reads codec and type from the metadata that encoding leaves.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Codec:
    """encode(value, type) gives text or bytes, decode(raw, type) the value."""

    encode: Callable[[Column, T.DataType], Column]
    decode: Callable[[Column, T.DataType], Column]


def _wrapped(t: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("v", t)])


CODECS: dict[str, Codec] = {
    "text": Codec(lambda c, t: c.cast("string"), lambda c, t: F.try_to_timestamp(c) if isinstance(t, T.TimestampType) else c.cast(t)),
    "json": Codec(lambda c, t: F.when(c.isNotNull(), F.to_json(F.struct(c.alias("v")))), lambda c, t: F.from_json(c, _wrapped(t))["v"]),
    "base64": Codec(lambda c, t: F.base64(c), lambda c, t: F.unbase64(c)),
}


def register(name: str, codec: Codec) -> None:
    """A codec of one's own, of Column expressions or of pandas UDFs; names can't be taken twice."""
    if name in CODECS:
        raise ValueError(f"there is a codec {name}")
    CODECS[name] = codec


def fallback(t: T.DataType) -> str | None:
    """The codec of a type that plain text columns don't hold; None if they do."""
    if isinstance(t, (T.StructType, T.ArrayType, T.MapType)):
        return "json"
    if isinstance(t, T.BinaryType):
        return "base64"
    return None if isinstance(t, T.StringType) else "text"


def encoded(df: DataFrame, only: list[str] | None = None) -> DataFrame:
    """Columns through their codecs; what decoded() needs is in the fields' metadata."""
    def one(f: T.StructField) -> Column:
        name = f.metadata.get("codec") or (fallback(f.dataType) if only is None or f.name in only else None)
        if name is None:
            return F.col(f"`{f.name}`")
        return CODECS[name].encode(F.col(f"`{f.name}`"), f.dataType).alias(f.name, metadata={**f.metadata, "codec": name, "type": f.dataType.json()})

    return df.select(*(one(f) for f in df.schema.fields))


def decoded(df: DataFrame, schema: T.StructType | None = None) -> DataFrame:
    """The values of encoded() back; `schema` has the metadata if the columns lost it on their way."""
    import json

    def one(f: T.StructField) -> Column:
        if "type" not in f.metadata:
            return F.col(f"`{f.name}`")
        t = T._parse_datatype_json_value(json.loads(f.metadata["type"]))
        rest = {k: v for k, v in f.metadata.items() if k not in ("codec", "type")}
        return CODECS[f.metadata["codec"]].decode(F.col(f"`{f.name}`"), t).alias(f.name, metadata=rest)

    return df.select(*(one(f) for f in (schema or df.schema).fields))
