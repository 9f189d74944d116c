"""Canonical key bytes and entity ids: big-endian integers, one byte for booleans, 8-byte lengths before strings."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WIDTH = {T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8}


def unsigned(value: Column, width: int) -> Column:
    """`width` bytes, big-endian, two's complement for negative values."""
    return F.unhex(F.right(F.lpad(F.hex(value.cast("long")), 16, "0"), F.lit(2 * width)))


def string(value: Column) -> Column:
    return F.concat(unsigned(F.octet_length(value), 8), F.encode(value, "UTF-8"))


def boolean(value: Column) -> Column:
    return F.when(value, F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00")))


def presence(value: Column) -> Column:
    """The marker before a value that may be absent."""
    return boolean(value.isNotNull())


def canonical(value: Column, kind: T.DataType) -> Column:
    """The bytes of a key. A struct's fields go in the byte order of their original names (metadata `origin`)."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.metadata.get("origin", f.name).encode())
        return F.concat(*(canonical(value[f.name], f.dataType) for f in fields))
    if isinstance(kind, T.StringType):
        return string(value)
    if isinstance(kind, T.BooleanType):
        return boolean(value)
    if isinstance(kind, T.BinaryType):
        return F.concat(unsigned(F.octet_length(value), 8), value)
    if type(kind) in _WIDTH:
        return unsigned(value, _WIDTH[type(kind)])
    raise TypeError(f"no key may be of type {kind.simpleString()}")


@F.pandas_udf(T.BinaryType())
def _blake2b(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: None if b is None else hashlib.blake2b(b, digest_size=32).digest())


def entity_id(value: Column, kind: T.DataType, hash: str = "blake2b") -> Column:
    """32 bytes. sha256 stays in the JVM; blake2b has no built-in and goes over Arrow."""
    raw = canonical(value, kind)
    if hash == "sha256":
        return F.unhex(F.sha2(raw, 256))
    if hash == "blake2b":
        return _blake2b(raw)
    raise ValueError(f"no such hash: {hash}")
