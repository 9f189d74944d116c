"""Line protocol of time-series stores as one string expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def escape_key(text: Column) -> Column:
    """Of measurements, tag keys, tag values and field keys."""
    return F.regexp_replace(text, "([ ,=])", r"\\$1")


def quote(text: Column) -> Column:
    """Of string values; only the quote itself is escaped."""
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('\\"')), F.lit('"'))


def _double(value: Column) -> Column:
    """Shortest digits that give the value back; exponents below 1e-4 and from 1e21, signed and of two digits at least."""
    text = value.cast("double").cast("string")
    big = (F.abs(value) >= 1e21) | ((F.abs(value) < 1e-4) & (value != 0))
    short = F.regexp_replace(F.regexp_replace(text, r"\.0(E|$)", "$1"), r"E(\d)", "E+$1")
    exponent = F.lower(F.regexp_replace(short, r"E([+-])(\d)$", "E$1" + "0$2"))
    plain = F.regexp_replace(F.regexp_replace(value.cast("decimal(38,17)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(big, exponent).when(text.contains("E"), plain).otherwise(F.regexp_replace(text, r"\.0$", ""))


def field(value: Column, kind: T.DataType, unsigned: bool = False) -> Column:
    if isinstance(kind, T.IntegralType):
        return F.concat(value.cast("string"), F.lit("u" if unsigned else "i"))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return _double(value)
    if isinstance(kind, T.BooleanType):
        return value.cast("string")
    if isinstance(kind, T.StringType):
        return quote(value)
    raise TypeError(f"unsupported field type {kind.simpleString()}")


def to_line(measurement: Column, tags: Column | None, fields: dict[str, tuple[Column, T.DataType]], nanos: Column | None = None, unsigned: frozenset[str] = frozenset()) -> Column:
    """measurement,tags fields [time]: tags (a map) and fields sorted by key; null fields are left out, null time too."""
    if not fields:
        raise ValueError("at least one field is required")
    head = escape_key(measurement)
    if tags is not None:
        pairs = F.array_sort(F.transform(F.map_entries(tags), lambda e: F.struct(e["key"], e["value"])))
        head = F.concat(head, F.array_join(F.transform(pairs, lambda e: F.concat(F.lit(","), escape_key(e["key"]), F.lit("="), escape_key(e["value"]))), ""))
    body = F.concat_ws(",", *(F.concat(escape_key(F.lit(k)), F.lit("="), field(*fields[k], unsigned=k in unsigned)) for k in sorted(fields, key=str.encode)))
    return F.concat_ws(" ", head, body, nanos.cast("string") if nanos is not None else F.lit(None).cast("string"))
