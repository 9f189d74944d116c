"""Snapshot schemas: annotations on struct fields, their validation, and the delta schema that follows from them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The annotation vocabulary.
KEY, NESTED, OMIT, RETIRED, COMMUTATIVE, CLEARABLE = "entity.key", "delta.nested", "delta.omit", "delta.retired", "delta.commutative", "delta.clearable"
TAG, HEADER = "twin", "header"

#: Delta operations.
IGNORE, ASSERT, RETRACT = 0, 1, 2


class SchemaError(ValueError):
    pass


def tagged(name: str, kind: T.DataType, tags: str = "", **metadata) -> T.StructField:
    return T.StructField(name, kind, True, {TAG: tags} | metadata if tags or metadata else {})


def tags_of(f: T.StructField) -> dict[str, str]:
    """Tag -> options, for `tag,option=...` lists; unknown tags are kept."""
    out: dict[str, str] = {}
    last = ""
    for part in filter(None, (x.strip() for x in f.metadata.get(TAG, "").split(","))):
        if part.startswith(("entity.", "delta.")) or not last:
            last = part
            out[last] = ""
        else:
            out[last] = f"{out[last]},{part}".lstrip(",")
    return out


@dataclass(frozen=True)
class FieldKind:
    name: str
    type: T.DataType
    kind: str  # key, atomic, struct, array, map, suppressed
    clearable: bool = False


@dataclass
class TwinSchema:
    """A validated snapshot schema.

    header: whether rows carry a header struct (else stand-alone). key_field overrides the tag. hash names the digest.
    """

    schema: T.StructType
    header: bool = True
    key_field: str | None = None
    hash: str = "blake2b"
    nested_clearable: bool = False
    warnings: list[str] = field(default_factory=list)

    def __post_init__(self):
        names = [f.name for f in self.schema.fields]
        if self.header and HEADER not in names:
            raise SchemaError("no header")
        if not self.header and HEADER in names:
            raise SchemaError("a stand-alone schema has no header")
        keys = [f.name for f in self.schema.fields if KEY in tags_of(f)]
        if self.key_field:
            if self.key_field not in names:
                raise SchemaError(f"no field {self.key_field}")
            if keys and keys != [self.key_field]:
                self.warnings.append(f"{self.key_field} overrides the tagged key {keys[0]}")
            keys = [self.key_field]
        if len(keys) != 1:
            raise SchemaError("no key field" if not keys else f"several key fields: {keys}")
        self.key = keys[0]
        check_key(self.schema[self.key].dataType)
        self.fields = [self._kind(f) for f in self.schema.fields if f.name != HEADER]

    def _kind(self, f: T.StructField) -> FieldKind:
        if f.name == self.key:
            return FieldKind(f.name, f.dataType, "key")
        return kind_of(f, self.nested_clearable)

    def delta_schema(self) -> T.StructType:
        """Table of changes: one struct a field, without suppressed fields."""
        out = [T.StructField(HEADER, self.schema[HEADER].dataType)] if self.header else []
        for k in self.fields:
            if k.kind == "key":
                out.append(T.StructField(k.name, k.type))
            elif k.kind != "suppressed":
                out.append(T.StructField(k.name, delta_type(k, self.nested_clearable)))
        return T.StructType(out)


def check_key(kind: T.DataType, inside: bool = False) -> None:
    if isinstance(kind, T.StructType) and not inside:
        for f in kind.fields:
            check_key(f.dataType, True)
    elif not isinstance(kind, (T.IntegralType, T.StringType, T.BooleanType)):
        raise SchemaError(f"a key may not hold {kind.simpleString()}")


def kind_of(f: T.StructField, nested_clearable: bool = False, inside: bool = False) -> FieldKind:
    tags, t = tags_of(f), f.dataType
    primary = [x for x in (NESTED, OMIT, RETIRED, COMMUTATIVE) if x in tags]
    if len(primary) > 1:
        raise SchemaError(f"{f.name}: {primary} exclude each other")
    if CLEARABLE in tags and NESTED not in tags:
        raise SchemaError(f"{f.name}: clearable needs nested")
    if CLEARABLE in tags and inside and not nested_clearable:
        raise SchemaError(f"{f.name}: clearable inside a nested type is not supported")
    if KEY in tags and inside:
        raise SchemaError(f"{f.name}: a key inside a nested type")
    if OMIT in tags or RETIRED in tags:
        return FieldKind(f.name, t, "suppressed")
    if NESTED not in tags:
        return FieldKind(f.name, t, "atomic")
    if isinstance(t, T.StructType):
        if HEADER in t.names:
            raise SchemaError(f"{f.name}: a nested type has no header")
        for g in t.fields:
            kind_of(g, nested_clearable, True)
        return FieldKind(f.name, t, "struct", CLEARABLE in tags)
    if isinstance(t, (T.ArrayType, T.MapType)):
        return FieldKind(f.name, t, "array" if isinstance(t, T.ArrayType) else "map", CLEARABLE in tags)
    raise SchemaError(f"{f.name}: nested needs a struct, an array or a map")


def inner_kinds(t: T.StructType, nested_clearable: bool = False) -> list[FieldKind]:
    return [kind_of(f, nested_clearable, True) for f in t.fields]


def delta_type(k: FieldKind, nested_clearable: bool = False) -> T.DataType:
    if k.kind == "struct":
        inner: T.DataType = T.StructType([T.StructField(x.name, delta_type(x, nested_clearable)) for x in inner_kinds(k.type, nested_clearable) if x.kind != "suppressed"])
    elif k.kind == "array":
        inner = T.StructType([T.StructField("added", k.type), T.StructField("removed", k.type)])
    elif k.kind == "map":
        inner = T.StructType([T.StructField("removed", T.ArrayType(k.type.keyType)), T.StructField("updated", k.type)])
    else:
        return T.StructType([T.StructField("op", T.ByteType()), T.StructField("value", k.type)])
    return T.StructType([T.StructField("op", T.ByteType()), T.StructField("value", inner)]) if k.clearable else inner


# ---------------------------------------------------------------- reading rows of a schema


def zero_of(t: T.DataType) -> Column:
    """The zero value of a type; arrays, maps and times have none and stay null."""
    if isinstance(t, T.BooleanType):
        return F.lit(False)
    if isinstance(t, (T.IntegralType, T.FractionalType)):
        return F.lit(0).cast(t)
    if isinstance(t, T.StringType):
        return F.lit("")
    if isinstance(t, T.BinaryType):
        return F.unhex(F.lit(""))
    if isinstance(t, T.StructType):
        return F.struct(*(zero_of(f.dataType).alias(f.name) for f in t.fields)).cast(t)
    return F.lit(None).cast(t)


def with_zero_defaults(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the schema's columns: nulls of non-pointer fields are zero, missing columns are null (or zero)."""
    def one(f: T.StructField) -> Column:
        value = F.col(f"`{f.name}`").cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        return (value if f.metadata.get("pointer") else F.coalesce(value, zero_of(f.dataType))).alias(f.name)

    return df.select(*(one(f) for f in schema.fields))


def assert_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df, if every column that the schema names and df has is of its type."""
    have = {f.name: f.dataType for f in df.schema.fields}
    wrong = [f"{f.name}: {have[f.name].simpleString()}, not {f.dataType.simpleString()}" for f in schema.fields if f.name in have and have[f.name].simpleString() != f.dataType.simpleString()]
    if wrong:
        raise SchemaError("; ".join(wrong))
    return df


def flattened(df: DataFrame, embedded: str) -> DataFrame:
    """The embedded struct's fields as columns, but those that an outer column shadows."""
    outer = [c for c in df.columns if c != embedded]
    return df.select(*outer, *(F.col(f"{embedded}.{f}") for f in df.schema[embedded].dataType.names if f not in outer))


def exported(df: DataFrame) -> DataFrame:
    """Columns whose names don't start with an underscore."""
    return df.select(*(c for c in df.columns if not c.startswith("_")))


def try_columns(df: DataFrame, casts: dict[str, T.DataType]) -> DataFrame:
    """Columns cast as told; bad values are zero and listed in `errors` (array of column names)."""
    bad = F.filter(F.array(*(F.when(F.col(c).isNotNull() & F.expr(f"try_cast(`{c}` as {t.simpleString()})").isNull(), F.lit(c)) for c, t in casts.items())), lambda x: x.isNotNull())
    good = {c: F.coalesce(F.expr(f"try_cast(`{c}` as {t.simpleString()})"), zero_of(t)) for c, t in casts.items()}
    return df.withColumn("errors", bad).withColumns(good)


def annotate(schema: T.StructType, names: dict[str, str] | None = None) -> T.StructType:
    """Fields renamed for files (original name kept in metadata `origin`), with the physical type in metadata `physical`."""
    # Logical to physical types of the file format.
    physical = {"string": "BYTE_ARRAY/String", "bigint": "INT64", "int": "INT32", "boolean": "BOOLEAN", "float": "FLOAT", "double": "DOUBLE", "binary": "BYTE_ARRAY", "timestamp": "INT64/TIMESTAMP_MILLIS"}
    kind = lambda t: "LIST" if isinstance(t, T.ArrayType) else physical.get(t.simpleString(), t.typeName().upper())
    return T.StructType([T.StructField((names or {}).get(f.name, f.name), f.dataType, f.nullable, f.metadata | {"origin": f.metadata.get("origin", f.name), "physical": kind(f.dataType)}) for f in schema.fields])


def snake_case(name: str) -> str:
    """HTTPServerName -> http_server_name."""
    out = ""
    for i, ch in enumerate(name):
        new = ch.isupper() and i and (name[i - 1].islower() or name[i - 1].isdigit() or (i + 1 < len(name) and name[i + 1].islower() and name[i - 1].isalpha()))
        out += ("_" if new else "") + ch.lower()
    return out
