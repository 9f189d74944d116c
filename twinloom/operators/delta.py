"""Delta algebra over snapshot structs: diff, apply and coalesce as expressions that walk the schema at plan time.

Deltas keep all three states of a change: ignore (op 0), assert (1) with its value (null for a pointer set to nothing),
retract (2) to zero. Null and empty collections are the same to diff, except that a clearable collection retracts only
when it becomes null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinloom.functions import collections as K
from twinloom.operators import header as H
from twinloom.operators.schema import ASSERT, HEADER, IGNORE, RETRACT, FieldKind, TwinSchema, delta_type, inner_kinds, zero_of


def _holds_map(t: T.DataType) -> bool:
    if isinstance(t, T.ArrayType):
        return _holds_map(t.elementType)
    return isinstance(t, T.MapType) or isinstance(t, T.StructType) and any(_holds_map(f.dataType) for f in t.fields)


def _comparable(a: Column, t: T.DataType) -> Column:
    """a with maps, at any depth, as sorted entries."""
    if not _holds_map(t):
        return a
    if isinstance(t, T.ArrayType):
        return F.transform(a, lambda x: _comparable(x, t.elementType))
    if isinstance(t, T.MapType):
        return F.array_sort(F.transform(F.map_entries(a), lambda e: F.struct(e["key"].alias("key"), _comparable(e["value"], t.valueType).alias("value"))))
    return F.when(a.isNotNull(), F.struct(*(_comparable(a[f.name], f.dataType).alias(f.name) for f in t.fields)))


def _same(a: Column, b: Column, t: T.DataType) -> Column:
    """Equality with nulls; maps, at any depth, by their sorted entries."""
    return _comparable(a, t).eqNullSafe(_comparable(b, t))


def _op(op: Column, value: Column, t: T.DataType) -> Column:
    return F.struct(op.cast("byte").alias("op"), value.alias("value")).cast(t)


def diff_field(a: Column, b: Column, k: FieldKind, deep: bool = False) -> Column:
    """What changes a into b."""
    t = delta_type(k, deep)
    if k.kind == "atomic":
        changed = ~_same(a, b, k.type)
        return _op(F.when(changed, ASSERT).otherwise(IGNORE), F.when(changed, b), t)
    inner = t["value"].dataType if k.clearable else t
    if k.kind == "struct":
        kinds = [x for x in inner_kinds(k.type, deep) if x.kind != "suppressed"]
        body = F.struct(*(diff_field(a[x.name], b[x.name], x, deep).alias(x.name) for x in kinds)).cast(inner)
        changed, cleared = ~_same(a, b, k.type), _same(b, zero_of(k.type), k.type) | b.isNull()
    else:
        x, y = F.coalesce(a, K.empty_of(k.type)), F.coalesce(b, K.empty_of(k.type))
        if k.kind == "array":
            added, removed = K.minus(y, x), K.minus(x, y)
            body = F.struct(added.alias("added"), removed.alias("removed")).cast(inner)
            changed = (F.size(added) > 0) | (F.size(removed) > 0)
        else:
            gone, new = K.map_removed(x, y), K.map_updated(x, y)
            body = F.struct(gone.alias("removed"), new.alias("updated")).cast(inner)
            changed = (F.size(gone) > 0) | (F.size(F.map_keys(new)) > 0)
        cleared = b.isNull() & (F.size(F.map_keys(x) if k.kind == "map" else x) > 0)
        changed = changed | cleared
    if not k.clearable:
        return body
    op = F.when(~changed, IGNORE).when(cleared, RETRACT).otherwise(ASSERT)
    return _op(op, F.when(op == ASSERT, body), t)


def apply_field(s: Column, d: Column, k: FieldKind, deep: bool = False) -> Column:
    """s after the change d; a null change leaves it."""
    if k.kind in ("key", "suppressed"):
        return s
    if k.kind == "atomic":
        return F.when(d["op"] == ASSERT, d["value"]).when(d["op"] == RETRACT, zero_of(k.type)).otherwise(s)
    body = d["value"] if k.clearable else d
    if k.kind == "struct":
        made = F.struct(*(apply_field(s[x.name], body[x.name], x, deep).alias(x.name) for x in inner_kinds(k.type, deep))).cast(k.type)
    elif k.kind == "array":
        made = K.array_apply(F.coalesce(s, K.empty_of(k.type)), F.coalesce(body["added"], K.empty_of(k.type)), F.coalesce(body["removed"], K.empty_of(k.type)))
    else:
        keys = T.ArrayType(k.type.keyType)
        made = K.map_apply(F.coalesce(s, K.empty_of(k.type)), F.coalesce(body["removed"], K.empty_of(keys)), F.coalesce(body["updated"], K.empty_of(k.type)))
    if k.clearable:
        gone = zero_of(k.type) if k.kind == "struct" else F.lit(None).cast(k.type)
        return F.when(d["op"] == RETRACT, gone).when(d["op"] == ASSERT, made).otherwise(s)
    return F.when(body.isNull(), s).otherwise(made)


def diff(a: Column, b: Column, twin: TwinSchema) -> Column:
    """Struct `error, delta`: the header's checks, and the change from snapshot a to b (null on error)."""
    fields = [(b[k.name] if k.kind == "key" else diff_field(a[k.name], b[k.name], k, twin.nested_clearable)).alias(k.name) for k in twin.fields if k.kind != "suppressed"]
    if not twin.header:
        return F.struct(F.lit(None).cast("string").alias("error"), F.struct(*fields).alias("delta"))
    h = H.header_for_diff(a[HEADER], b[HEADER])
    return F.struct(h["error"].alias("error"), F.when(h["error"].isNull(), F.struct(h["header"].alias(HEADER), *fields)).alias("delta"))


def apply(s: Column, d: Column, twin: TwinSchema) -> Column:
    """Struct `error, snapshot`: the header's checks, and s after the change d (null on error)."""
    have = {k.name for k in twin.fields if k.kind != "suppressed"}
    fields = [apply_field(s[k.name], d[k.name] if k.name in have else s[k.name], k, twin.nested_clearable).alias(k.name) for k in twin.fields]
    if not twin.header:
        return F.struct(F.lit(None).cast("string").alias("error"), F.struct(*fields).alias("snapshot"))
    h = H.header_after_apply(s[HEADER], d[HEADER])
    return F.struct(h["error"].alias("error"), F.when(h["error"].isNull(), F.struct(h["header"].alias(HEADER), *fields)).alias("snapshot"))


def full_delta(s: Column, twin: TwinSchema) -> Column:
    """A snapshot as the delta that asserts all of it (from zero)."""
    zero = {k.name: F.lit(None).cast(k.type) for k in twin.fields}

    def one(k: FieldKind) -> Column:
        if k.kind == "key":
            return s[k.name]
        if k.kind == "atomic":
            return _op(F.lit(ASSERT), s[k.name], delta_type(k))
        return diff_field(zero_of(k.type) if k.kind == "struct" else zero[k.name], s[k.name], k, twin.nested_clearable)

    return F.struct(*([s[HEADER].alias(HEADER)] if twin.header else []), *(one(k).alias(k.name) for k in twin.fields if k.kind != "suppressed"))


def is_empty(d: Column, k: FieldKind, deep: bool = False) -> Column:
    """Whether a field's change changes nothing (a null one too)."""
    if k.kind == "atomic" or k.clearable:
        return d.isNull() | (d["op"] == IGNORE)
    if k.kind == "struct":
        return d.isNull() | reduce(lambda x, y: x & y, (is_empty(d[x.name], x, deep) for x in inner_kinds(k.type, deep) if x.kind != "suppressed"), F.lit(True))
    parts = (d["added"], d["removed"]) if k.kind == "array" else (d["removed"], F.map_keys(d["updated"]))
    return d.isNull() | reduce(lambda x, y: x & y, (F.coalesce(F.size(x) <= 0, F.lit(True)) for x in parts))


def unchanged(d: Column, twin: TwinSchema) -> Column:
    """Whether a delta changes no field."""
    return reduce(lambda x, y: x & y, (is_empty(d[k.name], k, twin.nested_clearable) for k in twin.fields if k.kind not in ("key", "suppressed")), F.lit(True))


def coalesce_rows(deltas: DataFrame, by: list[str], order: str, fields: dict[str, T.DataType]) -> DataFrame:
    """Atomic changes of each chain folded into one: per field the last assert or retract in order.

    No array of the chain is made, so chains of any length aggregate map-side and spill.
    """
    last = {f: F.max_by(F.when(F.col(f"{f}.op") != IGNORE, F.col(f)), F.when(F.col(f"{f}.op") != IGNORE, F.col(order))) for f in fields}
    return deltas.groupBy(*by).agg(*(x.alias(f) for f, x in last.items()), F.max(order).alias(order))


def coalesce_fold(snapshot: Column, deltas: Column, twin: TwinSchema) -> Column:
    """Struct `error, snapshot`: the deltas (an array, in order) applied one after the other; the first error stays.

    For nested changes, whose fold depends on order. Cadence snapshots bound how long such arrays get.
    """
    kind = T.StructType([T.StructField("error", T.StringType()), T.StructField("snapshot", twin.schema)])

    def step(acc: Column, d: Column) -> Column:
        return F.when(acc["error"].isNotNull(), acc).otherwise(apply(acc["snapshot"], d, twin).cast(kind))

    return F.reduce(deltas, F.struct(F.lit(None).cast("string").alias("error"), snapshot.alias("snapshot")).cast(kind), step)


def compose_field(d: Column, e: Column, k: FieldKind, deep: bool = False) -> Column:
    """The one change that d and then e make."""
    if k.kind == "key":
        return F.coalesce(e, d)
    if k.kind == "atomic":
        return F.when(e["op"].isNull() | (e["op"] == IGNORE), d).otherwise(e)
    if k.clearable:
        raise TypeError(f"{k.name}: clearing and then changing isn't one change")
    t = delta_type(k, deep)
    if k.kind == "struct":
        made = F.struct(*(compose_field(d[x.name], e[x.name], x, deep).alias(x.name) for x in inner_kinds(k.type, deep) if x.kind != "suppressed"))
    elif k.kind == "array":
        made = F.struct(F.concat(K.minus(d["added"], e["removed"]), e["added"]).alias("added"), F.array_distinct(F.concat(d["removed"], e["removed"])).alias("removed"))
    else:
        kept = F.map_filter(d["updated"], lambda key, _: ~F.array_contains(e["removed"], key) & ~F.map_contains_key(e["updated"], key))
        made = F.struct(F.array_distinct(F.concat(d["removed"], e["removed"])).alias("removed"), F.map_concat(kept, e["updated"]).alias("updated"))
    return F.when(d.isNull(), e).when(e.isNull(), d).otherwise(made.cast(t))


def compose(deltas: Column, twin: TwinSchema) -> Column:
    """The deltas (an array, in order, not empty) as one that does the same to any snapshot. Clearable fields have none.

    With a header, it is the last delta's, with the provenance of all.
    """
    t = twin.delta_schema()

    def step(d: Column, e: Column) -> Column:
        head = []
        if twin.header:
            head = [F.struct(*((H.concatenated(d[HEADER], e[HEADER]) if f == "provenance" else e[HEADER][f]).alias(f) for f in t[HEADER].dataType.names)).alias(HEADER)]
        return F.struct(*head, *(compose_field(d[k.name], e[k.name], k, twin.nested_clearable).alias(k.name) for k in twin.fields if k.kind != "suppressed")).cast(t)

    return F.reduce(F.slice(deltas, F.lit(2), F.size(deltas)), F.get(deltas, 0).cast(t), step)


def versions(deltas: DataFrame, by: list[str], order: str, fields: list[str]) -> DataFrame:
    """All versions of atomic fields: each row has every field's last asserted value so far on its chain."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return deltas.select(*by, order, *(F.last(F.when(F.col(f"{f}.op") != IGNORE, F.col(f)), True).over(w)["value"].alias(f) for f in fields))
