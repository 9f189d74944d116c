"""Differences of arrays and maps and their application, as higher-order functions. Null stands for absent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T



def empty_of(kind: T.DataType) -> Column:
    return (F.create_map() if isinstance(kind, T.MapType) else F.array()).cast(kind)


def minus(a: Column, b: Column) -> Column:
    """Elements of a that b lacks, duplicates kept. Both are non-null.

    The missing values come from a hashed difference; only these few are compared with a's elements.
    """
    return F.get(F.transform(F.array(F.array_except(a, b)), lambda gone: F.when(F.size(gone) == 0, F.filter(a, lambda x: F.lit(False))).otherwise(F.filter(a, lambda x: F.exists(gone, lambda y: x.eqNullSafe(y))))), 0)


def array_apply(a: Column, added: Column, removed: Column) -> Column:
    """a without the removed elements, then the added ones."""
    return F.concat(minus(a, removed), added)


def map_removed(a: Column, b: Column) -> Column:
    """Keys of a that b lacks, in order."""
    return F.array_sort(F.array_except(F.map_keys(a), F.map_keys(b)))


def map_updated(a: Column, b: Column) -> Column:
    """Entries of b that are new or differ in a."""
    return F.map_filter(b, lambda k, v: ~F.map_contains_key(a, k) | ~F.element_at(a, k).eqNullSafe(v))


def map_apply(a: Column, removed: Column, updated: Column) -> Column:
    """Removes first, then sets; an entry in both stays."""
    kept = F.map_filter(a, lambda k, v: ~F.array_contains(removed, k) & ~F.map_contains_key(updated, k))
    return F.map_concat(kept, updated)


def map_as_text(m: Column) -> Column:
    """Sorted key=value pairs, for comparisons that MAP columns don't allow."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"].cast("string"), F.lit("="), F.coalesce(e["value"].cast("string"), F.lit("")))), ",")
