"""Accessors .list, .struct, .cat and .name."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lower import Context


def _values(c: Column) -> Column:
    return F.filter(c, lambda x: x.isNotNull())


class ListAccessor:
    def __init__(self, expr: Any):
        self.e = expr

    def len(self) -> Any:
        return self.e._map(lambda c: F.array_size(c))

    def unique(self, *, maintain_order: bool = False) -> Any:
        return self.e._map(F.array_distinct)

    def contains(self, item: Any) -> Any:
        def fn(c: Column, x: Column) -> Column:
            return F.when(c.isNotNull(), F.coalesce(F.when(x.isNull(), F.exists(c, lambda v: v.isNull())), F.array_contains(c, x), F.lit(False)))

        return self.e._elem(lambda ctx, c, x: fn(c, x.cast(ctx.dtype(c).elementType)), item)

    def get(self, index: int) -> Any:
        if index < 0:
            raise ValueError("index must not be negative")
        return self.e._map(lambda c: F.get(c, F.lit(index)))

    def min(self) -> Any:
        return self.e._map(F.array_min)

    def max(self) -> Any:
        return self.e._map(F.array_max)

    def sum(self) -> Any:
        def fn(ctx: Context, c: Column) -> Column:
            kind = ctx.dtype(c).elementType
            zero = F.lit(0.0) if isinstance(kind, (T.DoubleType, T.FloatType)) else F.lit(0).cast("long")
            total = "double" if isinstance(kind, (T.DoubleType, T.FloatType)) else "long"
            return F.aggregate(_values(c), zero, lambda a, x: (a + x).cast(total))

        return self.e._elem(fn)

    def mean(self) -> Any:
        def fn(c: Column) -> Column:
            v = _values(c)
            return F.try_divide(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double")), F.size(v).cast("double"))

        return self.e._map(fn)

    def median(self) -> Any:
        def fn(c: Column) -> Column:
            v = F.array_sort(_values(c))
            n = F.size(v)
            at = lambda k: F.get(v, k.cast("int")).cast("double")
            return F.when(n > 0, (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2)

        return self.e._map(fn)

    def sort(self, *, descending: bool = False, nulls_last: bool = False) -> Any:
        if descending:
            return self.e._map((lambda c: F.sort_array(c, False)) if nulls_last else (lambda c: F.reverse(F.array_sort(c))))
        return self.e._map(F.array_sort if nulls_last else F.sort_array)


class StructAccessor:
    def __init__(self, expr: Any):
        self.e = expr

    def field(self, name: str) -> Any:
        return self.e._map(lambda c: c.getField(name)).alias(name)


class CatAccessor:
    def __init__(self, expr: Any):
        self.e = expr

    def get_categories(self) -> Any:
        """The distinct categories as one sorted list per frame or group."""
        return self.e._agg(lambda a: F.array_sort(a(F.collect_set(a.c))))


class NameAccessor:
    def __init__(self, expr: Any):
        self.e = expr

    def map(self, function: Callable[[str], str]) -> Any:
        return type(self.e)("name", lambda root, now: function(root), (self.e,))

    def keep(self) -> Any:
        return self.map(lambda n: n)

    def prefix(self, prefix: str) -> Any:
        return self.map(lambda n: prefix + n)

    def suffix(self, suffix: str) -> Any:
        return self.map(lambda n: n + suffix)

    def to_lowercase(self) -> Any:
        return self.map(str.lower)

    def to_uppercase(self) -> Any:
        return self.map(str.upper)
