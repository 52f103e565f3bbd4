"""The expression language: immutable trees that `plans.lower` turns into Spark columns."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import dtypes as dt
from .errors import InvalidOperationError
from .plans import numeric as N
from .plans import whole as W
from .plans.lower import Agg, Context, column, has_window, window

_NONE = object()


class Expr:
    """An expression. kind: root | elem | hori | agg | win | over | filt | name; scalar: one value for all rows."""

    def __init__(self, kind: str, fn: Callable | None = None, args: Iterable[Expr] = (), *, label: str = "", name: str | None = None, extra: Any = None, scalar: bool | None = None):
        self.kind, self.fn, self.args, self.label, self.out_name, self.extra = kind, fn, tuple(args), label, name, extra
        self.scalar = scalar if scalar is not None else kind == "agg" or (kind in ("elem", "hori", "name") and all(a.scalar for a in self.args))

    # --- building ---
    def _elem(self, fn: Callable[..., Column], *others: Any) -> Expr:
        """fn(ctx, column, *columns)"""
        return Expr("elem", fn, (self, *(into(o) for o in others)))

    def _map(self, fn: Callable[..., Column], *others: Any) -> Expr:
        """fn(column, *columns)"""
        return self._elem(lambda _, *c: fn(*c), *others)

    def _agg(self, fn: Callable[[Agg], Column], *others: Any) -> Expr:
        return Expr("agg", fn, (self, *(into(o) for o in others)))

    def _win(self, fn: Callable[..., Column], *others: Any) -> Expr:
        return Expr("win", fn, (self, *(into(o) for o in others)))

    def __bool__(self) -> bool:
        raise TypeError("an expression has no truth value: use &, | and ~")

    # --- operators ---
    def __eq__(self, o: Any) -> Expr:  # type: ignore[override]
        return self._map(lambda a, b: a == b, o)

    def __ne__(self, o: Any) -> Expr:  # type: ignore[override]
        return self._map(lambda a, b: a != b, o)

    __hash__ = object.__hash__

    def __lt__(self, o: Any) -> Expr:
        return self._map(lambda a, b: a < b, o)

    def __le__(self, o: Any) -> Expr:
        return self._map(lambda a, b: a <= b, o)

    def __gt__(self, o: Any) -> Expr:
        return self._map(lambda a, b: a > b, o)

    def __ge__(self, o: Any) -> Expr:
        return self._map(lambda a, b: a >= b, o)

    def __and__(self, o: Any) -> Expr:
        return self._map(lambda a, b: a & b, o)

    def __or__(self, o: Any) -> Expr:
        return self._map(lambda a, b: a | b, o)

    def __rand__(self, o: Any) -> Expr:
        return self._reflected(o, "__and__")

    def __ror__(self, o: Any) -> Expr:
        return self._reflected(o, "__or__")

    def __invert__(self) -> Expr:
        return self._map(lambda a: ~a)

    def __neg__(self) -> Expr:
        return self._map(lambda a: -a)

    def _reflected(self, o: Any, name: str) -> Expr:
        return getattr(into(o), name)(self).alias("literal")

    def __add__(self, o: Any) -> Expr:
        return self._map(lambda a, b: a + b, o)

    def __sub__(self, o: Any) -> Expr:
        return self._map(lambda a, b: a - b, o)

    def __mul__(self, o: Any) -> Expr:
        return self._map(lambda a, b: a * b, o)

    def __truediv__(self, o: Any) -> Expr:
        return self._elem(N.true_div, o)

    def __floordiv__(self, o: Any) -> Expr:
        return self._elem(N.floor_div, o)

    def __mod__(self, o: Any) -> Expr:
        return self._elem(N.modulo, o)

    def __pow__(self, o: Any) -> Expr:
        return self._elem(N.power, o)

    def __radd__(self, o: Any) -> Expr:
        return self._reflected(o, "__add__")

    def __rsub__(self, o: Any) -> Expr:
        return self._reflected(o, "__sub__")

    def __rmul__(self, o: Any) -> Expr:
        return self._reflected(o, "__mul__")

    def __rtruediv__(self, o: Any) -> Expr:
        return self._reflected(o, "__truediv__")

    def __rfloordiv__(self, o: Any) -> Expr:
        return self._reflected(o, "__floordiv__")

    def __rmod__(self, o: Any) -> Expr:
        return self._reflected(o, "__mod__")

    def __rpow__(self, o: Any) -> Expr:
        return self._reflected(o, "__pow__")

    # --- names, casts, user functions ---
    def alias(self, name: str) -> Expr:
        return Expr("name", lambda root, now: name, (self,))

    def pipe(self, function: Callable[..., Any], *args: Any, **kwargs: Any) -> Any:
        return function(self, *args, **kwargs)

    def cast(self, dtype: Any) -> Expr:
        return self._elem(lambda ctx, c: N.cast(ctx, c, dtype))

    def map_batches(self, function: Callable, return_dtype: Any = None, *, returns_scalar: bool = False) -> Expr:
        """A Python function on Arrow-backed pandas batches (a scalar one sees the whole group). Needs return_dtype."""
        import pandas as pd

        if return_dtype is None:
            raise InvalidOperationError("map_batches needs return_dtype: Spark plans before it runs")
        kind = dt.to_spark(return_dtype)
        if returns_scalar:

            def whole(s: pd.Series) -> Any:
                return function(s)

            whole.__annotations__ = {"s": pd.Series, "return": Any}
            udf = F.pandas_udf(whole, kind, F.PandasUDFType.GROUPED_AGG) if hasattr(F, "PandasUDFType") else F.pandas_udf(whole, kind)
            return self._agg(lambda a: a(udf(a.c)))

        def batch(s: pd.Series) -> pd.Series:
            return pd.Series(function(s))

        batch.__annotations__ = {"s": pd.Series, "return": pd.Series}
        udf = F.pandas_udf(batch, kind)
        return self._map(lambda c: udf(c))

    def replace_strict(self, old: Any, new: Any = None, *, default: Any = _NONE, return_dtype: Any = None) -> Expr:
        """Map values; a value without a counterpart gets `default`, or raises where there is none. Null stays null then."""
        if new is None and isinstance(old, Mapping):
            old, new = list(old), list(old.values())
        old, new = list(old), list(new)
        if len(old) != len(new):
            raise InvalidOperationError("old and new differ in length")
        other = [] if default is _NONE else [into(default)]

        def fn(c: Column, *d: Column) -> Column:
            out = F.when(F.lit(False), F.lit(None))
            for a, b in zip(old, new, strict=True):
                out = out.when(c.isNull() if a is None else c == F.lit(a), F.lit(b))
            miss = d[0] if d else F.when(c.isNotNull(), F.raise_error(F.concat(F.lit("no replacement for "), c.cast("string"))))
            return out.otherwise(miss) if d else F.when(c.isNull() & F.lit(None not in old), F.lit(None)).otherwise(out.otherwise(miss))

        out = Expr("elem", lambda _, *c: fn(*c), (self, *other))
        return out if return_dtype is None else out.cast(return_dtype)

    def over(self, *partition_by: Any, order_by: Any = None) -> Expr:
        keys = [into(k, name=True) for k in flat(partition_by)]
        order = [into(k, name=True) for k in flat([] if order_by is None else order_by)]
        if not keys and not order:
            raise InvalidOperationError("over needs partition_by or order_by")
        if self.kind == "over":
            raise InvalidOperationError("over of over")
        if self.kind == "root" or not has_window(self):
            raise InvalidOperationError("over needs an aggregate or a window function")
        return Expr("over", None, (self,), extra=(keys, order), scalar=False)

    # --- aggregates ---
    def sum(self) -> Expr:
        def fn(a: Agg) -> Column:
            once = a.distinct
            c = a.raw if once else a.c
            c = c.cast("long") if isinstance(a.ctx.dtype(c), T.BooleanType) else c
            return F.coalesce(a(F.sum_distinct(c) if once else F.sum(c)), F.lit(0))

        return self._agg(fn)

    def mean(self) -> Expr:
        return self._agg(lambda a: a(F.avg(a.c.cast("double") if isinstance(a.ctx.dtype(a.c), T.BooleanType) else a.c)))

    def median(self) -> Expr:
        def fn(a: Agg) -> Column:
            if isinstance(a.ctx.dtype(a.c), (T.StringType, T.BooleanType)):
                raise InvalidOperationError("median needs numbers")
            return a(F.median(a.c))

        return self._agg(fn)

    def min(self) -> Expr:
        return self._agg(lambda a: a(F.min(a.c)))

    def max(self) -> Expr:
        return self._agg(lambda a: a(F.max(a.c)))

    def count(self) -> Expr:
        return self._agg(lambda a: a(F.count_distinct(a.raw) if a.distinct else F.count(a.c)))

    def len(self) -> Expr:
        def fn(a: Agg) -> Column:
            if a.distinct:
                return a.n_unique()
            _ = a.c  # sets the condition
            return a(a.rows())

        return self._agg(fn)

    def n_unique(self) -> Expr:
        return self._agg(lambda a: a.n_unique())

    def null_count(self) -> Expr:
        def fn(a: Agg) -> Column:
            null = a.c.isNull()
            return a(F.count_if(null if a.mask is None else a.mask & null))

        return self._agg(fn)

    def any(self) -> Expr:
        return self._agg(lambda a: F.coalesce(a(F.bool_or(a.c)), F.lit(False)))

    def all(self) -> Expr:
        return self._agg(lambda a: F.coalesce(a(F.bool_and(a.c)), F.lit(True)))

    def var(self, *, ddof: int = 1) -> Expr:
        return self._agg(lambda a: N.variance(a, ddof))

    def std(self, *, ddof: int = 1) -> Expr:
        return self._agg(lambda a: F.sqrt(N.variance(a, ddof)))

    def skew(self) -> Expr:
        return self._agg(lambda a: a(F.skewness(a.c)))

    def kurtosis(self) -> Expr:
        return self._agg(lambda a: a(F.kurtosis(a.c)))

    def quantile(self, quantile: float, interpolation: str = "linear") -> Expr:
        """Exact quantile."""
        return self._agg(lambda a: N.quantile(a, quantile, interpolation))

    def first(self, order_by: Any = None) -> Expr:
        return self._edge(order_by, last=False)

    def last(self, order_by: Any = None) -> Expr:
        return self._edge(order_by, last=True)

    def _edge(self, order_by: Any, *, last: bool) -> Expr:
        keys = [into(k, name=True) for k in flat([] if order_by is None else order_by)]

        def fn(a: Agg) -> Column:
            order = a.others or list((a.ctx.window.order if a.ctx.window else ()) or a.ctx.order)
            if not order:
                raise InvalidOperationError("first and last depend on the order of rows: give order_by")
            # Nulls sort first: a flag before each key. The struct around the value keeps null values.
            key = F.struct(*[x for k, o in enumerate(order) for x in (o.isNotNull().alias(f"n{k}"), o.alias(f"k{k}"))])
            value = F.struct(a.c.alias("v"))
            key = key if a.mask is None else F.when(a.mask, key)
            return a((F.max_by if last else F.min_by)(value, key))["v"]

        return self._agg(fn, *keys)

    def any_value(self, *, ignore_nulls: bool = False) -> Expr:
        return self._agg(lambda a: a(F.any_value(a.c, F.lit(ignore_nulls))))

    def mode(self, *, keep: str = "all") -> Expr:
        """keep='any': one most frequent value (the smallest); keep='all': each of them once, for an aggregate that has
        to follow (an eager frame may also select them)."""
        if keep == "any":
            return self._agg(lambda a: a(F.mode(a.c, True)))
        if keep != "all":
            raise ValueError(f"keep {keep!r}")
        return Expr("filt", None, (self,), label="mode")

    # --- before an aggregate ---
    def filter(self, *predicates: Any) -> Expr:
        p = flat(predicates)
        return Expr("filt", lambda _, c, *m: F.coalesce(_all(m), F.lit(False)), (self, *(into(x) for x in p)), label="filter")

    def drop_nulls(self) -> Expr:
        return Expr("filt", lambda _, c: c.isNotNull(), (self,), label="drop_nulls")

    def unique(self) -> Expr:
        return Expr("filt", lambda _, c: None, (self,), label="unique")

    # --- predicates and nulls ---
    def is_between(self, lower_bound: Any, upper_bound: Any, closed: str = "both") -> Expr:
        if closed not in ("both", "left", "right", "none"):
            raise ValueError(f"closed {closed!r}")

        def fn(c: Column, lo: Column, hi: Column) -> Column:
            return (c >= lo if closed in ("both", "left") else c > lo) & (c <= hi if closed in ("both", "right") else c < hi)

        return self._map(fn, lower_bound, upper_bound)

    def is_in(self, other: Iterable[Any]) -> Expr:
        values = list(other)
        has_null = any(v is None for v in values)
        values = [v for v in values if v is not None]
        return self._map(lambda c: (c.isin(values) if values else (F.lit(False) if not has_null else c.isNull() & F.lit(False))))

    def is_null(self) -> Expr:
        return self._map(lambda c: c.isNull())

    def is_nan(self) -> Expr:
        return self._elem(lambda ctx, c: F.when(c.isNotNull(), F.isnan(c)) if N.is_float(ctx, c) else F.when(c.isNotNull(), F.lit(False)))

    def is_finite(self) -> Expr:
        return self._elem(lambda ctx, c: F.when(c.isNotNull(), ~F.isnan(c) & (F.abs(c) != F.lit(math.inf))) if N.is_float(ctx, c) else F.when(c.isNotNull(), F.lit(True)))

    def is_close(self, other: Any, *, abs_tol: float = 0.0, rel_tol: float = 1e-9, nans_equal: bool = False) -> Expr:
        if abs_tol < 0 or not 0 <= rel_tol < 1:
            raise ValueError("abs_tol must be at least 0, rel_tol in [0, 1)")

        def fn(a: Column, b: Column) -> Column:
            a, b = a.cast("double"), b.cast("double")
            inf = lambda x: F.abs(x) == F.lit(math.inf)
            near = F.abs(a - b) <= F.greatest(rel_tol * F.greatest(F.abs(a), F.abs(b)), F.lit(abs_tol))
            out = F.when(F.isnan(a) | F.isnan(b), F.isnan(a) & F.isnan(b) & F.lit(nans_equal)).when(inf(a) | inf(b), a == b).otherwise(near)
            return F.when(a.isNotNull() & b.isNotNull(), out)

        return self._map(fn, other)

    def fill_null(self, value: Any = None, strategy: str | None = None, limit: int | None = None) -> Expr:
        if (value is None) == (strategy is None):
            raise ValueError("give either value or strategy")
        if strategy is None:
            return self._map(lambda c, v: F.coalesce(c, v), value)
        if strategy not in ("forward", "backward"):
            raise ValueError(f"strategy {strategy!r}")

        def fn(ctx: Context, c: Column) -> Column:
            forward = strategy == "forward"
            if limit is None:
                return W.filled(ctx, c, forward=forward)
            if forward:
                return W.near(ctx, c, "fill_null", lambda c, o: F.last(c, ignorenulls=True).over(window(o, -limit, 0)), limit, 0)
            return W.near(ctx, c, "fill_null", lambda c, o: F.first(c, ignorenulls=True).over(window(o, 0, limit)), 0, limit)

        return self._win(fn)

    def fill_nan(self, value: float | None) -> Expr:
        return self._elem(lambda ctx, c: F.when(F.isnan(c), F.lit(value)).otherwise(c) if N.is_float(ctx, c) else c)

    def clip(self, lower_bound: Any = None, upper_bound: Any = None) -> Expr:
        """Clamp; a null stays null."""
        given = [b for b in (lower_bound, upper_bound) if b is not None]

        def fn(c: Column, *b: Column) -> Column:
            out, b = c, list(b)
            if upper_bound is not None:
                out = F.least(out, b[-1])
            if lower_bound is not None:
                out = F.greatest(out, b[0])
            return F.when(c.isNotNull(), out)

        return self._map(fn, *given)

    # --- windows ---
    def is_unique(self) -> Expr:
        return self._win(lambda ctx, c: F.count(F.lit(1)).over(N.keyed(ctx, c)) == 1)

    def is_duplicated(self) -> Expr:
        return self._win(lambda ctx, c: F.count(F.lit(1)).over(N.keyed(ctx, c)) > 1)

    def is_first_distinct(self) -> Expr:
        return self._win(lambda ctx, c: N.nth_distinct(ctx, c, last=False))

    def is_last_distinct(self) -> Expr:
        return self._win(lambda ctx, c: N.nth_distinct(ctx, c, last=True))

    def rank(self, method: str = "average", *, descending: bool = False) -> Expr:
        if method not in ("average", "min", "max", "dense", "ordinal"):
            raise ValueError(f"method {method!r}")
        return self._win(lambda ctx, c: N.rank(ctx, c, method, descending))

    def cum_sum(self, *, reverse: bool = False) -> Expr:
        return self._cum(F.sum, F.sum, lambda a, b: a + b, reverse)

    def cum_min(self, *, reverse: bool = False) -> Expr:
        return self._cum(F.min, F.min, F.least, reverse)

    def cum_max(self, *, reverse: bool = False) -> Expr:
        return self._cum(F.max, F.max, F.greatest, reverse)

    def cum_prod(self, *, reverse: bool = False) -> Expr:
        return self._cum(F.product, F.product, lambda a, b: a * b, reverse)

    def cum_count(self, *, reverse: bool = False) -> Expr:
        return self._win(lambda ctx, c: W.running(ctx, c, "cum_count", F.count, F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + b, reverse=reverse))

    def _cum(self, f: Callable[[Column], Column], again: Callable[[Column], Column], both: Callable[[Column, Column], Column], reverse: bool) -> Expr:
        def fn(ctx: Context, c: Column) -> Column:
            out = W.running(ctx, c, "a running value", f, again, lambda a, b: F.coalesce(both(a, b), b), reverse=reverse)
            return F.when(c.isNotNull(), out)

        return self._win(fn)

    def shift(self, n: int) -> Expr:
        return self._win(lambda ctx, c: W.near(ctx, c, "shift", lambda c, o: F.lag(c, n).over(N.in_order(o)), max(n, 0), max(-n, 0)))

    def diff(self) -> Expr:
        return self._win(lambda ctx, c: W.near(ctx, c, "diff", lambda c, o: c - F.lag(c).over(N.in_order(o)), 1, 0))

    def _rolling(self, f: Callable[[Column, Any], Column], size: int, min_samples: int | None, center: bool) -> Expr:
        if size < 1:
            raise ValueError("window_size must be at least 1")
        least = size if min_samples is None else min_samples
        if not 1 <= least <= size:
            raise InvalidOperationError("min_samples must be in 1..window_size")
        half, rest = divmod(size - 1, 2)
        before, after = (half + rest, half) if center else (size - 1, 0)

        def fn(c: Column, o: Any) -> Column:
            w = window(o, -before, after)
            return F.when(F.count(c).over(w) >= least, f(c, w))

        return self._win(lambda ctx, c: W.near(ctx, c, "a rolling value", fn, before, after))

    def rolling_sum(self, window_size: int, *, min_samples: int | None = None, center: bool = False) -> Expr:
        return self._rolling(lambda c, w: F.sum(c).over(w), window_size, min_samples, center)

    def rolling_mean(self, window_size: int, *, min_samples: int | None = None, center: bool = False) -> Expr:
        return self._rolling(lambda c, w: F.avg(c).over(w), window_size, min_samples, center)

    def rolling_var(self, window_size: int, *, min_samples: int | None = None, center: bool = False, ddof: int = 1) -> Expr:
        return self._rolling(lambda c, w: N.rescaled(F.var_pop(c).over(w), F.count(c).over(w), ddof), window_size, min_samples, center)

    def rolling_std(self, window_size: int, *, min_samples: int | None = None, center: bool = False, ddof: int = 1) -> Expr:
        return self._rolling(lambda c, w: F.sqrt(N.rescaled(F.var_pop(c).over(w), F.count(c).over(w), ddof)), window_size, min_samples, center)

    def ewm_mean(self, *, com: float | None = None, span: float | None = None, half_life: float | None = None, alpha: float | None = None, adjust: bool = True, min_samples: int = 1, ignore_nulls: bool = False) -> Expr:
        """Exponentially weighted mean over all rows so far; null rows stay null."""
        given = [x is not None for x in (com, span, half_life, alpha)]
        if sum(given) != 1:
            raise ValueError("give one of com, span, half_life, alpha")
        a = alpha if alpha is not None else 1 / (1 + com) if com is not None else 2 / (span + 1) if span is not None else 1 - math.exp(-math.log(2) / half_life)
        return self._win(lambda ctx, c: N.ewm(ctx, c, a, adjust, min_samples, ignore_nulls))

    # --- math ---
    def abs(self) -> Expr:
        return self._map(F.abs)

    def round(self, decimals: int = 0) -> Expr:
        return self._map(lambda c: F.round(c, decimals))

    def floor(self) -> Expr:
        return self._elem(lambda ctx, c: F.floor(c).cast(ctx.dtype(c)))

    def ceil(self) -> Expr:
        return self._elem(lambda ctx, c: F.ceil(c).cast(ctx.dtype(c)))

    def log(self, base: float = math.e) -> Expr:
        scale = 1.0 if base == math.e else math.log(base)
        return self._map(lambda c: F.when(c < 0, F.lit(math.nan)).when(c == 0, F.lit(-math.inf)).otherwise(F.log(c) / scale))

    def exp(self) -> Expr:
        return self._map(F.exp)

    def sin(self) -> Expr:
        return self._map(F.sin)

    def cos(self) -> Expr:
        return self._map(F.cos)

    def sqrt(self) -> Expr:
        return self._map(F.sqrt)

    # --- accessors ---
    @property
    def dt(self) -> Any:
        from .functions.temporal import DtAccessor

        return DtAccessor(self)

    @property
    def str(self) -> Any:
        from .functions.strings import StrAccessor

        return StrAccessor(self)

    @property
    def list(self) -> Any:
        from .functions.nested import ListAccessor

        return ListAccessor(self)

    @property
    def struct(self) -> Any:
        from .functions.nested import StructAccessor

        return StructAccessor(self)

    @property
    def cat(self) -> Any:
        from .functions.nested import CatAccessor

        return CatAccessor(self)

    @property
    def name(self) -> Any:
        from .functions.nested import NameAccessor

        return NameAccessor(self)


def _all(cols: Iterable[Column]) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & c
    return out


def flat(items: Any) -> list[Any]:
    out: list[Any] = []
    for x in items if isinstance(items, (list, tuple)) else [items]:
        out += flat(x) if isinstance(x, (list, tuple)) else [x]
    return out


def lit(value: Any, dtype: Any = None) -> Expr:
    """A literal; lists and dicts become arrays and structs."""

    def make(v: Any) -> Column:
        if isinstance(v, Mapping):
            return F.struct(*[make(x).alias(k) for k, x in v.items()])
        if isinstance(v, (list, tuple)):
            return F.array(*[make(x) for x in v])
        return F.lit(v)

    def fn(ctx: Context) -> list[tuple[str, Column]]:
        return [("literal", make(value) if dtype is None else make(value).cast(dt.to_spark(dtype)))]

    return Expr("root", fn, scalar=True, label="lit")


def col(*names: Any) -> Expr:
    wanted = flat(names)
    return Expr("root", lambda ctx: [column(n, ctx) for n in wanted], scalar=False, label="col")


def into(x: Any, *, name: bool = False) -> Expr:
    """An expression from a value; strings are column names where `name`."""
    if isinstance(x, Expr):
        return x
    if hasattr(x, "_as_expr"):
        return x._as_expr()
    return col(x) if name and isinstance(x, str) else lit(x)


__all__ = ["Expr", "col", "flat", "into", "lit"]
