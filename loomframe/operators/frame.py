"""Lazy frames: a Spark DataFrame with the expression language."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from typing import Any

from pyspark.sql import Column, Window
from pyspark.sql import DataFrame as SparkFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import dtypes as dt
from ..errors import ColumnNotFoundError, DuplicateError, InvalidOperationError
from ..expr import Expr, col, flat, into
from ..plans import ranges
from ..plans.lower import Context, Named, has_window, lower, ref, temp_name
from ..plans.ranges import ROW

_HOWS = ("inner", "left", "full", "cross", "semi", "anti")


def _unique_names(named: Named) -> Named:
    seen: set[str] = set()
    for n, _ in named:
        if n in seen:
            raise DuplicateError(f"two output columns are named {n!r}")
        seen.add(n)
    return named


class LazyFrame:
    """Rows have no order here; `DataFrame` keeps one in a hidden column."""

    def __init__(self, native: SparkFrame):
        self._df = native

    # --- helpers ---
    def _new(self, df: SparkFrame) -> Any:
        return type(self)(df)

    @property
    def _has_row(self) -> bool:
        return ROW in self._df.columns

    def _context(self, **k: Any) -> Context:
        return Context(self._df, order=(ref(ROW),) if self._has_row else (), **k)

    def _exprs(self, exprs: Iterable[Any], named: Mapping[str, Any]) -> list[Expr]:
        return [into(e, name=True) for e in flat(list(exprs))] + [into(e, name=True).alias(k) for k, e in named.items()]

    def _hidden(self) -> list[Column]:
        return [ref(ROW)] if self._has_row else []

    # --- schema ---
    @property
    def columns(self) -> list[str]:
        return [c for c in self._df.columns if c != ROW]

    @property
    def schema(self) -> dt.Schema:
        return dt.Schema({k: v for k, v in dt.Schema.from_spark(self._df.schema).items() if k != ROW})

    def collect_schema(self) -> dt.Schema:
        return self.schema

    @property
    def implementation(self) -> str:
        return "pyspark"

    def to_native(self) -> SparkFrame:
        return self._df.drop(ROW)

    def lazy(self) -> LazyFrame:
        return LazyFrame(self.to_native())

    def pipe(self, function: Callable[..., Any], *args: Any, **kwargs: Any) -> Any:
        return function(self, *args, **kwargs)

    def explain(self, mode: str = "formatted") -> None:
        self.to_native().explain(mode)

    # --- projections ---
    def select(self, *exprs: Any, **named_exprs: Any) -> Any:
        items = self._exprs(exprs, named_exprs)
        if items and all(e.scalar for e in items):
            ctx = self._context(mode="agg")
            named = _unique_names([x for e in items for x in lower(e, ctx)])
            out = ctx.df.agg(*[c.alias(n) for n, c in named])
            return self._new(out.withColumn(ROW, F.lit(0)) if self._has_row else out)
        ctx = self._context()
        named = _unique_names([x for e in items for x in lower(e, ctx)])
        ctx.flush()
        return self._new(ctx.df.select(*[c.alias(n) for n, c in named], *self._hidden()))

    def with_columns(self, *exprs: Any, **named_exprs: Any) -> Any:
        ctx = self._context()
        named = dict(_unique_names([x for e in self._exprs(exprs, named_exprs) for x in lower(e, ctx)]))
        ctx.flush()
        kept = [(named.pop(c) if c in named else ref(c)).alias(c) for c in self.columns]
        return self._new(ctx.df.select(*kept, *[c.alias(n) for n, c in named.items()], *self._hidden()))

    def filter(self, *predicates: Any, **constraints: Any) -> Any:
        items = [into(p, name=True) for p in flat(list(predicates))] + [col(k) == v for k, v in constraints.items()]
        ctx = self._context()
        test = F.lit(True)
        for e in items:
            for _, c in lower(e, ctx):
                test = test & (ctx.temp(c) if has_window(e) else c)
        ctx.flush()
        out = ctx.df.where(test)
        return self._new(out if ctx.df is self._df else out.select(*[ref(c) for c in self._df.columns]))

    def rename(self, mapping: Mapping[str, str]) -> Any:
        if missing := set(mapping) - set(self.columns):
            raise ColumnNotFoundError(str(sorted(missing)))
        _unique_names([(mapping.get(c, c), None) for c in self.columns])
        return self._new(self._df.select(*[ref(c).alias(mapping.get(c, c)) for c in self._df.columns]))

    def drop(self, *columns: Any, strict: bool = True) -> Any:
        gone = flat(list(columns))
        if strict and (missing := set(gone) - set(self.columns)):
            raise ColumnNotFoundError(str(sorted(missing)))
        return self._new(self._df.select(*[ref(c) for c in self._df.columns if c not in gone]))

    # --- rows ---
    def head(self, n: int = 5) -> Any:
        return self._new((self._df.orderBy(ROW) if self._has_row else self._df).limit(n))

    def sort(self, by: Any, *more_by: Any, descending: bool | list[bool] = False, nulls_last: bool = False) -> Any:
        keys = flat([by, *more_by])
        flags = descending if isinstance(descending, list) else [descending] * len(keys)
        ctx = self._context()
        cols = [c for k in keys for _, c in lower(into(k, name=True), ctx)]
        ctx.flush()
        order = [ranges.Key(c, d, nulls_last) for c, d in zip(cols, flags, strict=True)]
        if not self._has_row:
            return self._new(ctx.df.orderBy(*[k.sorting() for k in order]).select(*[ref(c) for c in self.columns]))
        out = ranges.placed(ctx.df, order, ranges.Key(ref(ROW)))
        return self._new(out.select(*[ref(c) for c in self._df.columns]))

    def top_k(self, k: int, *, by: Any, reverse: bool | list[bool] = False) -> Any:
        keys = flat(by)
        flags = reverse if isinstance(reverse, list) else [reverse] * len(keys)
        order = [(ref(c).asc_nulls_last() if r else ref(c).desc_nulls_last()) for c, r in zip(keys, flags, strict=True)]
        return self._new(self._df.orderBy(*order).limit(k))

    def drop_nulls(self, subset: Any = None) -> Any:
        return self.filter(*[~col(c).is_null() for c in (self.columns if subset is None else flat(subset))])

    def unique(self, subset: Any = None, *, keep: str = "any", order_by: Any = None, maintain_order: bool = False) -> Any:
        cols = self.columns if subset is None else flat(subset)
        if missing := set(cols) - set(self.columns):
            raise ColumnNotFoundError(str(sorted(missing)))
        keys = [ref(c) for c in cols]
        if keep == "any":
            return self._new(self._df.dropDuplicates(cols))
        if keep not in ("none", "first", "last"):
            raise ValueError(f"keep {keep!r}")
        mark = temp_name()
        if keep == "none":
            out = self._df.withColumn(mark, F.count(F.lit(1)).over(Window.partitionBy(*keys)))
        else:
            order = [ref(c) for c in flat([] if order_by is None else order_by)] or self._hidden()
            if not order:
                raise InvalidOperationError("keep='first' and 'last' need order_by")
            by = [c.asc_nulls_first() if keep == "first" else c.desc_nulls_last() for c in order]
            out = self._df.withColumn(mark, F.row_number().over(Window.partitionBy(*keys).orderBy(*by)))
        return self._new(out.where(ref(mark) == 1).drop(mark))

    def with_row_index(self, name: str = "index", *, order_by: Any = None) -> Any:
        """0-based numbers in the order given, made in ranges of the keys (`plans.ranges`); no single task sorts all rows."""
        order = [ref(c) for c in flat([] if order_by is None else order_by)] or self._hidden()
        if not order:
            raise InvalidOperationError("with_row_index needs order_by")
        return self._new(numbered(self._df, order, name).select(ref(name), *[ref(c) for c in self._df.columns]))

    def tail(self, n: int = 5) -> Any:
        if not self._has_row:
            raise InvalidOperationError("a lazy frame has no last rows")
        return self._new(self._df.orderBy(ref(ROW).desc()).limit(n))

    def gather_every(self, n: int, offset: int = 0) -> Any:
        if not self._has_row:
            raise InvalidOperationError("a lazy frame has no order")
        at = temp_name()
        out = numbered(self._df, [ref(ROW)], at)
        return self._new(out.where((ref(at) >= offset) & ((ref(at) - offset) % n == 0)).drop(at))

    # --- groups ---
    def group_by(self, *keys: Any, drop_null_keys: bool = False) -> GroupBy:
        return GroupBy(self, flat(list(keys)), drop_null_keys)

    # --- joins ---
    def join(self, other: LazyFrame, on: Any = None, how: str = "inner", *, left_on: Any = None, right_on: Any = None, suffix: str = "_right") -> Any:
        if how not in _HOWS:
            raise ValueError(f"how {how!r}; one of {_HOWS}")
        if how == "cross":
            if on is not None or left_on is not None or right_on is not None:
                raise ValueError("a cross join has no keys")
            lk, rk = [], []
        else:
            if (on is None) == (left_on is None or right_on is None):
                raise ValueError("give on, or left_on and right_on")
            lk, rk = (flat(on), flat(on)) if on is not None else (flat(left_on), flat(right_on))
            if len(lk) != len(rk):
                raise ValueError("left_on and right_on differ in length")
        for names, frame in ((lk, self), (rk, other)):
            if missing := set(names) - set(frame.columns):
                raise ColumnNotFoundError(str(sorted(missing)))
        # Keys and the right side's columns get names that can't clash; Spark's == leaves null keys without a match.
        right = {c: temp_name("r") for c in other.columns}
        rdf = other.to_native().select(*[ref(c).alias(t) for c, t in right.items()])
        test: Any = None
        for a, b in zip(lk, rk, strict=True):
            one = ref(a) == ref(right[b])
            test = one if test is None else test & one
        if how in ("semi", "anti"):
            return self._new(self._df.join(rdf, test, "left_semi" if how == "semi" else "left_anti"))
        if how == "cross":
            out = self._df.crossJoin(rdf)
        else:
            out = self._df.join(rdf, test, how)
        kept = [c for c in other.columns if how == "full" or c not in rk]
        mine = set(self.columns)
        named: Named = [(c, ref(c)) for c in self.columns] + [(c + suffix if c in mine else c, ref(right[c])) for c in kept]
        return self._new(out.select(*[c.alias(n) for n, c in _unique_names(named)], *self._hidden()))

    def join_asof(self, other: LazyFrame, *, left_on: Any = None, right_on: Any = None, on: Any = None, by_left: Any = None, by_right: Any = None, by: Any = None, strategy: str = "backward", suffix: str = "_right") -> Any:
        """The nearest right row by key. Both sides are sorted together within `by` (one shuffle), and a running window
        carries the last right row to the left rows; among right rows with equal keys the largest row is taken."""
        if strategy not in ("backward", "forward", "nearest"):
            raise ValueError(f"strategy {strategy!r}")
        if (on is None) == (left_on is None or right_on is None):
            raise ValueError("give on, or left_on and right_on")
        lo, ro = (on, on) if on is not None else (left_on, right_on)
        lb, rb = (flat(by), flat(by)) if by is not None else (flat([] if by_left is None else by_left), flat([] if by_right is None else by_right))
        if len(lb) != len(rb):
            raise ValueError("by_left and by_right differ in length")
        keys = [temp_name("b") for _ in lb]
        at, side, left, right = (temp_name(x) for x in ("k", "side", "l", "r"))
        rest = [c for c in other.columns if c not in rb and (on is None or c != ro)]
        ldf, rdf = self._df, other.to_native().where(ref(ro).isNotNull())
        for b in rb:
            rdf = rdf.where(ref(b).isNotNull())
        ltype, rtype = T.StructType([ldf.schema[c] for c in ldf.columns]), None
        inner = F.struct(ref(ro).alias("k"), F.struct(*[ref(c) for c in rest] or [F.lit(1).alias("_")]).alias("v"))
        rtype = rdf.select(inner.alias("x")).schema[0].dataType
        lrows = ldf.select(*[ref(b).alias(k) for b, k in zip(lb, keys, strict=True)], ref(lo).alias(at), F.lit(1).alias(side), F.struct(*[ref(c) for c in ldf.columns]).alias(left), F.lit(None).cast(rtype).alias(right))
        rrows = rdf.select(*[ref(b).alias(k) for b, k in zip(rb, keys, strict=True)], ref(ro).alias(at), F.lit(0).alias(side), F.lit(None).cast(ltype).alias(left), inner.alias(right))
        both = lrows.unionByName(rrows)
        if not keys:  # ranges of the key take the place of `by`, and hand their last right rows on
            part = temp_name("p")
            both, n = ranges.ranged(both, [ranges.Key(ref(at))], part)
            keys = [part]
        order = lambda up: Window.partitionBy(*keys).orderBy(ref(at).asc_nulls_first() if up else ref(at).desc_nulls_last(), ref(side), ref(right)).rowsBetween(Window.unboundedPreceding, 0)

        def carried(df: SparkFrame, up: bool, name: str) -> SparkFrame:
            """The last right row in the direction, at each row."""
            own = F.last(ref(right), ignorenulls=True).over(order(up))
            if lb or n == 1:
                return df.withColumn(name, own)
            # Of the rows with the last key the largest, as in the windows.
            ends = df.where(ref(side) == 0).groupBy(ref(part), ref(at)).agg(F.max(ref(right)).alias("e"))
            ends = ends.groupBy(ref(part)).agg((F.max_by if up else F.min_by)("e", ref(at)).alias("e"))
            ends = df.select(ref(part)).distinct().join(ends, part, "left")  # a row per range
            over = Window.orderBy(ref(part).asc() if up else ref(part).desc()).rowsBetween(Window.unboundedPreceding, -1)
            ends = ends.select(ref(part), F.last("e", ignorenulls=True).over(over).alias("e"))
            out = df.withColumn(name, own).join(F.broadcast(ends), part)
            return out.withColumn(name, F.coalesce(ref(name), ref("e"))).drop("e")

        if strategy == "nearest":
            both = carried(carried(both, True, "__loom_back"), False, "__loom_forth")
            b, f = ref("__loom_back"), ref("__loom_forth")
            hit = F.when(b.isNull(), f).when(f.isNull(), b).when(ref(at) - b["k"] <= f["k"] - ref(at), b).otherwise(f)
            both = both.withColumn("__loom_hit", hit)
        else:
            both = carried(both, strategy == "backward", "__loom_hit")
        both = both.where(ref(side) == 1)
        got = F.when(ref(at).isNotNull(), ref("__loom_hit"))
        mine = set(self.columns)
        named = [(c, ref(left)[c]) for c in self.columns] + [(c + suffix if c in mine else c, got["v"][c]) for c in rest]
        hidden = [ref(left)[ROW].alias(ROW)] if self._has_row else []
        return self._new(both.select(*[c.alias(n) for n, c in _unique_names(named)], *hidden))

    # --- shapes ---
    def unpivot(self, on: Any = None, *, index: Any = None, variable_name: str = "variable", value_name: str = "value") -> Any:
        ids = flat([] if index is None else index)
        values = [c for c in self.columns if c not in ids] if on is None else flat(on)
        out = self.to_native().unpivot([ref(c) for c in ids], [ref(c) for c in values], variable_name, value_name)
        return self._new(out.withColumn(ROW, F.monotonically_increasing_id()) if self._has_row else out)

    def explode(self, columns: Any, *more_columns: Any) -> Any:
        """One row per element; an empty or null list gives a null row; several columns need equal lengths."""
        cols = flat([columns, *more_columns])
        for c in cols:
            if not isinstance(self._df.schema[c].dataType, T.ArrayType):
                raise InvalidOperationError(f"{c!r} is no list")
        if len(cols) == 1:
            out = self._df.select(*[F.explode_outer(ref(c)).alias(c) if c == cols[0] else ref(c) for c in self._df.columns])
            return self._new(out)
        sizes = [F.coalesce(F.array_size(ref(c)), F.lit(0)) for c in cols]
        same = F.lit(True)
        for s in sizes[1:]:
            same = same & (s == sizes[0])
        # Null and empty lists count as equally long.
        full = [F.when(same, F.coalesce(ref(c), F.array())).otherwise(F.raise_error(F.lit("exploded columns differ in length")).cast(self._df.schema[c].dataType)) for c in cols]
        zipped, item = temp_name(), temp_name()
        out = self._df.withColumn(zipped, F.arrays_zip(*[f.alias(f"c{k}") for k, f in enumerate(full)])).withColumn(item, F.explode_outer(ref(zipped)))
        fields = out.schema[item].dataType.names
        at = dict(zip(cols, fields, strict=True))
        return self._new(out.select(*[ref(item)[at[c]].alias(c) if c in at else ref(c) for c in self._df.columns]))

    # --- results ---
    def collect(self, backend: str | None = None, **kwargs: Any) -> Any:
        """An eager frame. backend: 'pyarrow' or 'pandas' gives such a table."""
        if backend in ("pyarrow", "arrow"):
            return self.to_native().toArrow()
        if backend == "pandas":
            return self.to_native().toPandas()
        from .eager import DataFrame

        df = self.to_native()
        return DataFrame(df.withColumn(ROW, F.monotonically_increasing_id()))

    def sink_parquet(self, file: str) -> None:
        self.to_native().write.mode("overwrite").parquet(str(file))


def numbered(df: SparkFrame, order: list[Column], name: str) -> SparkFrame:
    """0-based row numbers in `order` (nulls first)."""
    return ranges.numbered(df, [ranges.Key(c) for c in order], name)


class GroupBy:
    def __init__(self, frame: LazyFrame, keys: list[Any], drop_null_keys: bool):
        if drop_null_keys and any(isinstance(k, Expr) for k in keys):
            raise InvalidOperationError("drop_null_keys doesn't go with expression keys")
        self.frame, self.keys, self.drop_null_keys = frame, keys, drop_null_keys

    def _keyed(self) -> tuple[Context, list[tuple[str, str]]]:
        """The frame with its keys as temporary columns, and (name, temporary name) of each."""
        ctx = self.frame._context()
        named = _unique_names([x for k in self.keys for x in lower(into(k, name=True), ctx)])
        ctx.flush()
        temps = [(n, temp_name("g")) for n, _ in named]
        df = ctx.df.withColumns({t: c for (_, c), (_, t) in zip(named, temps, strict=True)})
        if self.drop_null_keys:
            for _, t in temps:
                df = df.where(ref(t).isNotNull())
        ctx = Context(df, mode="agg", order=ctx.order, skip=tuple(n for n, _ in temps), groups=tuple(ref(t) for _, t in temps))
        return ctx, temps

    def agg(self, *aggs: Any, **named_aggs: Any) -> Any:
        ctx, keys = self._keyed()
        items = self.frame._exprs(aggs, named_aggs)
        if any(not e.scalar for e in items):
            raise InvalidOperationError("group_by takes aggregates")
        named = _unique_names([(n, None) for n, _ in keys] + [x for e in items for x in lower(e, ctx)])[len(keys) :]
        names = [ref(t).alias(n) for n, t in keys]
        if not named:
            out = ctx.df.select(*names).distinct()
        else:
            tmp = [(n, temp_name("a")) for n, _ in named]
            out = ctx.df.groupBy(*[ref(t) for _, t in keys]).agg(*[c.alias(t) for (_, c), (_, t) in zip(named, tmp, strict=True)])
            out = out.select(*names, *[ref(t).alias(n) for n, t in tmp])
        return self.frame._new(out.withColumn(ROW, F.monotonically_increasing_id()) if self.frame._has_row else out)

    def __iter__(self) -> Any:
        """(key, frame) per group; keys are read to the driver one by one."""
        ctx, keys = self._keyed()
        for row in ctx.df.select(*[ref(t) for _, t in keys]).distinct().toLocalIterator():
            test = F.lit(True)
            for (_, t), v in zip(keys, row, strict=True):
                test = test & ref(t).eqNullSafe(F.lit(v))
            yield tuple(row), self.frame._new(ctx.df.where(test).select(*[ref(c) for c in self.frame._df.columns]))


def concat(items: Iterable[LazyFrame], *, how: str = "vertical") -> Any:
    frames = list(items)
    if not frames:
        raise ValueError("nothing to concatenate")
    first = frames[0]
    if how == "horizontal":
        return _horizontal(frames)
    dfs = [f.to_native() for f in frames]
    if how == "vertical":
        if any(f.columns != first.columns for f in frames):
            raise InvalidOperationError("vertical concatenation needs the same columns in the same order")
    elif how != "diagonal":
        raise ValueError(f"how {how!r}")
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=how == "diagonal")
    return first._new(out.withColumn(ROW, F.monotonically_increasing_id()) if first._has_row else out)


def _horizontal(frames: list[Any]) -> Any:
    """Side by side, by row number; a shorter frame's rows are filled with nulls."""
    if any(not f._has_row for f in frames):
        raise InvalidOperationError("horizontal concatenation needs eager frames")
    _unique_names([(c, None) for f in frames for c in f.columns])
    at = temp_name()
    out = None
    for f in frames:
        one = numbered(f._df, [ref(ROW)], at).drop(ROW)
        out = one if out is None else out.join(one, at, "full")
    return frames[0]._new(out.withColumnRenamed(at, ROW))


__all__ = ["GroupBy", "LazyFrame", "ROW", "concat", "numbered"]
