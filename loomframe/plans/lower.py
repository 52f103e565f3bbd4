"""Lowering: expression trees become Spark columns on a data frame.

A `Context` holds the frame that the columns refer to. What Spark can't nest becomes a step of its own there: window
results used in windows or aggregates are added as temporary columns; aggregates used beside rows are computed in one
aggregation and joined as a single broadcast row (never by a window over one partition). An aggregate or ordered
function inside `over` finds its window in the context, and elementwise functions pass it on to their operands, so
`(a.sum() + 1).over(g)` needs no rewriting.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ColumnNotFoundError, InvalidOperationError, MultiOutputExpressionError

if TYPE_CHECKING:
    from ..expr import Expr

Named = list[tuple[str, Column]]
_ids = itertools.count()


def ref(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def temp_name(stem: str = "t") -> str:
    return f"__loom_{stem}{next(_ids)}"


@dataclass
class Over:
    """A window: keys, ordering columns (nulls first, ascending)."""

    keys: tuple[Column, ...] = ()
    order: tuple[Column, ...] = ()


@dataclass
class Context:
    df: DataFrame
    mode: str = "rows"  # rows | agg
    window: Over | None = None
    order: tuple[Column, ...] = ()  # the row order of an eager frame
    hidden: tuple[str, ...] = ()  # columns that expressions don't see
    skip: tuple[str, ...] = ()  # group keys: not part of all()
    groups: tuple[Column, ...] = ()  # the group keys' columns
    pending: dict[str, Column] = field(default_factory=dict)
    orders: dict[Any, Any] = field(default_factory=dict)  # columns with ranges and numbers of orders, see plans.whole
    boss: Context | None = None

    # --- the frame ---
    @property
    def top(self) -> Context:
        return self.boss.top if self.boss else self

    def names(self) -> list[str]:
        return [c for c in self.top.df.columns if c not in self.hidden and c not in self.skip and not c.startswith("__loom_")]

    def within(self, **change: Any) -> Context:
        base = {"mode": self.mode, "window": self.window, "order": self.order, "hidden": self.hidden, "skip": self.skip, "groups": self.groups} | change
        return Context(self.top.df, boss=self.top, **base)

    def flush(self) -> None:
        """Join the aggregates that are asked for beside rows, as one row."""
        top = self.top
        if top.pending:
            one = top.df.agg(*[c.alias(n) for n, c in top.pending.items()])
            top.pending = {}
            top.df = top.df.crossJoin(F.broadcast(one))  # a global aggregate has exactly one row

    def scalar(self, agg: Column) -> Column:
        name = temp_name("s")
        self.top.pending[name] = agg
        return ref(name)

    def temp(self, col: Column) -> Column:
        if any(name in str(col) for name in self.top.pending):
            self.flush()
        name = temp_name()
        self.top.df = self.top.df.withColumn(name, col)
        return ref(name)

    def dtype(self, col: Column) -> T.DataType:
        """The type of a column; aggregates that aren't joined yet are nulls of their types for that."""
        top = self.top
        df = top.df
        if used := {n: c for n, c in top.pending.items() if n in str(col)}:
            kinds = df.agg(*[c.alias(n) for n, c in used.items()]).schema
            df = df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in kinds})
        return df.select(col.alias("x")).schema[0].dataType

    def keys(self) -> tuple[Column, ...]:
        """What the rows of an aggregate have in common."""
        return self.window.keys if self.window is not None else self.groups if self.mode == "agg" else ()

    # --- windows ---
    def agg(self) -> Callable[[Column], Column]:
        """What to do with an aggregate function here."""
        if self.window is not None:
            keys = self.window.keys
            return (lambda a: a.over(Window.partitionBy(*keys))) if keys else self.scalar
        if self.mode == "agg":
            return lambda a: a
        return self.scalar

    def ordered(self, what: str) -> Over:
        if self.window is not None and (self.window.order or self.order):
            return Over(self.window.keys, self.window.order or self.order)
        if self.window is None and self.order:
            return Over((), self.order)
        raise InvalidOperationError(f"{what} depends on the order of rows: use .over(..., order_by=...)")


def window(over: Over, lo: int | None = None, hi: int | None = None, *, reverse: bool = False) -> Any:
    order = [c.desc_nulls_last() if reverse else c.asc_nulls_first() for c in over.order]
    w = Window.partitionBy(*over.keys).orderBy(*order)
    return w.rowsBetween(Window.unboundedPreceding if lo is None else lo, Window.unboundedFollowing if hi is None else hi)


def has_window(expr: Expr) -> bool:
    """Would the column hold a window function (or a temporary aggregate) that can't be nested?"""
    return expr.kind in ("win", "over", "agg") or any(has_window(a) for a in expr.args)


def one(named: Named) -> Column:
    if len(named) != 1:
        raise MultiOutputExpressionError("an expression with one output column is needed here")
    return named[0][1]


def lower(expr: Expr, ctx: Context) -> Named:
    """Columns of an expression, with their names."""
    kind = expr.kind
    if kind == "root":
        return expr.fn(ctx)
    if kind == "elem":
        first = lower(expr.args[0], ctx)
        rest = [lower(a, ctx) for a in expr.args[1:]]
        width = max(len(x) for x in [first, *rest])
        if any(len(x) not in (1, width) for x in [first, *rest]):
            raise MultiOutputExpressionError("expressions with different numbers of output columns")
        at = lambda x, i: x[i if len(x) > 1 else 0]
        return [(at(first, i)[0], expr.fn(ctx, at(first, i)[1], *(at(x, i)[1] for x in rest))) for i in range(width)]
    if kind == "hori":  # any number of outputs together make one
        cols = [c for a in expr.args for c in lower(a, ctx)]
        return [(expr.out_name or cols[0][0], expr.fn(ctx, *(c for _, c in cols)))]
    if kind == "name":
        inner = lower(expr.args[0], ctx)
        return [(expr.fn(root, name), c) for (name, c), root in zip(inner, roots(expr.args[0], ctx, inner), strict=True)]
    if kind == "filt":
        raise InvalidOperationError(f"{expr.label} changes the number of rows; an aggregate has to follow (or use an eager series)")
    if kind == "over":
        keys, order = expr.extra
        inner_ctx = ctx.within(window=None, mode="rows")
        # Keys and ordering are expressions or names; they are seen as rows.
        cols = [tuple(c for k in part for _, c in lower(k, inner_ctx)) for part in (keys, order)]
        return lower(expr.args[0], ctx.within(window=Over(*cols), mode="rows"))
    if kind == "agg":
        base, mask, only = peel(expr.args[0], ctx)
        others = [lower_arg(a, ctx) for a in expr.args[1:]]
        out = []
        for name, c in base:
            got = c if mask is None else F.when(mask, c)
            spec = Agg(ctx, got, mask, only, [one(o) for o in others])
            out.append((name, expr.fn(spec)))
        return out
    if kind == "win":
        inner = lower_arg(expr.args[0], ctx)
        others = [one(lower_arg(a, ctx)) for a in expr.args[1:]]
        return [(name, expr.fn(ctx, c, *others)) for name, c in inner]
    raise AssertionError(kind)


def lower_arg(expr: Expr, ctx: Context) -> Named:
    """An operand of an aggregate or a window function: per row, without window functions inside."""
    if expr.scalar and expr.kind == "agg":
        raise InvalidOperationError("an aggregate of an aggregate")
    nested = has_window(expr)
    inner = lower(expr, ctx.within(mode="rows", window=ctx.window if nested else None))
    return [(n, ctx.temp(c)) for n, c in inner] if nested else inner


def peel(expr: Expr, ctx: Context) -> tuple[Named, Column | None, str]:
    """The operand of an aggregate without filters before it: columns, row condition, and which of the values count:
    all (""), each once ("unique") or each of the most frequent once ("mode")."""
    mask, only = None, ""
    conditions = []
    while expr.kind == "filt":
        conditions.append(expr)
        expr = expr.args[0]
    base = lower_arg(expr, ctx)
    for f in reversed(conditions):
        if f.label in ("unique", "mode"):
            if f.label == "mode" and only:
                raise InvalidOperationError("mode of unique values")
            only = only or f.label
            continue
        if only and f.label == "filter":
            raise InvalidOperationError(f"filter after {only}: put it before")
        more = f.fn(ctx, one(base), *(one(lower_arg(a, ctx)) for a in f.args[1:]))
        mask = more if mask is None else mask & more
    return base, mask, only


@dataclass
class Agg:
    """What an aggregate function gets: its column (null where masked), the condition, and how to place results."""

    ctx: Context
    raw: Column
    mask: Column | None
    only: str
    others: list[Column]

    def __call__(self, a: Column) -> Column:
        return self.ctx.agg()(a)

    @property
    def windowed(self) -> bool:
        return self.ctx.window is not None and bool(self.ctx.window.keys)

    @property
    def distinct(self) -> bool:
        """May the aggregate's own DISTINCT be used? Windows don't know it."""
        return self.only == "unique" and not self.windowed

    @property
    def c(self) -> Column:
        """The values that count, nulls elsewhere: one row of each value is marked where each counts once."""
        if self.only:
            ctx, keys = self.ctx, self.ctx.keys()
            alike = [*keys, self.raw, *([] if self.mask is None else [self.mask])]
            counts = F.row_number().over(Window.partitionBy(*alike).orderBy(F.lit(1))) == 1
            counts = counts if self.mask is None else counts & self.mask
            if self.only == "mode":  # nulls are no mode
                often = ctx.temp(F.when(self.raw.isNotNull(), F.count(F.lit(1)).over(Window.partitionBy(*alike))))
                most = ctx.temp(F.max(often).over(Window.partitionBy(*keys))) if keys else ctx.within(mode="rows", window=None).scalar(F.max(often))
                counts = counts & F.coalesce(often == most, F.lit(False))
                ctx.flush()
            flag = ctx.temp(counts)
            self.raw, self.mask, self.only = F.when(flag, self.raw), flag, ""
        return self.raw

    def rows(self) -> Column:
        return F.count(F.lit(1) if self.mask is None else F.when(self.mask, F.lit(1)))

    def n_unique(self) -> Column:
        if self.only == "mode" or self.windowed:
            self.only = self.only or "unique"
            c = self.c  # sets the condition
            return (self(F.count(c)) + F.coalesce(self(F.max((self.mask & c.isNull()).cast("int"))), F.lit(0))).cast("long")
        c = self.raw
        null = F.max((c.isNull() if self.mask is None else (self.mask & c.isNull())).cast("int"))
        return (self(F.count_distinct(c)) + F.coalesce(self(null), F.lit(0))).cast("long")


def roots(expr: Expr, ctx: Context, inner: Named) -> list[str]:
    """The names of the columns that an expression starts from."""
    while expr.args and expr.kind not in ("root",):
        expr = expr.args[0]
    found = [n for n, _ in lower(expr, ctx)]
    return found if len(found) == len(inner) else [n for n, _ in inner]


def column(name: str, ctx: Context) -> tuple[str, Column]:
    if name not in ctx.top.df.columns:
        raise ColumnNotFoundError(f"{name!r}; there are {ctx.names()}")
    return name, ref(name)
