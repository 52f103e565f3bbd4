"""Ordered windows over a whole frame (without keys, or with constant ones) that no single task sorts: running values
are made in ranges of the order and a row per range carries them on; values of near rows are made in blocks of numbered
rows, each with copies of its neighbours' nearest rows."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from . import ranges
from .lower import Context, Over, ref, temp_name, window

#: Rows of a block; wider windows have blocks of their width.
BLOCK = 1_000_000


def is_whole(ctx: Context, o: Over) -> bool:
    top = ctx.top
    if top.df.isStreaming or not o.order:
        return False
    if not o.keys:
        return True
    if any(name in str(k) for k in o.keys for name in top.pending):
        return False
    plan = top.df.select(*[k.alias(f"k{i}") for i, k in enumerate(o.keys)])._jdf.queryExecution().optimizedPlan()
    if plan.nodeName() != "Project":
        return False
    exprs = plan.expressions()
    exprs = [exprs.apply(i) for i in range(exprs.size())]
    return all(e.nodeName() == "Alias" and e.child().foldable() for e in exprs)


def split(ctx: Context, o: Over) -> tuple[str, int | None]:
    """The column with the ranges of an order, made once for the frame, and how many there are (if known)."""
    ctx.flush()
    at = ("part", str(o.order))
    if at not in ctx.top.orders:
        name = temp_name("p")
        ctx.top.df, n = ranges.parts(ctx.top.df, [ranges.Key(x) for x in o.order], name)
        ctx.top.orders[at] = name, n
    return ctx.top.orders[at]


def running(ctx: Context, c: Column, what: str, f: Callable[[Column], Column], again: Callable[[Column], Column], both: Callable[[Column, Column], Column], *, reverse: bool = False, total: Callable[[Column, Over], Column] | None = None) -> Column:
    """f over all rows so far. A range comes to f of it (or `total`), many to `again` of them; `both` takes what the
    ranges before come to, and f of the rows so far in the row's own."""
    o = ctx.ordered(what)
    if not is_whole(ctx, o):
        return f(c).over(window(o, None, 0, reverse=reverse))
    c = ctx.temp(c)
    part, n = split(ctx, o)
    own = f(c).over(window(Over((ref(part),), o.order), None, 0, reverse=reverse))
    if n == 1:
        return own
    before = temp_name("e")
    ctx.top.df = ranges.carried(ctx.top.df, part, {before: total(c, o) if total else f(c)}, {before: again}, reverse=reverse)
    return both(ref(before), own)


def filled(ctx: Context, c: Column, *, forward: bool) -> Column:
    """The last value so far that isn't null; the next one, if not forward."""

    def end(c: Column, o: Over) -> Column:
        key = F.struct(*[x for k in o.order for x in (k.isNotNull(), k)])
        return (F.max_by if forward else F.min_by)(c, F.when(c.isNotNull(), key))

    last = lambda x: F.last(x, ignorenulls=True)
    return running(ctx, c, "fill_null", last, last, lambda before, own: F.coalesce(own, before), reverse=not forward, total=end)


def near(ctx: Context, c: Column, what: str, make: Callable[[Column, Over], Column], before: int, after: int) -> Column:
    """A window that reaches no further than `before` rows back and `after` rows ahead."""
    o = ctx.ordered(what)
    if not is_whole(ctx, o):
        return make(c, o)
    c = ctx.temp(c)
    ctx.flush()
    top, key = ctx.top, ("at", str(o.order))
    if key not in top.orders:
        name = temp_name("n")
        top.df = ranges.numbered(top.df, [ranges.Key(x) for x in o.order], name)
        top.orders[key] = name, None
    at, size = ref(top.orders[key][0]), max(BLOCK, before, after)
    block, name = temp_name("b"), temp_name()
    mine = F.call_function("div", at, F.lit(size))
    seen = [mine] + [F.when(at % size >= size - before, mine + 1)] * (before > 0) + [F.when(at % size < after, mine - 1)] * (after > 0)
    df = top.df.withColumn(block, F.explode(F.array_compact(F.array(*seen))))
    top.df = df.withColumn(name, make(c, Over((ref(block),), (at,)))).where(ref(block) == mine).drop(block)
    return ref(name)


def folded(ctx: Context, part: str, own: dict[str, Column], first: Column, step: Callable[[Any, Any], Column]) -> str:
    """Add what `step` makes of the aggregates of all ranges before a row's own, one after the other."""
    name = temp_name("e")
    w = Window.orderBy(ref(part)).rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    ends = ctx.top.df.groupBy(ref(part)).agg(F.struct(*[c.alias(k) for k, c in own.items()]).alias("x"))
    ends = ends.select(ref(part), F.aggregate(F.collect_list("x").over(w), first, step).alias(name))
    ctx.top.df = ctx.top.df.join(F.broadcast(ends), part)
    return name
