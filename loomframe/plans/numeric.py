"""Numeric rules that Spark doesn't have: guarded division, floor rules, variance with any ddof, ranks, quantiles."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import dtypes as dt
from ..errors import InvalidOperationError
from .lower import Agg, Context, Over, ref, temp_name, window


def is_float(ctx: Context, c: Column) -> bool:
    return isinstance(ctx.dtype(c), (T.DoubleType, T.FloatType))


def cast(ctx: Context, c: Column, dtype: Any) -> Column:
    to = dt.to_spark(dtype)
    kind = ctx.dtype(c)
    if isinstance(to, T.BooleanType) and isinstance(kind, T.NumericType):
        return c != 0
    if isinstance(to, T.NumericType) and isinstance(kind, T.BooleanType):
        out = c.cast("int").cast(to)
    elif isinstance(to, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) and isinstance(kind, T.DateType):
        out = F.unix_date(c).cast(to)
    else:
        out = c.cast(to)
    limit = dt.unsigned_limit(dtype)
    if limit is not None:
        out = F.when(out.isNull() | ((out >= 0) & (out <= F.lit(limit).cast(to))), out).otherwise(F.raise_error(F.lit(f"out of the range of {dtype!r}")).cast(to))
    if isinstance(dtype, dt.Enum):
        out = F.when(out.isNull() | out.isin(list(dtype.categories)), out).otherwise(F.raise_error(F.lit("not one of the categories")).cast("string"))
    return out


def true_div(ctx: Context, n: Column, d: Column) -> Column:
    n, d = n.cast("double"), d.cast("double")
    zero = F.when(F.isnan(n) | (n == 0), F.lit(math.nan)).when(n > 0, F.lit(math.inf)).when(n < 0, F.lit(-math.inf))
    return F.when(d != 0, F.try_divide(n, d)).when(d == 0, zero)


def floor_div(ctx: Context, n: Column, d: Column) -> Column:
    """Towards minus infinity; null where the divisor is 0."""
    if is_float(ctx, n) or is_float(ctx, d):
        return F.when(d != 0, F.floor(F.try_divide(n.cast("double"), d.cast("double"))).cast("double"))
    safe = F.when(d != 0, d)
    return ((n - ((n % safe) + safe) % safe) / safe).cast("long") if _wide(ctx, n, d) else F.call_function("div", n - ((n % safe) + safe) % safe, safe)


def _wide(ctx: Context, *cols: Column) -> bool:
    return any(isinstance(ctx.dtype(c), T.DecimalType) for c in cols)


def modulo(ctx: Context, n: Column, d: Column) -> Column:
    """The remainder has the divisor's sign; null where the divisor is 0."""
    safe = F.when(d != 0, d)
    return ((n % safe) + safe) % safe


def power(ctx: Context, a: Column, b: Column) -> Column:
    """Powers of whole numbers are multiplied out, exactly; an overflow is an error, as for products."""
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    if not (isinstance(ctx.dtype(a), whole) and isinstance(ctx.dtype(b), whole)):
        return F.pow(a, b)
    a, b = a.cast("long"), b.cast("int")
    small = F.when(a == -1, F.when(b % 2 == 0, F.lit(1)).otherwise(-1)).otherwise(a)  # -1, 0 and 1 never overflow
    steps = F.sequence(F.lit(1), F.least(b, F.lit(64)))
    product = F.aggregate(steps, F.lit(1).cast("long"), lambda x, _: x * a)
    return F.when(b < 0, F.pow(a, b).cast("long")).when(b == 0, F.lit(1).cast("long")).when(F.abs(a) < 2, small.cast("long")).when(a.isNotNull() & b.isNotNull(), product)


def rescaled(pop: Column, n: Column, ddof: int) -> Column:
    """A population variance with another ddof; null where n - ddof <= 0."""
    return F.when(n > ddof, pop * n / (n - ddof))


def variance(a: Agg, ddof: int) -> Column:
    if ddof == 1:
        return a(F.var_samp(a.c))
    return a(F.var_pop(a.c)) if ddof == 0 else rescaled(a(F.var_pop(a.c)), a(F.count(a.c)), ddof)


def quantile(a: Agg, q: float, interpolation: str) -> Column:
    if not 0 <= q <= 1:
        raise ValueError("quantile must be in 0..1")
    if interpolation == "linear":
        return a(F.percentile(a.c, q))
    if interpolation not in ("lower", "higher", "nearest", "midpoint"):
        raise ValueError(f"interpolation {interpolation!r}")
    # The places of the two neighbours among the sorted values: rows are numbered, no group is gathered.
    ctx, keys, c = a.ctx, a.ctx.keys(), a.ctx.temp(a.c)
    if keys:
        place = ctx.temp(F.row_number().over(Window.partitionBy(*keys).orderBy(c.asc_nulls_last())) - 1)
        n = ctx.temp(F.count(c).over(Window.partitionBy(*keys)))
    else:
        from . import ranges

        ctx.flush()
        name = temp_name("q")
        ctx.top.df = ranges.numbered(ctx.top.df, [ranges.Key(c, nulls_last=True)], name)
        place, n = ref(name), ctx.within(mode="rows", window=None).scalar(F.count(c))
        ctx.flush()
    at = (n - 1) * F.lit(q)
    lo, hi = (a(F.max(F.when(place == f(at), c))) for f in (F.floor, F.ceil))
    if interpolation == "midpoint":
        return ((lo + hi) / 2).cast("double")
    if interpolation == "nearest":
        return a(F.max(F.when(place == F.rint(at), c))).cast("double")
    return (lo if interpolation == "lower" else hi).cast("double")


def keyed(ctx: Context, c: Column) -> Any:
    return Window.partitionBy(*(ctx.window.keys if ctx.window else ()), c)


def in_order(o: Over) -> Any:
    return Window.partitionBy(*o.keys).orderBy(*[x.asc_nulls_first() for x in o.order])


def nth_distinct(ctx: Context, c: Column, *, last: bool) -> Column:
    o = ctx.ordered("is_first_distinct")
    order = [x.desc_nulls_last() if last else x.asc_nulls_first() for x in o.order]
    return F.row_number().over(Window.partitionBy(*o.keys, c).orderBy(*order)) == 1


def rank(ctx: Context, c: Column, method: str, descending: bool) -> Column:
    keys = ctx.window.keys if ctx.window else ()
    extra = (ctx.window.order if ctx.window else ()) or ctx.order
    by = [c.desc_nulls_last() if descending else c.asc_nulls_last()]
    w = Window.partitionBy(*keys).orderBy(*by)
    if not keys:
        return _rank_of_all(ctx, c, method, descending, extra)
    if method == "ordinal":
        out = F.row_number().over(Window.partitionBy(*keys).orderBy(*by, *[x.asc_nulls_first() for x in extra]))
    elif method == "dense":
        out = F.dense_rank().over(w)
    else:
        same = F.count(F.lit(1)).over(Window.partitionBy(*keys, c))
        out = {"min": F.rank().over(w), "max": F.rank().over(w) + same - 1, "average": F.rank().over(w) + (same - 1) / 2}[method]
    return F.when(c.isNotNull(), out)


def _rank_of_all(ctx: Context, c: Column, method: str, descending: bool, extra: tuple[Column, ...]) -> Column:
    """Ranks over the whole frame, by ranges: its values are counted and joined back, or its rows numbered."""
    from . import ranges

    c, name = ctx.temp(c), temp_name("r")
    top = ctx.top
    ctx.flush()
    if method == "ordinal":
        top.df = ranges.numbered(top.df, [ranges.Key(c, descending, True), *[ranges.Key(x) for x in extra]], name)
        return F.when(c.isNotNull(), ref(name) + 1)
    found = ranges.ranks(top.df, c, descending)
    value = {"min": F.col("lo") + 1, "max": F.col("lo") + F.col("n"), "average": F.col("lo") + (F.col("n") + 1) / 2, "dense": F.col("dense") + 1}[method]
    at = temp_name("v")
    found = found.select(ref("v").alias(at), value.alias(name))
    top.df = top.df.join(found, c == ref(at), "left").drop(at)
    return ref(name)


#: A block of rows in which old weights fall by e ** WIDTH: what is older than the block before can't be told in a double.
WIDTH = 100.0


def ewm(ctx: Context, c: Column, alpha: float, adjust: bool, min_samples: int, ignore_nulls: bool) -> Column:
    """The weighted sums of all rows so far, as running sums. With l the log of how far the weights of the first row
    have fallen at a row, a row's weight at a later one is exp(l - l'); running sums of x * exp(l) overflow, so l is
    counted within blocks of WIDTH, and each block takes the sums of the one before with it."""
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be in (0, 1]")
    from . import whole

    o, part = ctx.ordered("ewm_mean"), None
    if whole.is_whole(ctx, o):  # each range as if it were all rows, then what the ranges before come to
        c = ctx.temp(c)
        part, n = whole.split(ctx, o)
        o = Over((ref(part),), o.order)
        part = None if n == 1 else part
    seen = F.count(c).over(window(o, None, 0))
    if alpha == 1:
        if part:
            seen = whole.running(ctx, c, "ewm_mean", F.count, F.sum, lambda before, own: F.coalesce(before, F.lit(0)) + own)
        return F.when(c.isNotNull() & (seen >= min_samples), c.cast("double"))
    fall, some = -math.log1p(-alpha), c.isNotNull()
    row = F.row_number().over(in_order(o)).cast("long")
    row = ctx.temp(row) if part else row
    at = ctx.temp(seen if ignore_nulls else row)
    own = F.lit(1.0)
    if adjust:
        log = at * F.lit(fall)
    else:  # a value's own weight is alpha, or all of it for the first; the weights before it fall to 1 - alpha together
        gap = at - F.last(F.when(some, at), ignorenulls=True).over(window(o, None, -1))
        gap = ctx.temp(F.when(some, gap))
        both = F.exp(-gap * fall) + alpha
        own = F.coalesce(alpha / both, F.lit(1.0))
        log = F.sum(F.coalesce(gap * fall + F.log(both), F.lit(0.0))).over(window(o, None, 0))
    log = ctx.temp(log)
    block = ctx.temp(F.floor(log / WIDTH))
    far = ctx.temp(log - block * WIDTH)
    inside = window(Over((*o.keys, block), o.order), None, 0)
    num = ctx.temp(F.coalesce(F.sum(F.when(some, own * c.cast("double") * F.exp(far))).over(inside), F.lit(0.0)))
    den = ctx.temp(F.coalesce(F.sum(F.when(some, F.exp(far))).over(inside), F.lit(0.0))) if adjust else F.lit(0.0)
    ends = ctx.temp(F.when(F.lead(block).over(in_order(o)) != block, F.struct(block.alias("b"), num.alias("num"), den.alias("den"))))
    before = ctx.temp(F.last(ends, ignorenulls=True).over(window(o, None, -1)))
    near = before["b"] == block - 1
    fell, fell_before = F.exp(-far), F.exp(-far - WIDTH)
    num = fell * num + F.when(near, fell_before * before["num"]).otherwise(0.0)
    den = fell * den + F.when(near, fell_before * before["den"]).otherwise(0.0) if adjust else F.lit(1.0)
    if part:
        seen, num, den = _ewm_ranges(ctx, c, part, ctx.temp(seen), row, at, log, ctx.temp(num), ctx.temp(den), alpha, fall, adjust)
    return F.when(some & (seen >= min_samples), num / den)


def _ewm_ranges(ctx: Context, c: Column, part: str, seen: Column, row: Column, at: Column, log: Column, num: Column, den: Column, alpha: float, fall: float, adjust: bool) -> tuple[Column, Column, Column]:
    """Counts and sums of each range's rows so far, with those of all ranges before it."""
    from . import whole

    some, x = c.isNotNull(), c.cast("double")
    struct = lambda **cols: F.struct(*[v.alias(k) for k, v in cols.items()])
    none, zero = F.lit(None).cast("double"), F.lit(0).cast("long")
    ends = {"some": F.count(c), "steps": F.max(at), "end": F.max_by(struct(num=num, den=den, log=log), row)}
    if adjust:
        fell = lambda steps: F.exp(-steps * F.lit(fall))
        step = lambda s, e: struct(seen=s["seen"] + e["some"], num=e["end"]["num"] + fell(e["steps"]) * s["num"], den=e["end"]["den"] + fell(e["steps"]) * s["den"])
        was = ref(whole.folded(ctx, part, ends, struct(seen=zero, num=F.lit(0.0), den=F.lit(0.0)), step))
        return seen + was["seen"], num + fell(at) * was["num"], den + fell(at) * was["den"]

    # The first value of a range counts for all of the mean so far there; what it comes to with the mean before it
    # differs from that, and the difference falls as the weight of the first value does.
    def change(s: Any, x: Column, at: Column) -> Column:
        weight = F.exp(-(s["rest"] + at) * F.lit(fall))
        return F.coalesce((weight * s["mean"] + alpha * x) / (weight + alpha) - x, F.lit(0.0))

    ends |= {"x": F.min_by(x, F.when(some, row)), "first": F.min(F.when(some, at)), "last": F.max(F.when(some, at))}

    def step(s: Any, e: Any) -> Column:
        mean = e["end"]["num"] + F.exp(-e["end"]["log"]) * change(s, e["x"], e["first"])
        has = e["some"] > 0
        return struct(seen=s["seen"] + e["some"], mean=F.when(has, mean).otherwise(s["mean"]), rest=F.when(has, e["steps"] - e["last"]).otherwise(s["rest"] + e["steps"]))

    start = Window.partitionBy(ref(part))
    x0, at0 = ctx.temp(F.min_by(x, F.when(some, row)).over(start)), ctx.temp(F.min(F.when(some, at)).over(start))
    was = ref(whole.folded(ctx, part, ends, struct(seen=zero, mean=none, rest=zero), step))
    return seen + was["seen"], num + F.exp(-log) * change(was, x0, at0), den


def spearman_ready(ctx: Context, c: Column) -> Column:
    return rank(ctx, c, "average", False)


def need_order(keys: Any, what: str) -> None:
    if not keys:
        raise InvalidOperationError(f"{what} needs order_by")
