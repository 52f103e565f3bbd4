"""Functions that make expressions."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidOperationError
from ..expr import Expr, col, flat, into, lit
from ..plans.lower import Agg, Context, column, ref
from ..plans import numeric as N

__all__ = ["all_", "all_horizontal", "any_horizontal", "coalesce", "col", "concat_str", "corr", "cov", "exclude", "format", "len_", "list_", "lit", "max", "max_horizontal", "mean", "mean_horizontal", "median", "min", "min_horizontal", "nth", "struct", "sum", "sum_horizontal", "when"]


def all_() -> Expr:
    return Expr("root", lambda ctx: [(n, ref(n)) for n in ctx.names()], scalar=False, label="all")


def exclude(*names: Any) -> Expr:
    gone = set(flat(names))
    return Expr("root", lambda ctx: [(n, ref(n)) for n in ctx.names() if n not in gone], scalar=False, label="exclude")


def nth(*indices: Any) -> Expr:
    wanted = flat(indices)
    return Expr("root", lambda ctx: [column(ctx.names()[i], ctx) for i in wanted], scalar=False, label="nth")


def len_() -> Expr:
    return Expr("agg", lambda a: a(a.rows()), (lit(1).alias("len"),))


def sum(*columns: Any) -> Expr:
    return col(*columns).sum()


def mean(*columns: Any) -> Expr:
    return col(*columns).mean()


def median(*columns: Any) -> Expr:
    return col(*columns).median()


def min(*columns: Any) -> Expr:
    return col(*columns).min()


def max(*columns: Any) -> Expr:
    return col(*columns).max()


def _names(items: Any) -> list[Expr]:
    return [into(x, name=True) for x in flat(list(items))]


def corr(a: Any, b: Any, *, method: str = "pearson") -> Expr:
    """Pearson correlation, or Spearman's (of average ranks)."""
    a, b = _names((a, b))
    if method == "spearman":
        both = ~(a.is_null() | b.is_null())
        a, b = (Expr("win", lambda ctx, c, ok: N.spearman_ready(ctx, F.when(ok, c)), (x, both)) for x in (a, b))
    elif method != "pearson":
        raise ValueError(f"method {method!r}")
    return a._agg(lambda g: g(F.corr(g.c, g.others[0])), b)


def cov(a: Any, b: Any, *, ddof: int = 1) -> Expr:
    def fn(g: Agg) -> Column:
        if ddof == 1:
            return g(F.covar_samp(g.c, g.others[0]))
        pop = g(F.covar_pop(g.c, g.others[0]))
        return pop if ddof == 0 else N.rescaled(pop, g(F.count(F.when(g.c.isNotNull() & g.others[0].isNotNull(), F.lit(1)))), ddof)

    a, b = _names((a, b))
    return a._agg(fn, b)


def _horizontal(exprs: Any, fn: Callable[..., Column]) -> Expr:
    found = _names(exprs)
    if not found:
        raise InvalidOperationError("at least one expression is needed")
    return Expr("hori", fn, found)


def _fold(cols: Any, op: Callable[[Column, Column], Column]) -> Column:
    out = None
    for c in cols:
        out = c if out is None else op(out, c)
    return out


def sum_horizontal(*exprs: Any) -> Expr:
    return _horizontal(exprs, lambda ctx, *c: _fold([F.coalesce(x, F.lit(0)) for x in c], lambda a, b: a + b))


def mean_horizontal(*exprs: Any) -> Expr:
    def fn(ctx: Context, *c: Column) -> Column:
        n = _fold([x.isNotNull().cast("int") for x in c], lambda a, b: a + b)
        return F.try_divide(_fold([F.coalesce(x, F.lit(0)) for x in c], lambda a, b: a + b).cast("double"), n)

    return _horizontal(exprs, fn)


def min_horizontal(*exprs: Any) -> Expr:
    return _horizontal(exprs, lambda ctx, *c: F.least(*c) if len(c) > 1 else c[0])


def max_horizontal(*exprs: Any) -> Expr:
    return _horizontal(exprs, lambda ctx, *c: F.greatest(*c) if len(c) > 1 else c[0])


def all_horizontal(*exprs: Any, ignore_nulls: bool = False) -> Expr:
    return _horizontal(exprs, lambda ctx, *c: _fold([F.coalesce(x, F.lit(True)) if ignore_nulls else x for x in c], lambda a, b: a & b))


def any_horizontal(*exprs: Any, ignore_nulls: bool = False) -> Expr:
    return _horizontal(exprs, lambda ctx, *c: _fold([F.coalesce(x, F.lit(False)) if ignore_nulls else x for x in c], lambda a, b: a | b))


def concat_str(exprs: Any, *more_exprs: Any, separator: str = "", ignore_nulls: bool = False) -> Expr:
    def fn(ctx: Context, *c: Column) -> Column:
        text = F.concat_ws(separator, *[x.cast("string") for x in c])
        return text if ignore_nulls else F.when(_fold([x.isNotNull() for x in c], lambda a, b: a & b), text)

    return _horizontal([exprs, *more_exprs], fn)


def coalesce(exprs: Any, *more_exprs: Any) -> Expr:
    items = flat([exprs, *more_exprs])
    if any(not isinstance(x, (str, Expr)) and not hasattr(x, "_as_expr") for x in items):
        raise TypeError("coalesce takes names and expressions; use lit for values")
    return _horizontal(items, lambda ctx, *c: F.coalesce(*c))


def format(f_string: str, *args: Any) -> Expr:
    parts = f_string.split("{}")
    if len(parts) != len(args) + 1:
        raise ValueError("as many {} as arguments are needed")
    exprs: list[Any] = []
    for k, p in enumerate(parts):
        exprs += [lit(p)] if p else []
        exprs += [into(args[k], name=True)] if k < len(args) else []
    return concat_str(exprs)


def struct(*exprs: Any, **named_exprs: Any) -> Expr:
    items = _names(exprs) + [into(v, name=True).alias(k) for k, v in named_exprs.items()]

    # Field names are the operands' output names, which only lowering knows.
    def root(ctx: Context) -> list[tuple[str, Column]]:
        from ..plans.lower import lower

        fields = [(n, c) for e in items for n, c in lower(e, ctx)]
        return [(fields[0][0], F.struct(*[c.alias(n) for n, c in fields]))]

    return Expr("root", root, scalar=False, label="struct")


def list_(*exprs: Any) -> Expr:
    return _horizontal(exprs, lambda ctx, *c: F.array(*c))


class When:
    """when(...).then(...).when(...).then(...).otherwise(...)"""

    def __init__(self, predicates: Any, before: tuple[tuple[Expr, Expr], ...] = ()):
        found = [into(p, name=True) for p in flat(list(predicates))]
        self.predicate = found[0]
        for p in found[1:]:
            self.predicate = self.predicate & p
        self.before = before

    def then(self, value: Any) -> Then:
        return Then((*self.before, (self.predicate, into(value, name=True))))


class Then(Expr):
    def __init__(self, pairs: tuple[tuple[Expr, Expr], ...], other: Expr | None = None):
        self.pairs = pairs
        values = [v for _, v in pairs] + ([] if other is None else [other])
        tests = [p for p, _ in pairs]

        def fn(ctx: Context, *c: Column) -> Column:
            v, t = c[: len(values)], c[len(values) :]
            out = F.when(t[0], v[0])
            for a, b in zip(t[1:], v[1:], strict=False):
                out = out.when(a, b)
            return out if other is None else out.otherwise(v[-1])

        super().__init__("elem", fn, (*values, *tests), label="when")

    def when(self, *predicates: Any) -> When:
        return When(predicates, self.pairs)

    def otherwise(self, value: Any) -> Expr:
        return Then(self.pairs, into(value, name=True))


def when(*predicates: Any) -> When:
    return When(predicates)
