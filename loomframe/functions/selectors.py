"""Selectors: sets of columns chosen by the schema; +, |, & and ^ of sets, ~ for the complement, - for the difference."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from typing import Any

from .. import dtypes as dt
from ..expr import Expr
from ..plans.lower import Context, ref


class Selector(Expr):
    def __init__(self, choose: Callable[[dict[str, Any]], list[str]]):
        self.choose = choose
        super().__init__("root", self._columns, scalar=False, label="selector")

    def _columns(self, ctx: Context) -> list[tuple[str, Any]]:
        kinds = {f.name: dt.from_spark(f.dataType, f.metadata) for f in ctx.top.df.schema.fields}
        return [(n, ref(n)) for n in self.choose({n: kinds[n] for n in ctx.names()})]

    def _with(self, o: Any, keep: Callable[[bool, bool], bool], otherwise: str) -> Any:
        if not isinstance(o, Selector):
            return getattr(super(), otherwise)(o)

        def choose(s: dict[str, Any]) -> list[str]:
            a, b = set(self.choose(s)), set(o.choose(s))
            return [n for n in s if keep(n in a, n in b)]

        return Selector(choose)

    def __or__(self, o: Any) -> Any:
        return self._with(o, lambda a, b: a or b, "__or__")

    def __and__(self, o: Any) -> Any:
        return self._with(o, lambda a, b: a and b, "__and__")

    def __sub__(self, o: Any) -> Any:
        return self._with(o, lambda a, b: a and not b, "__sub__")

    def __add__(self, o: Any) -> Any:
        return self._with(o, lambda a, b: a or b, "__add__")

    def __xor__(self, o: Any) -> Any:
        return self._with(o, lambda a, b: a != b, "__xor__")

    def __invert__(self) -> Any:
        return Selector(lambda s: [n for n in s if n not in set(self.choose(s))])


def _by(test: Callable[[Any], bool]) -> Selector:
    return Selector(lambda s: [n for n, d in s.items() if test(d)])


def by_dtype(*dtypes: Any) -> Selector:
    wanted = [x for d in dtypes for x in (d if isinstance(d, Iterable) and not isinstance(d, type) else [d])]
    return _by(lambda d: any(d == w for w in wanted))


def matches(pattern: str) -> Selector:
    return Selector(lambda s: [n for n in s if re.search(pattern, n)])


def numeric() -> Selector:
    return _by(lambda d: d.is_numeric())


def boolean() -> Selector:
    return by_dtype(dt.Boolean)


def string() -> Selector:
    return by_dtype(dt.String)


def categorical() -> Selector:
    return by_dtype(dt.Categorical)


def enum() -> Selector:
    return by_dtype(dt.Enum)


def all() -> Selector:
    return _by(lambda d: True)


def datetime(time_unit: Any = None, time_zone: Any = ("*", None)) -> Selector:
    units = [time_unit] if isinstance(time_unit, str) else list(time_unit or ("ns", "us", "ms", "s"))
    zones = [time_zone] if time_zone is None or isinstance(time_zone, str) else list(time_zone)
    return _by(lambda d: isinstance(d, dt.Datetime) and d.time_unit in units and (d.time_zone in zones or (d.time_zone is not None and "*" in zones)))
