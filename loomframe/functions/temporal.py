"""The .dt accessor. Times without a zone are TIMESTAMP_NTZ; arithmetic on microseconds keeps the session's zone out."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidOperationError
from ..plans.lower import Context

_EVERY = re.compile(r"(\d+)(ns|us|ms|mo|s|m|h|d|q|y)")
#: Microseconds of the fixed units.
_MICROS = {"us": 1, "ms": 1000, "s": 10**6, "m": 60 * 10**6, "h": 3600 * 10**6, "d": 86400 * 10**6}
#: Months of the calendar units and the multiples that truncation takes.
_MONTHS = {"mo": (1, (1, 2, 3, 4, 6, 12)), "q": (3, (1, 2, 4)), "y": (12, (1,))}
_UNITS = {"ns": 1000, "us": 1, "ms": 1000, "s": 10**6}

# Strftime codes and Spark's pattern letters.
_CODES = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD", "p": "a", "z": "xx", "Z": "zzz", "%": "%"}
_SHORT = {"T": "%H:%M:%S", "F": "%Y-%m-%d", "D": "%m/%d/%y", "R": "%H:%M"}


def expand(fmt: str) -> str:
    return re.sub(r"%([TFDR])", lambda m: _SHORT[m[1]], fmt)


def spark_pattern(fmt: str) -> str:
    """A strftime format as a Spark datetime pattern; letters between codes are quoted."""
    out = []
    for code, text in re.findall(r"%(.)|([^%]+)", expand(fmt)):
        if code:
            if code not in _CODES:
                raise ValueError(f"%{code} has no Spark pattern")
            out.append(_CODES[code])
        else:
            out.append(re.sub(r"[A-Za-z']+", lambda m: "'" + m[0].replace("'", "''") + "'", text))
    return "".join(out)


def parse_every(every: str) -> tuple[int, str]:
    m = _EVERY.fullmatch(every)
    if not m or int(m[1]) < 1:
        raise ValueError(f"{every!r} isn't of the form <n><unit>")
    return int(m[1]), m[2]


def micros(ctx: Context, c: Column) -> Column:
    """Microseconds since 1970 of the wall clock (or of the instant, where there is a zone)."""
    kind = ctx.dtype(c)
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long") * _MICROS["d"]
    if isinstance(kind, T.TimestampNTZType):
        c = F.convert_timezone(F.lit("UTC"), F.current_timezone(), c).cast("timestamp")
    return F.unix_micros(c)


def from_micros(ctx: Context, us: Column, kind: T.DataType) -> Column:
    ts = F.timestamp_micros(us.cast("long"))
    if isinstance(kind, T.TimestampNTZType):
        return F.convert_timezone(F.current_timezone(), F.lit("UTC"), ts.cast("timestamp_ntz"))
    return ts.cast("timestamp_ntz").cast("date") if isinstance(kind, T.DateType) else ts


def interval_micros(c: Column) -> Column:
    days, hours, minutes, seconds = (F.extract(F.lit(u), c) for u in ("DAY", "HOUR", "MINUTE", "SECOND"))
    return ((days.cast("long") * 24 + hours) * 60 + minutes) * _MICROS["m"] + (seconds * 10**6).cast("long")


def _toward_zero(us: Column, per: int) -> Column:
    return F.call_function("div", us, F.lit(per).cast("long"))


class DtAccessor:
    def __init__(self, expr: Any):
        self.e = expr

    def _part(self, f: Any) -> Any:
        return self.e._map(f)

    def date(self) -> Any:
        return self._part(F.to_date)

    def year(self) -> Any:
        return self._part(F.year)

    def month(self) -> Any:
        return self._part(F.month)

    def day(self) -> Any:
        return self._part(F.day)

    def hour(self) -> Any:
        return self._part(F.hour)

    def minute(self) -> Any:
        return self._part(F.minute)

    def second(self) -> Any:
        return self._part(F.second)

    def millisecond(self) -> Any:
        return self.e._elem(lambda ctx, c: F.floor(F.pmod(micros(ctx, c), F.lit(10**6)) / 1000).cast("int"))

    def microsecond(self) -> Any:
        return self.e._elem(lambda ctx, c: F.pmod(micros(ctx, c), F.lit(10**6)).cast("int"))

    def nanosecond(self) -> Any:
        return self.e._elem(lambda ctx, c: (F.pmod(micros(ctx, c), F.lit(10**6)) * 1000).cast("int"))

    def ordinal_day(self) -> Any:
        return self._part(F.dayofyear)

    def weekday(self) -> Any:
        return self._part(lambda c: F.weekday(c) + 1)

    def _total(self, per: int) -> Any:
        return self._part(lambda c: _toward_zero(interval_micros(c), per))

    def total_minutes(self) -> Any:
        return self._total(_MICROS["m"])

    def total_seconds(self) -> Any:
        return self._total(_MICROS["s"])

    def total_milliseconds(self) -> Any:
        return self._total(_MICROS["ms"])

    def total_microseconds(self) -> Any:
        return self._part(interval_micros)

    def total_nanoseconds(self) -> Any:
        return self._part(lambda c: interval_micros(c) * 1000)

    def to_string(self, format: str) -> Any:
        def fn(ctx: Context, c: Column) -> Column:
            iso = {"G": lambda: F.extract(F.lit("YEAROFWEEK"), c).cast("string"), "V": lambda: F.lpad(F.weekofyear(c).cast("string"), 2, "0"), "u": lambda: (F.weekday(c) + 1).cast("string")}
            parts = [iso[x[1]]() if x[:1] == "%" and x[1:] in iso else F.date_format(c, spark_pattern(x)) for x in re.split(r"(%[GVu])", expand(format)) if x]
            return F.concat(*parts) if parts else F.when(c.isNotNull(), F.lit(""))

        return self.e._elem(fn)

    def timestamp(self, time_unit: str = "us") -> Any:
        if time_unit not in ("ns", "us", "ms"):
            raise ValueError(f"time_unit {time_unit!r}")
        return self.e._elem(lambda ctx, c: micros(ctx, c) * 1000 if time_unit == "ns" else F.floor(micros(ctx, c) / F.lit(_UNITS[time_unit])).cast("long") if time_unit == "ms" else micros(ctx, c))

    def replace_time_zone(self, time_zone: str | None) -> Any:
        def fn(ctx: Context, c: Column) -> Column:
            wall = c.cast("timestamp_ntz")
            return wall if time_zone is None else F.convert_timezone(F.lit(time_zone), F.current_timezone(), wall).cast("timestamp")

        return self.e._elem(fn)

    def convert_time_zone(self, time_zone: str) -> Any:
        """The wall clock of the instant in another zone: Spark shows zoned times in the session's, so without a zone."""

        def fn(ctx: Context, c: Column) -> Column:
            source = F.lit("UTC") if isinstance(ctx.dtype(c), T.TimestampNTZType) else F.current_timezone()
            return F.convert_timezone(source, F.lit(time_zone), c.cast("timestamp_ntz"))

        return self.e._elem(fn)

    def truncate(self, every: str) -> Any:
        n, unit = parse_every(every)

        def fn(ctx: Context, c: Column) -> Column:
            kind = ctx.dtype(c)
            if unit in _MONTHS:
                per, allowed = _MONTHS[unit]
                if n not in allowed:
                    raise InvalidOperationError(f"truncating to {every} isn't defined")
                months = F.year(c) * 12 + F.month(c) - 1
                months = months - F.pmod(months, F.lit(n * per))
                start = F.make_date(F.floor(months / 12).cast("int"), F.pmod(months, F.lit(12)) + 1, F.lit(1))
                return start if isinstance(kind, T.DateType) else start.cast(kind)
            if unit == "ns" and n % 1000:
                raise InvalidOperationError("Spark's times have microseconds")
            step = n // 1000 if unit == "ns" else n * _MICROS[unit]
            us = micros(ctx, c)
            return from_micros(ctx, us - F.pmod(us, F.lit(step)), kind)

        return self.e._elem(fn)

    def offset_by(self, by: str) -> Any:
        sign = -1 if by.startswith("-") else 1
        n, unit = parse_every(by.lstrip("-"))

        def fn(ctx: Context, c: Column) -> Column:
            kind = ctx.dtype(c)
            if unit in _MONTHS:
                return (c + F.make_ym_interval(F.lit(0), F.lit(sign * n * _MONTHS[unit][0]))).cast(kind)
            if unit == "d":
                return (c + F.make_dt_interval(F.lit(sign * n))).cast(kind)
            if isinstance(kind, T.DateType):
                raise InvalidOperationError("a date moves by days or more")
            us = n / 1000 if unit == "ns" else n * _MICROS[unit]
            if us != int(us):
                raise InvalidOperationError("Spark's times have microseconds")
            return (c + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.lit(sign * int(us)) / F.lit(10**6)).cast("decimal(18,6)"))).cast(kind)

        return self.e._elem(fn)
