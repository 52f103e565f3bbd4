"""The .str accessor."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .temporal import spark_pattern


def _plain(replacement: Column) -> Column:
    """A replacement whose backslashes and dollars stand for themselves."""
    return F.replace(F.replace(replacement, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))


class StrAccessor:
    def __init__(self, expr: Any):
        self.e = expr

    def len_chars(self) -> Any:
        return self.e._map(F.char_length)

    def replace(self, pattern: str, value: Any, *, literal: bool = False, n: int = 1) -> Any:
        """The first n matches (all, if n is -1)."""
        if n == -1:
            return self.replace_all(pattern, value, literal=literal)
        regex = re.escape(pattern) if literal else pattern

        def fn(c: Column, v: Column) -> Column:
            found = F.slice(F.regexp_extract_all(c, F.lit(f"({regex})"), F.lit(1)), 1, n)
            parts = F.split(c, regex, n + 1)
            tail = F.get(parts, F.size(parts) - 1)
            # Text before each of the first n matches, then the new value; what is left follows.
            head = F.array_join(F.transform(F.slice(parts, F.lit(1), F.size(found)), lambda p: F.concat(p, v)), "")
            return F.when(F.size(found) == 0, c).otherwise(F.concat(head, tail))

        return self.e._map(fn, value)

    def replace_all(self, pattern: str, value: Any, *, literal: bool = False) -> Any:
        if literal:
            return self.e._map(lambda c, v: F.replace(c, F.lit(pattern), v), value)
        return self.e._map(lambda c, v: F.regexp_replace(c, F.lit(pattern), _plain(v)), value)

    def strip_chars(self, characters: str | None = None) -> Any:
        return self.e._map(lambda c: F.btrim(c, F.lit(" \t\n\r\x0b\x0c" if characters is None else characters)))

    def starts_with(self, prefix: Any) -> Any:
        return self.e._map(lambda c, p: F.startswith(c, p), prefix)

    def ends_with(self, suffix: Any) -> Any:
        return self.e._map(lambda c, p: F.endswith(c, p), suffix)

    def contains(self, pattern: Any, *, literal: bool = False) -> Any:
        return self.e._map((lambda c, p: F.contains(c, p)) if literal else (lambda c, p: F.rlike(c, p)), pattern)

    def slice(self, offset: int, length: int | None = None) -> Any:
        def fn(c: Column) -> Column:
            n = F.char_length(c)
            start = F.lit(offset) if offset >= 0 else F.greatest(n + offset, F.lit(0))
            stop = n if length is None else F.least(n, (F.lit(offset) if offset >= 0 else n + offset) + length)
            return F.substring(c, start + 1, F.greatest(stop - start, F.lit(0)))

        return self.e._map(fn)

    def head(self, n: int = 5) -> Any:
        if n < 0:
            raise ValueError("n must not be negative")
        return self.slice(0, n)

    def tail(self, n: int = 5) -> Any:
        if n < 0:
            raise ValueError("n must not be negative")
        return self.slice(-n) if n else self.slice(0, 0)

    def split(self, by: str) -> Any:
        return self.e._map(lambda c: F.split(c, re.escape(by), -1))

    def to_datetime(self, format: str | None = None) -> Any:
        if format is None:
            return self.e._map(F.to_timestamp_ntz)
        pattern = spark_pattern(format)
        return self.e._map((lambda c: F.to_timestamp(c, F.lit(pattern))) if "%z" in format else (lambda c: F.to_timestamp_ntz(c, F.lit(pattern))))

    def to_date(self, format: str | None = None) -> Any:
        return self.e._map((lambda c: F.to_date(c)) if format is None else (lambda c: F.to_date(c, spark_pattern(format))))

    def to_time(self, format: str | None = None) -> Any:
        """Spark's time type is switched on for the session, if it isn't."""

        def fn(ctx: Any, c: Column) -> Column:
            ctx.top.df.sparkSession.conf.set("spark.sql.timeType.enabled", "true")
            return F.call_function("to_time", c, *([] if format is None else [F.lit(spark_pattern(format))]))

        return self.e._elem(fn)

    def to_uppercase(self) -> Any:
        return self.e._map(F.upper)

    def to_lowercase(self) -> Any:
        return self.e._map(F.lower)

    def to_titlecase(self) -> Any:
        """A letter after a character that is no letter is upper case, others are lower case."""

        def fn(c: Column) -> Column:
            runs = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
            return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 2**30))), "")

        return self.e._map(fn)

    def zfill(self, width: int) -> Any:
        def fn(c: Column) -> Column:
            sign = F.when(F.substring(c, 1, 1).isin("-", "+"), F.substring(c, 1, 1)).otherwise(F.lit(""))
            rest = F.when(sign == "", c).otherwise(F.substring(c, 2, 2**30))
            return F.when(F.char_length(c) >= width, c).otherwise(F.concat(sign, F.lpad(rest, F.lit(width) - F.char_length(sign), F.lit("0"))))

        return self.e._map(fn)

    def pad_start(self, length: int, fill_char: str = " ") -> Any:
        return self.e._map(lambda c: F.when(F.char_length(c) < length, F.lpad(c, length, fill_char)).otherwise(c))

    def pad_end(self, length: int, fill_char: str = " ") -> Any:
        return self.e._map(lambda c: F.when(F.char_length(c) < length, F.rpad(c, length, fill_char)).otherwise(c))
