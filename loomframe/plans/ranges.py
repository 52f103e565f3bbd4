"""A total order over all rows without one task that sorts them: ranges of the sort keys.

A bounded random sample of the keys (one job when a frame is built) gives the bounds of at most MOST ranges, as a single
row; a row finds its range by binary searches among the bounds' values. Numbers and running values are made within
ranges, and a table with one row per range carries them on. Equal keys are in one range, so callers add a tie-breaker
that tells rows apart where they have one.

The hidden row column of an eager frame is such an order already: its upper bits are a range (or the part of the input
that the row was read from), and the lower ones a place there. Ranges of it need no sample.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.internal import InternalFunction

from .lower import ref, temp_name

#: The most ranges, and sampled keys for each of them.
MOST, SAMPLED = 1024, 50
#: The hidden row column of eager frames, and the bits of a row's place in its range (as in monotonically_increasing_id).
ROW, PLACE = "__loom_row", 33
#: More than there are places between and at the bounds' values, and for nulls.
_WIDTH = 4 * MOST


@dataclass
class Key:
    """A sort key: nulls come first unless told otherwise, whichever the direction."""

    col: Column
    descending: bool = False
    nulls_last: bool = False

    def sorting(self) -> Column:
        kinds = {(False, False): "asc_nulls_first", (False, True): "asc_nulls_last", (True, False): "desc_nulls_first", (True, True): "desc_nulls_last"}
        return getattr(self.col, kinds[self.descending, self.nulls_last])()


def _search(values: Column, n: int, then: Column, x: Column) -> Column:
    """What `then` says of the place of x among n ascending values; null for a null."""
    return F.get(then, InternalFunction.array_binary_search(values, x) + F.lit(n + 1))  # -(where it would be) - 1 if missing


def _places(n: int) -> Any:
    """The places of all that a search among n values may find, from -n - 1: 2i + 1 at the one numbered i, 2i before it."""
    import numpy as np

    found = np.arange(-n - 1, n)
    return np.where(found < 0, -2 * (found + 1), 2 * found + 1)


def _sample(picked: DataFrame, keys: list[Key], rows: int) -> Any:
    return picked.orderBy(F.rand(1)).limit(rows).orderBy(*[Key(ref(f"k{i}"), k.descending, k.nulls_last).sorting() for i, k in enumerate(keys)]).toArrow()


def ranged(df: DataFrame, keys: list[Key], name: str, tie: Key | None = None) -> tuple[DataFrame, int]:
    """Add the number of each row's range (0 and up, in the keys' order); returns the frame and how many there are: one
    for a frame of fewer rows than would be sampled. The tie-breaker takes part where the keys alone leave a value as
    long as a range."""
    import numpy as np
    import pyarrow as pa

    spark = df.sparkSession
    n = max(1, min(MOST, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def key(c: Column, kind: T.DataType) -> Column:
        return F.when(c == 0, F.lit(0).cast(kind)).otherwise(c) if isinstance(kind, (T.DoubleType, T.FloatType)) else c  # -0.0 is 0.0

    def bounds_of(keys: list[Key]) -> tuple[DataFrame, DataFrame, Any, list[int]] | None:
        """Keys, bounds, the bounds' values of each key in its order, and how many bounds the first keys tell apart."""
        kinds = df.select(*[k.col for k in keys]).schema
        picked = df.select(*[key(k.col, f.dataType).alias(f"k{i}") for i, (k, f) in enumerate(zip(keys, kinds, strict=True))])
        sample = _sample(picked, keys, n * SAMPLED)
        if sample.num_rows < n * SAMPLED:
            return None
        bounds = spark.createDataFrame(sample.take(pa.array(range(SAMPLED, sample.num_rows, SAMPLED))), picked.schema)
        names = picked.columns
        sets = [F.size(F.collect_set(F.struct(*names[: i + 1]))).alias(f"n{i}") for i in range(len(names))]
        values = bounds.agg(*[F.array_sort(F.collect_set(ref(c))).alias(c) for c in names], *sets).toArrow()
        return picked, bounds, values, [values.column(f"n{i}")[0].as_py() for i in range(len(names))]

    got = None if n == 1 else bounds_of(keys)
    if got and tie is not None and got[3][-1] < n - 1:
        keys = [*keys, tie]
        got = bounds_of(keys)
    if got is None:
        return df.withColumn(name, F.lit(0)), 1
    picked, bounds, values, apart = got
    keys = keys[: apart.index(apart[-1]) + 1]  # the others make no more ranges
    names = picked.columns[: len(keys)]
    # A number that sorts as the key does for each place among the bounds' values of it. Each expression below is used
    # once, or Spark would compute it more often.
    sizes = [len(values.column(c)[0]) for c in names]
    row: dict[str, tuple[T.DataType, Any]] = {}

    def held(kind: T.DataType, array: Any) -> Column:
        name = temp_name("b")
        row[name] = (T.ArrayType(kind, False), array)  # without nulls searches need no boxes
        return ref(name)

    longs = lambda x: pa.array([x], pa.list_(pa.int64()))
    looks = [(held(f.dataType, values.column(f.name)), held(T.LongType(), longs((2 * m - _places(m) if k.descending else _places(m)) + 1))) for f, k, m in zip(picked.schema, keys, sizes)]

    def one() -> DataFrame:
        table = pa.table([v for _, v in row.values()], names=list(row))
        return F.broadcast(spark.createDataFrame(table, T.StructType([T.StructField(c, kind, False) for c, (kind, _) in row.items()])))  # a single row

    def codes(cols: list[Column]) -> list[Column]:
        return [F.coalesce(_search(v, m, then, c), F.lit(2 * m + 2 if k.nulls_last else 0).cast("long")) for (v, then), m, k, c in zip(looks, sizes, keys, cols, strict=True)]

    found = bounds.crossJoin(one()).select(*[c.alias(n) for c, n in zip(codes([ref(c) for c in names]), names, strict=True)]).toArrow()
    kinds = df.select(*[k.col for k in keys]).schema
    mine = codes([key(k.col, f.dataType) for k, f in zip(keys, kinds, strict=True)])
    # Key by key: the place among the bounds so far and the code of the next key make one number. The last place is a range.
    before, at = np.zeros(found.num_rows, np.int64), F.lit(0).cast("long")
    for c, code in zip(names, mine, strict=True):
        joint = before + found.column(c).to_numpy()
        steps = np.unique(joint)
        places = _places(len(steps))
        before = (2 * np.searchsorted(steps, joint) + 1) * _WIDTH
        at = _search(held(T.LongType(), longs(steps)), len(steps), held(T.LongType(), longs((places + 1) // 2 if c == names[-1] else places * _WIDTH)), at + code)
    return df.crossJoin(one()).withColumn(name, at.cast("int")).drop(*row), len(steps) + 1


#: What a frame may consist of for its rows to be dealt over the parts of it in the same way whenever it is computed.
_STEADY = {"Project", "Filter", "LogicalRelation", "LocalRelation", "LogicalRDD", "SubqueryAlias", "Generate", "Union", "Range", "OneRowRelation", "View", "DataSourceV2Relation"}


def steady(df: DataFrame) -> bool:
    """Is the row column the same whenever the frame is computed? Not if numbered by the parts that a shuffle leaves, or
    if any of several rows is taken."""

    def children(node: Any) -> list[Any]:
        found = node.children()
        return [found.apply(i) for i in range(found.size())]

    def plain(node: Any) -> bool:
        return node.nodeName() in _STEADY and all(plain(c) for c in children(node))

    def check(node: Any) -> bool:
        if node.nodeName() in ("Deduplicate", "GlobalLimit", "Sample"):
            return False
        below = children(node)
        if node.nodeName() == "Project" and "monotonically_increasing_id" in node.simpleString(10**6):
            return all(plain(c) for c in below)
        return all(check(c) for c in below)

    return check(df._jdf.queryExecution().analyzed())


def _by_row(df: DataFrame, keys: list[Key]) -> bool:
    return len(keys) == 1 and not keys[0].descending and str(keys[0].col) == str(ref(ROW)) and steady(df)


def parts(df: DataFrame, keys: list[Key], name: str) -> tuple[DataFrame, int | None]:
    """Ranges of any keys, or of the row column (how many there are of those isn't known)."""
    if _by_row(df, keys):
        return df.withColumn(name, F.shiftright(ref(ROW), PLACE)), None
    return ranged(df, keys, name)


def carried(df: DataFrame, part: str, own: dict[str, Column], before: dict[str, Any], *, reverse: bool = False, of: DataFrame | None = None) -> DataFrame:
    """Add to each row what the ranges before its own (behind it, if reverse) come to: `own` are aggregates of a range,
    `before` functions that make one of those of many ranges into one, over a window of them. of: the frame that has the
    ranges' rows, if another one has them at less cost."""
    w = Window.orderBy(ref(part).desc() if reverse else ref(part).asc()).rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    ends = (df if of is None else of).groupBy(ref(part)).agg(*[c.alias(k) for k, c in own.items()])
    return df.join(F.broadcast(ends.select(ref(part), *[before[k](ref(k)).over(w).alias(k) for k in own])), part)


#: The row column as `placed` makes it, in an analysed plan.
_PLACED = re.compile(rf"shiftleft\(cast\((__loom_p\d+)#\d+ as bigint\), {PLACE}\) \+ __loom_n\d+#\d+L\) AS {ROW}#\d+L")


def _before_placing(df: DataFrame) -> tuple[DataFrame, str] | None:
    """Where every row of a sort is still there, so that its places have no gaps: the rows as they were dealt over the
    ranges, before any was sorted, and the column with the range."""

    def row_of(node: Any) -> str | None:
        found = node.output()
        return next((str(a.exprId()) for a in (found.apply(i) for i in range(found.size())) if a.name() == ROW), None)

    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "SubqueryAlias") and row_of(node) == row_of(node.children().head()):
        node = node.children().head()
    made = node.nodeName() == "Project" and _PLACED.search(node.simpleString(10**6))
    while node.nodeName() == "Project":
        node = node.children().head()
    if not made or node.nodeName() != "Window":
        return None
    spark = df.sparkSession
    rows = DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, node.children().head()), spark)
    return rows, made[1]


def numbered(df: DataFrame, keys: list[Key], name: str) -> DataFrame:
    """0-based row numbers in the keys' order."""
    part, base = temp_name("p"), temp_name("n")
    if _by_row(df, keys) and (made := _before_placing(df)):
        rows, old = made
        out = carried(df.withColumn(part, F.shiftright(ref(ROW), PLACE)), part, {base: F.count(F.lit(1))}, {base: F.sum}, of=rows.withColumn(part, ref(old).cast("long")))
        at = ref(ROW).bitwiseAND(F.lit((1 << PLACE) - 1)) - 1  # places are from 1
        return out.withColumn(name, at + F.coalesce(ref(base), F.lit(0))).drop(part, base)
    by = [k.sorting() for k in keys]
    out, n = parts(df, keys, part)
    if n == 1:
        return df.withColumn(name, (F.row_number().over(Window.orderBy(*by)) - 1).cast("long"))
    out = carried(out, part, {base: F.count(F.lit(1))}, {base: F.sum})
    at = F.row_number().over(Window.partitionBy(ref(part)).orderBy(*by)) - 1
    return out.withColumn(name, (at + F.coalesce(ref(base), F.lit(0))).cast("long")).drop(part, base)


def placed(df: DataFrame, keys: list[Key], tie: Key) -> DataFrame:
    """A new row column in the keys' order: a range and the place in it."""
    part, at = temp_name("p"), temp_name("n")
    out, n = ranged(df, keys, part, tie)
    w = Window.orderBy if n == 1 else Window.partitionBy(ref(part)).orderBy
    out = out.withColumn(at, F.row_number().over(w(*[k.sorting() for k in [*keys, tie]])).cast("long"))
    return out.withColumn(ROW, F.shiftleft(ref(part).cast("long"), PLACE) + ref(at)).select(*[ref(c) for c in df.columns])


def ranks(df: DataFrame, col: Column, descending: bool) -> DataFrame:
    """A row (v, lo, n, dense) per value that isn't null: rows before it, rows with it, values before it."""
    values = df.where(col.isNotNull()).groupBy(col.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    part = temp_name("p")
    out, n = ranged(values, [Key(ref("v"), descending)], part)
    w = Window.partitionBy(ref(part)).orderBy(ref("v").desc() if descending else ref("v").asc()).rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumns({"lo": F.coalesce(F.sum("n").over(w), F.lit(0)), "dense": F.count(F.lit(1)).over(w)})
    if n == 1:
        return out.drop(part)
    before = Window.orderBy(ref(part)).rowsBetween(Window.unboundedPreceding, -1)
    bases = out.groupBy(ref(part)).agg(F.sum("n").alias("a"), F.count(F.lit(1)).alias("b"))
    bases = bases.select(ref(part), F.coalesce(F.sum("a").over(before), F.lit(0)).alias("a"), F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b"))
    out = out.join(F.broadcast(bases), part)  # a row per range
    return out.withColumns({"lo": F.col("lo") + F.col("a"), "dense": F.col("dense") + F.col("b")}).drop(part, "a", "b")
