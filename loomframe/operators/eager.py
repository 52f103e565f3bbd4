"""Eager frames and series: rows have an order, kept in a hidden column; the data stays in Spark."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

from pyspark.sql import DataFrame as SparkFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ColumnNotFoundError, InvalidOperationError, ShapeError
from ..expr import Expr, col, flat, into
from ..plans.lower import ref, temp_name
from .frame import ROW, LazyFrame, numbered


class DataFrame(LazyFrame):
    def __init__(self, native: SparkFrame):
        super().__init__(native if ROW in native.columns else native.withColumn(ROW, F.monotonically_increasing_id()))

    # --- in: see loomframe.sources ---
    @staticmethod
    def from_arrow(spark: Any, table: Any) -> DataFrame:
        from .. import sources

        return sources.from_arrow(spark, table)

    @staticmethod
    def from_dict(spark: Any, data: Any, schema: Any = None) -> DataFrame:
        from .. import sources

        return sources.from_dict(spark, data, schema)

    @staticmethod
    def from_dicts(spark: Any, data: Any, schema: Any = None) -> DataFrame:
        from .. import sources

        return sources.from_dicts(spark, data, schema)

    @staticmethod
    def from_numpy(spark: Any, data: Any, schema: Any = None) -> DataFrame:
        from .. import sources

        return sources.from_numpy(spark, data, schema)

    def _ordered(self) -> SparkFrame:
        return self._df.orderBy(ROW).drop(ROW)

    # --- out ---
    def to_pandas(self) -> Any:
        return self._ordered().toPandas()

    def to_arrow(self) -> Any:
        return self._ordered().toArrow()

    def to_polars(self) -> Any:
        import polars as pl

        return pl.from_arrow(self.to_arrow())

    def to_numpy(self) -> Any:
        return self.to_pandas().to_numpy()

    def to_dict(self, *, as_series: bool = True) -> dict[str, Any]:
        return {c: self.get_column(c) for c in self.columns} if as_series else self.to_arrow().to_pydict()

    def __arrow_c_stream__(self, requested_schema: Any = None) -> Any:
        return self.to_arrow().__arrow_c_stream__(requested_schema)

    def write_csv(self, file: str | None = None) -> str | None:
        """A folder of CSV parts, or the text itself without `file`."""
        if file is None:
            return self.to_pandas().to_csv(index=False)
        self._ordered().write.mode("overwrite").option("header", True).csv(str(file))
        return None

    def write_parquet(self, file: str) -> None:
        self._ordered().write.mode("overwrite").parquet(str(file))

    def rows(self, *, named: bool = False) -> list[Any]:
        return list(self.iter_rows(named=named))

    def iter_rows(self, *, named: bool = False, buffer_size: int = 512) -> Iterator[Any]:
        for r in self._ordered().toLocalIterator():
            yield r.asDict() if named else tuple(r)

    def row(self, index: int) -> tuple[Any, ...]:
        if (out := self[index : index + 1].rows()) if index >= 0 else (out := self.tail(-index).rows()[:1]):
            return out[0]
        raise IndexError(index)

    def item(self, row: int | None = None, column: int | str | None = None) -> Any:
        if row is None and column is None:
            if self.shape != (1, 1):
                raise ShapeError("item without place needs one row and column")
            row, column = 0, 0
        if row is None or column is None:
            raise ValueError("give both row and column, or neither")
        name = self.columns[column] if isinstance(column, int) else column
        return self.select(name).row(row)[0]

    # --- shape ---
    @property
    def shape(self) -> tuple[int, int]:
        return self._df.count(), len(self.columns)

    def __len__(self) -> int:
        return self._df.count()

    def is_empty(self) -> bool:
        return self._df.isEmpty()

    def estimated_size(self, unit: str = "b") -> float:
        """Spark's own estimate of the plan's output."""
        scale = {"b": 1, "kb": 2**10, "mb": 2**20, "gb": 2**30, "tb": 2**40}[unit]
        return int(str(self._df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) / scale

    def clone(self) -> DataFrame:
        return DataFrame(self._df)

    # --- columns ---
    def get_column(self, name: str) -> Series:
        if name not in self.columns:
            raise ColumnNotFoundError(name)
        return Series(self._df.select(ref(name), ROW), name)

    def iter_columns(self) -> Iterator[Series]:
        return (self.get_column(c) for c in self.columns)

    def _mask(self, test: Any) -> Series:
        return Series(self._df.select(test.alias("mask"), ROW), "mask")

    def is_duplicated(self) -> Series:
        return self._mask(F.count(F.lit(1)).over(Window.partitionBy(*[ref(c) for c in self.columns])) > 1)

    def is_unique(self) -> Series:
        return self._mask(F.count(F.lit(1)).over(Window.partitionBy(*[ref(c) for c in self.columns])) == 1)

    def null_count(self) -> DataFrame:
        return DataFrame(self._df.agg(*[F.count_if(ref(c).isNull()).alias(c) for c in self.columns]))

    def __getitem__(self, key: Any) -> Any:
        if isinstance(key, str):
            return self.get_column(key)
        if isinstance(key, tuple) and len(key) == 2:
            rows, cols = key
            out = self[rows] if not isinstance(rows, int) else self[[rows]]
            if isinstance(cols, int):
                cols = self.columns[cols]
            if isinstance(cols, str):
                return out.get_column(cols).item() if isinstance(rows, int) else out.get_column(cols)
            names = self.columns[cols] if isinstance(cols, slice) and not isinstance(cols.start, str) and not isinstance(cols.stop, str) else self.columns[self.columns.index(cols.start) if cols.start else 0 : self.columns.index(cols.stop) + 1 if cols.stop else None] if isinstance(cols, slice) else [self.columns[c] if isinstance(c, int) else c for c in cols]
            return out.select(*names)
        if isinstance(key, list) and key and all(isinstance(k, str) for k in key):
            return self.select(*key)
        return DataFrame(_rows(self._df, key))

    def filter(self, *predicates: Any, **constraints: Any) -> DataFrame:
        masks = [p for p in flat(list(predicates)) if isinstance(p, list)]
        if masks or any(isinstance(p, bool) for p in predicates):
            raise InvalidOperationError("use expressions or series as predicates")
        return super().filter(*predicates, **constraints)

    def sample(self, n: int | None = None, *, fraction: float | None = None, with_replacement: bool = False, seed: int | None = None) -> DataFrame:
        """Exactly n (or int(rows * fraction)) rows."""
        n = int(self._df.count() * fraction) if n is None and fraction is not None else 1 if n is None else n
        if not with_replacement:
            return DataFrame(self._df.orderBy(F.rand(seed)).limit(n))
        at, total = temp_name(), self._df.count()
        spark = self._df.sparkSession
        picks = spark.range(n).select(F.floor(F.rand(seed) * total).cast("long").alias(at), F.col("id").alias("__loom_pick"))
        out = numbered(self._df, [ref(ROW)], at).drop(ROW).join(picks, at).drop(at)
        return DataFrame(out.withColumnRenamed("__loom_pick", ROW))

    def pivot(self, on: Any, *, index: Any = None, values: Any = None, aggregate_function: str | None = None, maintain_order: bool | None = None, sort_columns: bool = False, separator: str = "_") -> DataFrame:
        """Long to wide. Columns are in the order of first appearance, or sorted; without an aggregate function each cell may have one value."""
        ons = flat(on)
        if index is None and values is None:
            raise ValueError("give index or values")
        ids = [c for c in self.columns if c not in ons and c not in flat(values)] if index is None else flat(index)
        vals = [c for c in self.columns if c not in ons and c not in ids] if values is None else flat(values)
        order = F.struct(ROW)
        make = {
            "min": F.min, "max": F.max, "sum": F.sum, "mean": F.avg, "median": F.median, "len": lambda c: F.count(F.lit(1)),
            "first": lambda c: F.min_by(F.struct(c), order).getField("col1"), "last": lambda c: F.max_by(F.struct(c), order).getField("col1"),
            None: lambda c: F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("more than one value in a cell")).cast("string")),
        }
        label = temp_name("on")
        joined = ref(ons[0]).cast("string") if len(ons) == 1 else F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit('"'), ref(c).cast("string"), F.lit('"')) for c in ons]), F.lit("}"))
        df = self._df.withColumn(label, joined)
        names = _columns(df.groupBy(label).agg(F.min(ROW).alias("r")).orderBy(label if sort_columns else "r").select(label))

        def cell(v: str, name: str) -> Any:
            here = F.when(ref(label).eqNullSafe(F.lit(name)), ref(v))
            if aggregate_function == "len":
                return F.count(F.when(ref(label) == name, F.lit(1)))
            if aggregate_function in ("first", "last"):
                key = F.when(ref(label) == name, ref(ROW))
                return (F.min_by if aggregate_function == "first" else F.max_by)(F.struct(ref(v).alias("v")), key)["v"]
            if aggregate_function is None:
                kind = self._df.schema[v].dataType
                many = F.count(F.when(ref(label) == name, F.lit(1))) > 1
                return F.when(many, F.raise_error(F.lit("more than one value in a cell")).cast(kind)).otherwise(F.max(here))
            return make[aggregate_function](here)

        cols = [cell(v, n).alias(n if len(vals) == 1 else f"{v}{separator}{n}") for v in vals for n in names]
        out = df.groupBy(*[ref(c) for c in ids]).agg(*cols, F.min(ROW).alias(ROW))
        return DataFrame(out)


#: The most columns that values may become.
MOST_COLUMNS = 10_000


def _columns(values: SparkFrame) -> list[Any]:
    """Values that become columns; too many of them are refused."""
    found = [r[0] for r in values.limit(MOST_COLUMNS + 1).collect()]
    if len(found) > MOST_COLUMNS:
        raise InvalidOperationError(f"more than {MOST_COLUMNS} values can't become columns")
    return found


def _rows(df: SparkFrame, key: Any) -> SparkFrame:
    """Rows by slice or list of places."""
    at = temp_name()
    out = numbered(df, [ref(ROW)], at)
    if isinstance(key, slice):
        n = df.count() if any(x is not None and x < 0 for x in (key.start, key.stop)) else None
        start, stop, step = key.start or 0, key.stop, key.step or 1
        start = max(0, start + n) if start < 0 else start
        stop = stop + n if stop is not None and stop < 0 else stop
        test = (ref(at) >= start) & ((ref(at) - start) % step == 0)
        return out.where(test if stop is None else test & (ref(at) < stop)).drop(at)
    places = [int(k) for k in ([key] if isinstance(key, int) else key)]
    n = df.count() if any(k < 0 for k in places) else 0
    picks = df.sparkSession.createDataFrame([(k + n if k < 0 else k, i) for i, k in enumerate(places)], f"`{at}` long, pick long")
    return out.drop(ROW).join(F.broadcast(picks), at).drop(at).withColumnRenamed("pick", ROW)  # the list comes from the driver


_AGGS = {"sum", "mean", "median", "min", "max", "count", "n_unique", "null_count", "any", "all", "var", "std", "skew", "kurtosis", "quantile", "first", "last", "any_value"}


class Series:
    """One ordered column. Expression methods work here as on `Expr`; aggregates give Python values."""

    def __init__(self, native: SparkFrame, name: str):
        self._df, self._name = native, name

    # --- construction ---
    @classmethod
    def from_iterable(cls, spark: Any, name: str, values: Iterable[Any], dtype: Any = None) -> Series:
        import pyarrow as pa

        from ..sources import from_arrow

        data = pa.table({name: pa.array(list(values))})
        s = from_arrow(spark, data).get_column(name)
        return s if dtype is None else s.cast(dtype)

    @classmethod
    def from_numpy(cls, spark: Any, name: str, values: Any, dtype: Any = None) -> Series:
        return cls.from_iterable(spark, name, values.tolist(), dtype)

    # --- plumbing ---
    @property
    def name(self) -> str:
        return self._name

    @property
    def dtype(self) -> Any:
        return self.to_frame().schema[self._name]

    @property
    def shape(self) -> tuple[int]:
        return (len(self),)

    def __len__(self) -> int:
        return self._df.count()

    def len(self) -> int:
        return self._df.count()

    def is_empty(self) -> bool:
        return self._df.isEmpty()

    def to_frame(self) -> DataFrame:
        return DataFrame(self._df)

    def to_native(self) -> SparkFrame:
        return self._df.drop(ROW)

    def to_list(self) -> list[Any]:
        return [r[0] for r in self._df.orderBy(ROW).select(ref(self._name)).collect()]

    def to_numpy(self) -> Any:
        return self.to_pandas().to_numpy()

    def to_pandas(self) -> Any:
        return self.to_frame().to_pandas()[self._name]

    def to_arrow(self) -> Any:
        return self.to_frame().to_arrow().column(self._name).combine_chunks()

    def to_polars(self) -> Any:
        return self.to_frame().to_polars()[self._name]

    def __iter__(self) -> Iterator[Any]:
        return (r[0] for r in self.to_frame().iter_rows())

    def __contains__(self, value: Any) -> bool:
        test = ref(self._name).isNull() if value is None else ref(self._name) == F.lit(value)
        return not self._df.where(test).isEmpty()

    def __getitem__(self, key: Any) -> Any:
        return self.item(key) if isinstance(key, int) else self._with(DataFrame(_rows(self._df, key)))

    def _with(self, frame: DataFrame) -> Series:
        return Series(frame._df, frame.columns[0])

    def _do(self, expr: Expr) -> Any:
        out = self.to_frame().select(expr)
        return out.rows()[0][0] if expr.scalar else self._with(out)

    def __getattr__(self, what: str) -> Any:
        if what.startswith("_") or not hasattr(Expr, what):
            raise AttributeError(what)
        mine = col(self._name)
        if what in ("dt", "str", "list", "struct", "cat"):
            return _Accessor(self, getattr(mine, what))
        return lambda *a, **k: self._do(getattr(mine, what)(*a, **k))

    # --- series only ---
    def alias(self, name: str) -> Series:
        return Series(self._df.withColumnRenamed(self._name, name), name)

    rename = alias

    def filter(self, predicate: Expr) -> Series:
        return self._with(self.to_frame().filter(predicate))

    def drop_nulls(self) -> Series:
        return Series(self._df.where(ref(self._name).isNotNull()), self._name)

    def unique(self, *, maintain_order: bool = False) -> Series:
        return Series(self._df.groupBy(ref(self._name)).agg(F.min(ROW).alias(ROW)), self._name)

    def mode(self, *, keep: str = "all") -> Any:
        counts = self._df.groupBy(ref(self._name)).agg(F.count(F.lit(1)).alias("n"), F.min(ROW).alias(ROW))
        best = counts.agg(F.max("n").alias("m"))
        out = counts.join(F.broadcast(best), F.col("n") == F.col("m")).drop("n", "m")  # one row
        return Series(out, self._name) if keep == "all" else out.agg(F.min(ref(self._name))).first()[0]

    def _place(self, largest: bool) -> int | None:
        at = temp_name()
        d = numbered(self._df, [ref(ROW)], at).where(ref(self._name).isNotNull())
        key = F.struct(ref(self._name), -ref(at)) if largest else F.struct(ref(self._name), ref(at))
        return d.agg((F.max_by if largest else F.min_by)(ref(at), key)).first()[0]

    def arg_min(self) -> int | None:
        return self._place(largest=False)

    def arg_max(self) -> int | None:
        return self._place(largest=True)

    def arg_true(self) -> Series:
        at = temp_name()
        d = numbered(self._df, [ref(ROW)], at).where(ref(self._name))
        return Series(d.select(ref(at).alias(self._name), ROW), self._name)

    def scatter(self, indices: Any, values: Any) -> Series:
        idx = [indices] if isinstance(indices, int) else list(indices)
        vals = list(values) if isinstance(values, (list, tuple, Series)) else [values] * len(idx)
        at, new = temp_name(), temp_name()
        kind = self._df.schema[self._name].dataType
        change = self._df.sparkSession.createDataFrame(list(zip(idx, [(v,) for v in vals], strict=True)), T.StructType([T.StructField(at, T.LongType()), T.StructField(new, T.StructType([T.StructField("v", kind)]))]))
        d = numbered(self._df, [ref(ROW)], at).join(F.broadcast(change), at, "left")  # both come from the driver
        return Series(d.select(F.when(ref(new).isNotNull(), ref(new)["v"]).otherwise(ref(self._name)).alias(self._name), ROW), self._name)

    def sort(self, *, descending: bool = False, nulls_last: bool = False) -> Series:
        return self._with(self.to_frame().sort(self._name, descending=descending, nulls_last=nulls_last))

    def sample(self, n: int | None = None, *, fraction: float | None = None, with_replacement: bool = False, seed: int | None = None) -> Series:
        return self._with(self.to_frame().sample(n, fraction=fraction, with_replacement=with_replacement, seed=seed))

    def is_sorted(self, *, descending: bool = False) -> bool:
        before = temp_name()
        d = self.to_frame().with_columns(col(self._name).shift(1).alias(before))._df
        test = ref(before) >= ref(self._name) if descending else ref(before) <= ref(self._name)
        return bool(d.select(test.alias("x")).agg(F.coalesce(F.bool_and("x"), F.lit(True))).first()[0])

    def value_counts(self, *, sort: bool = False, parallel: bool = False, name: str | None = None, normalize: bool = False) -> DataFrame:
        label = name or ("proportion" if normalize else "count")
        out = self._df.groupBy(ref(self._name)).agg(F.count(F.lit(1)).alias(label), F.min(ROW).alias(ROW))
        if normalize:
            total = self._df.agg(F.count(F.lit(1)).alias("__loom_total"))
            out = out.crossJoin(F.broadcast(total)).withColumn(label, ref(label) / F.col("__loom_total")).drop("__loom_total")  # one row
        frame = DataFrame(out)
        return frame.sort(label, descending=True) if sort else frame

    def zip_with(self, mask: Series, other: Series) -> Series:
        at = temp_name()
        a, m, o = (numbered(s._df.select(ref(s._name).alias(n), ROW), [ref(ROW)], at) for s, n in ((self, "a"), (mask, "m"), (other, "o")))
        d = a.join(m.drop(ROW), at).join(o.drop(ROW), at)
        return Series(d.select(F.when(F.col("m"), F.col("a")).otherwise(F.col("o")).alias(self._name), ROW), self._name)

    def item(self, index: int | None = None) -> Any:
        if index is None:
            if len(self) != 1:
                raise ShapeError("item without index needs one value")
            index = 0
        return self.to_frame().row(index)[0]

    def head(self, n: int = 10) -> Series:
        return self._with(self.to_frame().head(n))

    def tail(self, n: int = 10) -> Series:
        return self._with(self.to_frame().tail(n))

    def gather_every(self, n: int, offset: int = 0) -> Series:
        return self._with(self.to_frame().gather_every(n, offset))

    def to_dummies(self, *, separator: str = "_", drop_first: bool = False) -> DataFrame:
        values = _columns(self._df.select(ref(self._name)).distinct().orderBy(ref(self._name).asc_nulls_first()))
        values = values[1:] if drop_first else values
        cols = [ref(self._name).eqNullSafe(F.lit(v)).cast("byte").alias(f"{self._name}{separator}{'null' if v is None else v}") for v in values]
        return DataFrame(self._df.select(*cols, ROW))

    def hist(self, bins: list[float] | None = None, *, bin_count: int | None = None, include_breakpoint: bool = True) -> DataFrame:
        """Counts in right-closed bins, the lowest edge included."""
        if bins is not None and bin_count is not None:
            raise InvalidOperationError("give bins or bin_count")
        x = ref(self._name).cast("double")
        if bins is None:
            n = 10 if bin_count is None else bin_count
            lo, hi = self._df.agg(F.min(F.when(~F.isnan(x), x)), F.max(F.when(~F.isnan(x), x))).first()
            if lo is None:
                lo, hi = 0.0, 1.0
            elif lo == hi:
                lo, hi = lo - 0.5, hi + 0.5
            edges = [lo + (hi - lo) * k / n for k in range(n)] + [hi] if n else []
        else:
            edges = [float(b) for b in bins]
            if any(a >= b for a, b in zip(edges, edges[1:], strict=False)):
                raise InvalidOperationError("bins must increase")
        spark = self._df.sparkSession
        if len(edges) < 2:
            return DataFrame(spark.createDataFrame([], "breakpoint double, count long" if include_breakpoint else "count long"))
        rows = spark.createDataFrame([(i, e, 0) for i, e in enumerate(edges[1:])], "bin long, breakpoint double, zero long")
        at = F.when(x == edges[0], F.lit(0)).otherwise(F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < x)) - 1)
        d = self._df.where(~F.isnan(x) & (x >= edges[0]) & (x <= edges[-1])).select(at.cast("long").alias("bin")).groupBy("bin").count()
        out = rows.join(d, "bin", "left").select("breakpoint", F.coalesce("count", "zero").alias("count"), F.col("bin").alias(ROW))
        return DataFrame(out if include_breakpoint else out.drop("breakpoint"))


def _operator(name: str) -> Any:
    def method(self: Series, *other: Any) -> Series:
        return self._do(getattr(col(self._name), name)(*[into(o) for o in other]))

    return method


for _n in ("add", "sub", "mul", "truediv", "floordiv", "mod", "pow", "radd", "rsub", "rmul", "rtruediv", "rfloordiv", "rmod", "rpow", "lt", "le", "gt", "ge", "and", "or", "invert", "neg", "eq", "ne"):
    setattr(Series, f"__{_n}__", _operator(f"__{_n}__"))
Series.__hash__ = object.__hash__


class _Accessor:
    def __init__(self, series: Series, accessor: Any):
        self._s, self._a = series, accessor

    def __getattr__(self, what: str) -> Any:
        return lambda *a, **k: self._s._do(getattr(self._a, what)(*a, **k))


__all__ = ["DataFrame", "Series"]
