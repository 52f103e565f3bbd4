"""Sources: files, streams and in-memory data. Spark's readers give pushdown and pruning; nothing is read eagerly."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame as SparkFrame
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .. import dtypes as dt
from ..operators.eager import DataFrame, Series
from ..operators.frame import ROW, LazyFrame


def scan_parquet(spark: SparkSession, source: str, **options: Any) -> LazyFrame:
    return LazyFrame(spark.read.options(**options).parquet(str(source)))


def scan_csv(spark: SparkSession, source: str, *, separator: str = ",", header: bool = True, infer_schema: bool = True, schema: Any = None, **options: Any) -> LazyFrame:
    """A schema saves the pass over the file that inference takes."""
    reader = spark.read.options(sep=separator, header=header, **options)
    if schema is not None:
        return LazyFrame(reader.schema(schema.to_spark() if isinstance(schema, dt.Schema) else schema).csv(str(source)))
    return LazyFrame(reader.option("inferSchema", infer_schema).csv(str(source)))


def read_parquet(spark: SparkSession, source: str, **options: Any) -> DataFrame:
    return scan_parquet(spark, source, **options).collect()


def read_csv(spark: SparkSession, source: str, *, separator: str = ",", **options: Any) -> DataFrame:
    return scan_csv(spark, source, separator=separator, **options).collect()


def from_arrow(spark: SparkSession, table: Any) -> DataFrame:
    """From a pyarrow table or anything with an Arrow stream."""
    import pyarrow as pa

    if not isinstance(table, pa.Table):
        table = pa.table(table)
    return DataFrame(spark.createDataFrame(table.append_column(ROW, pa.array(range(table.num_rows), pa.int64()))))


def from_dict(spark: SparkSession, data: Mapping[str, Sequence[Any]], schema: Any = None) -> DataFrame:
    import pyarrow as pa

    kinds = dt.Schema(schema).to_arrow() if schema else None
    return from_arrow(spark, pa.table({k: pa.array(list(v), kinds.field(k).type if kinds else None) for k, v in data.items()}))


def from_dicts(spark: SparkSession, data: Iterable[Mapping[str, Any]], schema: Any = None) -> DataFrame:
    rows = list(data)
    names = list(schema) if schema else list(dict.fromkeys(k for r in rows for k in r))
    return from_dict(spark, {n: [r.get(n) for r in rows] for n in names}, schema)


def from_numpy(spark: SparkSession, data: Any, schema: Any = None) -> DataFrame:
    if data.ndim != 2:
        raise ValueError("two dimensions are needed")
    names = list(schema) if schema else [f"column_{i}" for i in range(data.shape[1])]
    return from_dict(spark, {n: data[:, i].tolist() for i, n in enumerate(names)}, schema if isinstance(schema, Mapping) else None)


def new_series(spark: SparkSession, name: str, values: Iterable[Any], dtype: Any = None) -> Series:
    return Series.from_iterable(spark, name, values, dtype)


def from_native(native: Any, *, eager: bool = False) -> Any:
    """Wrap a Spark DataFrame; frames of this library pass."""
    if isinstance(native, (LazyFrame, Series)):
        return native
    if isinstance(native, SparkFrame) or hasattr(native, "sparkSession"):
        return DataFrame(native.withColumn(ROW, F.monotonically_increasing_id())) if eager else LazyFrame(native)
    raise TypeError(f"{type(native).__name__} is no Spark DataFrame")


def to_native(frame: Any) -> Any:
    return frame.to_native() if hasattr(frame, "to_native") else frame


def get_native_namespace(*frames: Any) -> Any:
    """The module whose objects the frames wrap: there is one engine."""
    import pyspark.sql

    for f in frames:
        if not isinstance(to_native(f), SparkFrame):
            raise TypeError(f"{type(f).__name__} is no frame")
    return pyspark.sql
