"""Structured Streaming: lazy, row-wise and grouped operators work on a stream as they do on a table."""

from __future__ import annotations

from typing import Any

from pyspark.sql import SparkSession

from ..operators.frame import LazyFrame


def scan_parquet_stream(spark: SparkSession, source: str, schema: Any, **options: Any) -> LazyFrame:
    """A folder of Parquet files as a stream."""
    return LazyFrame(spark.readStream.options(**options).schema(schema).parquet(str(source)))


def with_watermark(frame: LazyFrame, column: str, delay: str) -> LazyFrame:
    return LazyFrame(frame.to_native().withWatermark(column, delay))
