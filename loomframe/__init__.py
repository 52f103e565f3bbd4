"""loomframe: a strict expression language for Spark DataFrames."""

from __future__ import annotations

import functools
import sys
import uuid
from collections.abc import Callable
from typing import Any

from . import dtypes
from .dtypes import Schema
from .expr import Expr
from .functions import all_, all_horizontal, any_horizontal, coalesce, col, concat_str, corr, cov, exclude, format, len_, list_, lit, max, max_horizontal, mean, mean_horizontal, median, min, min_horizontal, nth, struct, sum, sum_horizontal, when
from .functions import selectors
from .operators.eager import DataFrame, Series
from .operators.frame import GroupBy, LazyFrame, concat
from .sources import from_arrow, from_dict, from_dicts, from_native, from_numpy, get_native_namespace, new_series, read_csv, read_parquet, scan_csv, scan_parquet, to_native

__all__ = ["DataFrame", "Expr", "GroupBy", "LazyFrame", "Schema", "Series", "all_", "all_horizontal", "any_horizontal", "coalesce", "col", "concat", "concat_str", "corr", "cov", "dtypes", "exclude", "format", "framed", "from_arrow", "from_dict", "from_dicts", "from_native", "from_numpy", "generate_temporary_column_name", "get_native_namespace", "is_ordered_categorical", "len_", "list_", "lit", "max", "max_horizontal", "mean", "mean_horizontal", "median", "min", "min_horizontal", "new_series", "nth", "read_csv", "read_parquet", "scan_csv", "scan_parquet", "selectors", "show_versions", "struct", "sum", "sum_horizontal", "to_native", "to_py_scalar", "when"]


def framed(function: Callable[..., Any]) -> Callable[..., Any]:
    """A decorator: Spark DataFrames among the arguments are wrapped, and a frame that comes back is unwrapped."""

    @functools.wraps(function)
    def call(*args: Any, **kwargs: Any) -> Any:
        wrap = lambda x: from_native(x) if hasattr(x, "sparkSession") else x
        return to_native(function(*map(wrap, args), **{k: wrap(v) for k, v in kwargs.items()}))

    return call


def to_py_scalar(value: Any) -> Any:
    """A plain Python value from a one-value series, an Arrow or a NumPy scalar."""
    if isinstance(value, Series):
        return value.item()
    return value.as_py() if hasattr(value, "as_py") else value.item() if hasattr(value, "item") else value


def generate_temporary_column_name(n_bytes: int = 16, columns: Any = ()) -> str:
    while (name := uuid.uuid4().hex[: 2 * n_bytes]) in columns:
        pass
    return name


def is_ordered_categorical(series: Series) -> bool:
    return isinstance(series.dtype, dtypes.Enum)


def show_versions() -> None:
    import pyarrow
    import pyspark

    print(f"python: {sys.version.split()[0]}\npyspark: {pyspark.__version__}\npyarrow: {pyarrow.__version__}")
