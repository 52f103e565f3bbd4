"""Data types and their Spark counterparts.

A class equals each of its parametrised instances: `Datetime("us") == Datetime`. Unsigned and 128-bit integers live
in the next wider Spark type; Categorical and Enum are strings with a tag in the field's metadata.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from typing import Any

from pyspark.sql import types as T

from .errors import UnsupportedDTypeError


class _Meta(type):
    def __eq__(cls, other: object) -> bool:
        return other is cls or (isinstance(other, DType) and type(other) is cls)

    def __hash__(cls) -> int:
        return hash(cls.__name__)

    def __repr__(cls) -> str:
        return cls.__name__


class DType(metaclass=_Meta):
    """A data type; instances compare by their parameters."""

    def _key(self) -> tuple:
        return tuple(sorted((k, str(v)) for k, v in vars(self).items()))

    def __eq__(self, other: object) -> bool:
        return type(self) is other if isinstance(other, type) else type(self) is type(other) and self._key() == other._key()

    def __hash__(self) -> int:
        return hash(type(self).__name__)

    def __repr__(self) -> str:
        return f"{type(self).__name__}({', '.join(f'{k}={v!r}' for k, v in vars(self).items())})" if vars(self) else type(self).__name__

    @classmethod
    def is_numeric(cls) -> bool:
        return issubclass(cls, NumericType)

    @classmethod
    def is_integer(cls) -> bool:
        return issubclass(cls, IntegerType)

    @classmethod
    def is_signed_integer(cls) -> bool:
        return cls.is_integer() and cls.__name__.startswith("Int")

    @classmethod
    def is_unsigned_integer(cls) -> bool:
        return cls.is_integer() and cls.__name__.startswith("UInt")

    @classmethod
    def is_float(cls) -> bool:
        return issubclass(cls, FloatType)

    @classmethod
    def is_decimal(cls) -> bool:
        return cls is Decimal

    @classmethod
    def is_temporal(cls) -> bool:
        return issubclass(cls, TemporalType)

    @classmethod
    def is_nested(cls) -> bool:
        return issubclass(cls, (List, Array, Struct))

    @classmethod
    def is_boolean(cls) -> bool:
        return cls is Boolean


class NumericType(DType): ...


class IntegerType(NumericType): ...


class FloatType(NumericType): ...


class TemporalType(DType): ...


class Int8(IntegerType): ...


class Int16(IntegerType): ...


class Int32(IntegerType): ...


class Int64(IntegerType): ...


class Int128(IntegerType): ...


class UInt8(IntegerType): ...


class UInt16(IntegerType): ...


class UInt32(IntegerType): ...


class UInt64(IntegerType): ...


class UInt128(IntegerType): ...


class Float16(FloatType): ...


class Float32(FloatType): ...


class Float64(FloatType): ...


class String(DType): ...


class Boolean(DType): ...


class Binary(DType): ...


class Object(DType): ...


class Unknown(DType): ...


class Categorical(DType): ...


class Date(TemporalType): ...


class Time(TemporalType): ...


class Decimal(NumericType):
    def __init__(self, precision: int = 38, scale: int = 0):
        if not 0 <= scale <= precision <= 38:
            raise UnsupportedDTypeError(f"Decimal({precision}, {scale})")
        self.precision, self.scale = precision, scale


class Datetime(TemporalType):
    def __init__(self, time_unit: str = "us", time_zone: str | None = None):
        if time_unit not in ("ns", "us", "ms", "s"):
            raise ValueError(f"time_unit {time_unit!r}")
        self.time_unit, self.time_zone = time_unit, time_zone


class Duration(TemporalType):
    def __init__(self, time_unit: str = "us"):
        if time_unit not in ("ns", "us", "ms", "s"):
            raise ValueError(f"time_unit {time_unit!r}")
        self.time_unit = time_unit


class Enum(DType):
    def __init__(self, categories: Any):
        self.categories = tuple(categories)


class Field:
    def __init__(self, name: str, dtype: Any):
        self.name, self.dtype = name, dtype

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Field) and self.name == other.name and self.dtype == other.dtype

    def __hash__(self) -> int:
        return hash(self.name)

    def __repr__(self) -> str:
        return f"Field({self.name!r}, {self.dtype!r})"


class Struct(DType):
    def __init__(self, fields: Any):
        self.fields = [Field(k, v) for k, v in fields.items()] if isinstance(fields, Mapping) else list(fields)

    def to_schema(self) -> dict[str, Any]:
        return {f.name: f.dtype for f in self.fields}


class List(DType):
    def __init__(self, inner: Any):
        self.inner = inner


class Array(DType):
    def __init__(self, inner: Any, shape: int | tuple[int, ...]):
        sizes = (shape,) if isinstance(shape, int) else tuple(shape)
        self.inner = inner if len(sizes) == 1 else Array(inner, sizes[1:])
        self.shape = sizes

    @property
    def size(self) -> int:
        return self.shape[0]


#: Unsigned and wide integers: Spark type and largest value.
_RANGES = {UInt8: (T.ShortType(), 2**8 - 1), UInt16: (T.IntegerType(), 2**16 - 1), UInt32: (T.LongType(), 2**32 - 1), UInt64: (T.DecimalType(20, 0), 2**64 - 1), UInt128: (T.DecimalType(38, 0), 10**38 - 1)}
_PLAIN = {Int8: T.ByteType, Int16: T.ShortType, Int32: T.IntegerType, Int64: T.LongType, Float16: T.FloatType, Float32: T.FloatType, Float64: T.DoubleType, String: T.StringType, Boolean: T.BooleanType, Binary: T.BinaryType, Date: T.DateType, Categorical: T.StringType, Enum: T.StringType}
_TAG = "loomframe.dtype"


def unsigned_limit(dtype: Any) -> int | None:
    kind = dtype if isinstance(dtype, type) else type(dtype)
    return _RANGES[kind][1] if kind in _RANGES else None


def to_spark(dtype: Any) -> T.DataType:
    """The Spark type for a data type (class or instance); Spark types pass."""
    if isinstance(dtype, T.DataType):
        return dtype
    if dtype in (int, float, str, bool, bytes):
        return {int: T.LongType, float: T.DoubleType, str: T.StringType, bool: T.BooleanType, bytes: T.BinaryType}[dtype]()
    kind = dtype if isinstance(dtype, type) else type(dtype)
    if kind in _PLAIN:
        return _PLAIN[kind]()
    if kind in _RANGES:
        return _RANGES[kind][0]
    if kind is Int128:
        return T.DecimalType(38, 0)
    if kind is Decimal:
        return T.DecimalType(*((dtype.precision, dtype.scale) if isinstance(dtype, Decimal) else (38, 0)))
    if kind is Datetime:
        return T.TimestampType() if isinstance(dtype, Datetime) and dtype.time_zone else T.TimestampNTZType()
    if kind is Duration:
        return T.DayTimeIntervalType()
    if kind is Time and hasattr(T, "TimeType"):
        return T.TimeType(6)
    if isinstance(dtype, (List, Array)):
        return T.ArrayType(to_spark(dtype.inner))
    if isinstance(dtype, Struct):
        return T.StructType([T.StructField(f.name, to_spark(f.dtype)) for f in dtype.fields])
    raise UnsupportedDTypeError(str(dtype))


def from_spark(dtype: T.DataType, metadata: Mapping[str, Any] | None = None, zone: str = "UTC") -> Any:
    """The data type of a Spark type; a field's metadata may tell Categorical, Enum, unsigned or Array."""
    tag = (metadata or {}).get(_TAG)
    if tag == "Categorical":
        return Categorical()
    if tag and tag.startswith("Enum:"):
        return Enum(tag[5:].split("\x1f"))
    if tag:
        return globals()[tag]()
    for kind, spark in _PLAIN.items():
        if kind not in (Float16, Categorical, Enum) and isinstance(dtype, spark):
            return kind()
    if isinstance(dtype, T.DecimalType):
        return Decimal(dtype.precision, dtype.scale)
    if isinstance(dtype, T.TimestampNTZType):
        return Datetime("us")
    if isinstance(dtype, T.TimestampType):
        return Datetime("us", zone)
    if isinstance(dtype, T.DayTimeIntervalType):
        return Duration("us")
    if isinstance(dtype, T.ArrayType):
        return List(from_spark(dtype.elementType, zone=zone))
    if isinstance(dtype, T.StructType):
        return Struct([Field(f.name, from_spark(f.dataType, f.metadata, zone)) for f in dtype.fields])
    return Time() if type(dtype).__name__ == "TimeType" else Unknown()


def metadata_for(dtype: Any) -> dict[str, str]:
    kind = dtype if isinstance(dtype, type) else type(dtype)
    if kind is Enum:
        return {_TAG: "Enum:" + "\x1f".join(dtype.categories)}
    return {_TAG: kind.__name__} if kind is Categorical or kind in _RANGES or kind is Int128 else {}


class Schema(dict):
    """Ordered names and data types."""

    def names(self) -> list[str]:
        return list(self)

    def dtypes(self) -> list[Any]:
        return list(self.values())

    def len(self) -> int:
        return len(self)

    def to_spark(self) -> T.StructType:
        return T.StructType([T.StructField(k, to_spark(v), True, metadata_for(v)) for k, v in self.items()])

    def to_arrow(self) -> Any:
        from pyspark.sql.pandas.types import to_arrow_schema

        return to_arrow_schema(self.to_spark())

    def to_pandas(self) -> dict[str, str]:
        kinds = {"Int": "Int64", "UInt": "UInt64"}
        return {k: "float64" if v.is_float() else "boolean" if v.is_boolean() else next((n for p, n in kinds.items() if v.is_integer() and repr(v).startswith(p)), "object") for k, v in self.items()}

    @classmethod
    def from_spark(cls, schema: T.StructType, zone: str = "UTC") -> Schema:
        return cls({f.name: from_spark(f.dataType, f.metadata, zone) for f in schema.fields})

    def __iter__(self) -> Iterator[str]:
        return super().__iter__()
