"""Errors that the library raises."""


class LoomError(Exception):
    """Base of the library's errors."""


class ColumnNotFoundError(LoomError):
    """A column that isn't in the schema."""


class ComputeError(LoomError):
    """A value that can't be computed."""


class ShapeError(LoomError):
    """Lengths that don't go together."""


class MultiOutputExpressionError(LoomError):
    """Several columns where one is asked for."""


class DuplicateError(LoomError):
    """Two output columns with one name."""


class InvalidOperationError(LoomError):
    """An expression that makes no sense where it stands."""


class UnsupportedDTypeError(LoomError):
    """A type that Spark has no place for."""
