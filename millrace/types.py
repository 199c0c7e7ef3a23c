"""The dialect's column types, their Spark types, and strict coercion on write."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import ExecutionError

SPARK = {"INT": T.LongType(), "FLOAT": T.DoubleType(), "TEXT": T.StringType()}
#: Kinds of expressions: the three column types, truth values, a bare NULL, and what only Spark knows.
INT, FLOAT, TEXT, BOOL, NULL, OTHER = "INT", "FLOAT", "TEXT", "BOOL", "NULL", "OTHER"
NUMBERS = (INT, FLOAT, NULL)


class TypeMismatch(ExecutionError, TypeError):
    """A value does not fit its column."""


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INT
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return FLOAT
    if isinstance(data_type, (T.StringType, T.VarcharType, T.CharType)):
        return TEXT
    if isinstance(data_type, T.BooleanType):
        return BOOL
    return NULL if isinstance(data_type, T.NullType) else OTHER


def coerce(value, kind: str, column: str):
    """A Python value as one of column type ``kind``: integral floats become integers, integers floats; nothing else converts."""
    if value is None:
        return None
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if kind == INT and number and (isinstance(value, int) or value.is_integer()):
        if -(2**63) <= value < 2**63:
            return int(value)
        raise TypeMismatch(f"{column}: {value} does not fit 64 bits")
    if kind == FLOAT and number:
        return float(value)
    if kind == TEXT and isinstance(value, str):
        return value
    raise TypeMismatch(f"{column}: {value!r} is not {kind}")


def coerce_column(value: Column, have: str, kind: str, column: str) -> Column:
    """The same for a column expression of kind ``have``."""
    to = SPARK[kind]
    if have in (kind, NULL) or (have, kind) == (INT, FLOAT):
        return value.cast(to)
    if (have, kind) == (FLOAT, INT):
        wrong = F.raise_error(F.concat(F.lit(f"{column}: not integral: "), value.cast("string"))).cast(to)
        return F.when(value.isNull() | (value == F.floor(value)), value.cast(to)).otherwise(wrong)
    raise TypeMismatch(f"{column}: {have} is not {kind}")
