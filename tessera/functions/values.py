"""Types of the dialect, their Spark counterparts, and what a column accepts."""

from __future__ import annotations

from decimal import Decimal
from typing import Any

from pyspark.sql import types as T

from tessera.errors import TypeMismatch

SPARK = {"INT": T.LongType(), "FLOAT": T.DoubleType(), "TEXT": T.StringType()}
INT_RANGE = range(-(1 << 63), 1 << 63)


def coerced(value: Any, kind: str, column: str) -> Any:
    """The value as the column stores it."""
    if value is None:
        return None
    if kind == "INT" and isinstance(value, (bool, int, float, Decimal)) and value == value and abs(value) != float("inf") and value == int(value):
        whole = int(value)
        if whole in INT_RANGE:
            return whole
        raise TypeMismatch(f"column {column!r} holds 64-bit integers, got {value!r}")
    if kind == "FLOAT" and isinstance(value, (int, float, Decimal)) and not isinstance(value, bool):
        return float(value)
    if kind == "TEXT" and isinstance(value, str):
        return value
    raise TypeMismatch(f"column {column!r} expects {kind}, got {value!r}")


def kind_of(data_type: T.DataType) -> str:
    """INT, FLOAT, TEXT, BOOL, or OTHER for what only attached tables have."""
    if isinstance(data_type, T.IntegralType):
        return "INT"
    if isinstance(data_type, (T.FractionalType,)):
        return "FLOAT"
    if isinstance(data_type, T.StringType):
        return "TEXT"
    return "BOOL" if isinstance(data_type, T.BooleanType) else "OTHER"


def kind_of_value(value: Any) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "BOOL"
    if isinstance(value, int):
        return "INT"
    if isinstance(value, (float, Decimal)):
        return "FLOAT"
    return "TEXT" if isinstance(value, str) else "OTHER"
