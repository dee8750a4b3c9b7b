"""Predicates as Columns, with the dialect's rules where they differ from Spark's.

Types are known before anything runs, so the rules cost nothing at run time: INT or FLOAT against TEXT is never
equal and never ordered, TRUE and FALSE are 1 and 0 beside numbers, NaN equals nothing and has no order.
Comparisons of a column with a literal stay in the shape that the Parquet reader can push down.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal
from typing import Any, NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.errors import ExecutionError
from tessera.functions.values import INT_RANGE, kind_of_value
from tessera.plans import nodes as n


class Typed(NamedTuple):
    column: Column
    kind: str  # INT FLOAT TEXT BOOL OTHER NULL
    value: Any = None  # of a literal
    literal: bool = False
    type: Any = None  # Spark type of a column


def literal(value: Any) -> Typed:
    kind = kind_of_value(value)
    if kind == "INT" and value not in INT_RANGE:
        return Typed(F.lit(Decimal(value)), "INT", value, True)
    return Typed(F.lit(value), kind, value, True)


def _unknown() -> Column:
    return F.lit(None).cast("boolean")


def _number(x: Typed) -> Typed:
    if x.kind != "BOOL":
        return x
    return literal(int(x.value)) if x.literal else Typed(x.column.cast("int"), "INT")


_OPS: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}


def _can_be_nan(x: Typed) -> bool:
    return x.kind == "FLOAT" and (x.value != x.value if x.literal else True)


def compare(op: str, left: Typed, right: Typed) -> Column:
    if "NULL" in (left.kind, right.kind):
        return _unknown()
    numbers = ("INT", "FLOAT", "BOOL")
    if left.kind in numbers and right.kind in numbers:
        left, right = _number(left), _number(right)
    elif left.kind != right.kind and "OTHER" not in (left.kind, right.kind):
        if op not in ("=", "!="):
            return _unknown()
        return F.when(left.column.isNotNull() & right.column.isNotNull(), F.lit(op == "!="))
    elif left.kind != right.kind:  # a date or the like beside a literal: the literal takes the column's type
        if left.literal and right.type is not None:
            left = left._replace(column=left.column.cast(right.type))
        elif right.literal and left.type is not None:
            right = right._replace(column=right.column.cast(left.type))
    out = _OPS[op](left.column, right.column)
    a, b = _can_be_nan(left), _can_be_nan(right)
    # Spark puts NaN above all numbers and equal to itself; only where that could show is a guard needed.
    guarded = []
    if op in ("=", "!=") and a and b or op in ("<", "<=", ">", ">=") and a and (op[0] == ">" or b):
        guarded.append(left.column)
    if op in ("<", "<=", ">", ">=") and b and (op[0] == "<" or a):
        guarded.append(right.column)
    for column in guarded:
        out = (out | F.isnan(column)) if op == "!=" else (out & ~F.isnan(column))
    return out


def predicate(node: Any, resolve: Callable[[Any], Typed]) -> Column:
    """resolve turns a column or aggregate into its typed expression."""
    if isinstance(node, n.Logic):
        a, b = predicate(node.left, resolve), predicate(node.right, resolve)
        return a & b if node.op == "AND" else a | b
    if isinstance(node, n.Not):
        return ~predicate(node.operand, resolve)
    if isinstance(node, n.Compare):
        sides = [literal(x.value) if isinstance(x, n.Literal) else resolve(x) for x in (node.left, node.right)]
        return compare(node.op, *sides)
    raise ExecutionError(f"not a predicate: {node!r}")
