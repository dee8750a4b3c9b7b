"""COUNT, SUM, AVG, MIN and MAX over typed columns; partial aggregation is Spark's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.errors import ExecutionError
from tessera.functions.predicates import Typed


def aggregate(func: str, arg: Typed | None, exact: bool = False) -> Typed:
    """exact: integer sums can't overflow (38 digits); otherwise they are 64-bit, as wide as the input allows."""
    if arg is None:
        return Typed(F.count(F.lit(1)), "INT")
    if func == "COUNT":
        return Typed(F.count(arg.column), "INT")
    if func in ("SUM", "AVG"):
        if arg.kind not in ("INT", "FLOAT", "BOOL"):
            raise ExecutionError(f"{func} needs a number, not {arg.kind}")
        column: Column = arg.column.cast("int") if arg.kind == "BOOL" else arg.column
        if func == "AVG":
            return Typed(F.avg(column).cast("double"), "FLOAT")
        if arg.kind == "FLOAT":
            return Typed(F.sum(column), "FLOAT")
        return Typed(F.sum(column.cast("decimal(20,0)") if exact else column), "INT")
    return Typed({"MIN": F.min, "MAX": F.max}[func](arg.column), arg.kind, type=arg.type)
