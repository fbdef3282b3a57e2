"""Accumulators, shared by $group and $setWindowFields.

Ordered ones ($first, $last, $push, $addToSet) take the frame's order column,
so that they are plain aggregates with partial results and need no sort of
the input.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from ..functions.errors import bad_value
from ..functions.values import Typed, kind_of, variant_key

GROUP = ("$sum", "$avg", "$min", "$max", "$first", "$last", "$push", "$addToSet")


def number(x: Typed) -> Typed:
    """The numeric value that sums and means see; null for anything else."""
    if kind_of(x.type) == "variant":
        return Typed(F.try_variant_get(x.column, "$", "double"), T.DoubleType())
    if kind_of(x.type) != "number":
        return Typed(F.lit(None).cast("bigint"), T.LongType())
    real = isinstance(x.type, (T.DoubleType, T.FloatType, T.DecimalType))
    return Typed(x.column.cast("double" if real else "bigint"), T.DoubleType() if real else T.LongType())


def _orderable(kind: T.DataType) -> bool:
    if isinstance(kind, (T.VariantType, T.MapType)):
        return False
    if isinstance(kind, T.ArrayType):
        return _orderable(kind.elementType)
    return all(_orderable(f.dataType) for f in kind.fields) if isinstance(kind, T.StructType) else True


def in_order(x: Typed, order: Column) -> Column:
    """All values of a group, nulls included, in input order."""
    pairs = F.collect_list(F.struct(order.alias("o"), x.column.alias("x")))
    if _orderable(x.type):
        sorted_pairs = F.array_sort(pairs)
    else:
        sorted_pairs = F.array_sort(pairs, lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0))
    return F.transform(sorted_pairs, lambda p: p["x"])


def accumulate(name: str, x: Typed, order: Column) -> Column:
    """One accumulator as an aggregate."""
    if name == "$sum":
        n = number(x)
        return F.coalesce(F.sum(n.column), F.lit(0).cast(n.type))
    if name == "$avg":
        return F.avg(number(x).column.cast("double"))
    if name in ("$min", "$max"):
        if kind_of(x.type) == "variant":
            some = F.when(F.is_variant_null(x.column), None).otherwise(x.column)
            return (F.min_by if name == "$min" else F.max_by)(some, F.when(some.isNotNull(), variant_key(some)))
        return (F.min if name == "$min" else F.max)(x.column)
    if name in ("$first", "$last"):
        return (F.min_by if name == "$first" else F.max_by)(F.struct(x.column.alias("x")), order)["x"]
    if name == "$push":
        return in_order(x, order)
    if name == "$addToSet":
        return F.array_distinct(in_order(x, order))
    raise bad_value(f"unknown accumulator {name}")


def over(name: str, x: Typed, frame) -> Column:
    """One accumulator over a window frame."""
    if name == "$sum":
        n = number(x)
        return F.coalesce(F.sum(n.column).over(frame), F.lit(0).cast(n.type))
    if name == "$avg":
        return F.avg(number(x).column.cast("double")).over(frame)
    if name in ("$min", "$max"):
        return (F.min if name == "$min" else F.max)(x.column).over(frame)
    if name in ("$first", "$last"):
        return (F.first if name == "$first" else F.last)(x.column).over(frame)
    raise bad_value(f"unknown window operator {name}")


def of_one(name: str, x: Typed, at) -> Column:
    """What the accumulator gives for the single value ``at`` (a function of a column, for the edge row of a frame)."""
    if name == "$sum":
        n = number(x)
        return F.coalesce(at(n.column), F.lit(0).cast(n.type))
    return at(number(x).column.cast("double")) if name == "$avg" else at(x.column)
