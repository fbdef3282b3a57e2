"""Typed columns, dotted paths, and the order of values.

A field is a Spark column with its static type.  Missing and null are one
thing for native columns; a VARIANT column tells them apart.
"""

from __future__ import annotations

import datetime
import decimal
import re
from typing import Any, NamedTuple

from pyspark.sql import Column, functions as F, types as T

from .errors import bad_value

#: Hidden columns: natural order, and the score of a text search.
ORDER, SCORE = "__ord", "__score"
HIDDEN = (ORDER, SCORE)


class Typed(NamedTuple):
    column: Column
    type: T.DataType




def null() -> Typed:
    return Typed(F.lit(None), T.NullType())


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def kind_of(kind: T.DataType) -> str:
    """Bracket of a Spark type: values of different brackets never compare in a filter."""
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "date"
    if isinstance(kind, T.BinaryType):
        return "binData"
    if isinstance(kind, T.ArrayType):
        return "array"
    if isinstance(kind, (T.StructType, T.MapType)):
        return "object"
    if isinstance(kind, T.VariantType):
        return "variant"
    return "null"


def kind_of_literal(value: Any) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, (int, float, decimal.Decimal)):
        return "number"
    if isinstance(value, str):
        return "string"
    if isinstance(value, (datetime.datetime, datetime.date)):
        return "date"
    if isinstance(value, (bytes, bytearray)):
        return "binData"
    if isinstance(value, (list, tuple)):
        return "array"
    if isinstance(value, dict):
        return "object"
    raise bad_value(f"a value of type {type(value).__name__} is not supported")


def literal(value: Any, like: T.DataType | None = None) -> Typed:
    """A constant; dates take the type of the column that they meet."""
    kind = kind_of_literal(value)
    if kind == "null":
        return null()
    if kind == "date":
        to = like if like is not None and kind_of(like) == "date" else T.TimestampNTZType()
        return Typed(F.lit(value.isoformat(sep=" ") if isinstance(value, datetime.datetime) else value.isoformat()).cast(to), to)
    if kind == "array":
        inner = like.elementType if isinstance(like, T.ArrayType) else None
        parts = [literal(v, inner) for v in value]
        if not parts:
            to = like if isinstance(like, T.ArrayType) else T.ArrayType(T.StringType())
            return Typed(F.array().cast(to), to)
        to = next((p.type for p in parts if not isinstance(p.type, T.NullType)), T.NullType())
        if kind_of(to) == "number" and any(isinstance(p.type, T.DoubleType) for p in parts):
            to = T.DoubleType()
        return Typed(F.array(*[p.column.cast(to) if not isinstance(to, T.NullType) else p.column for p in parts]), T.ArrayType(to))
    if kind == "object":
        fields = {k: literal(v) for k, v in value.items()}
        return Typed(F.struct(*[t.column.alias(k) for k, t in fields.items()]), T.StructType([T.StructField(k, t.type) for k, t in fields.items()]))
    if kind == "number":
        to = T.DoubleType() if isinstance(value, float) else T.DecimalType(38, max(0, -value.as_tuple().exponent)) if isinstance(value, decimal.Decimal) else T.LongType() if abs(value) >= 1 << 31 else T.IntegerType()
        return Typed(F.lit(value).cast(to), to)
    return Typed(F.lit(value), {"bool": T.BooleanType(), "string": T.StringType(), "binData": T.BinaryType()}[kind])


# --- paths -------------------------------------------------------------------


def root(schema: T.StructType, path: str) -> Typed:
    """Value at a dotted path of the current row."""
    head, _, rest = path.partition(".")
    field = next((f for f in schema.fields if f.name == head), None)
    if field is None:
        return null()
    return inside(Typed(quoted(head), field.dataType), rest)


def inside(value: Typed, path: str) -> Typed:
    """Value at a dotted path below ``value``.

    A number indexes an array; any other part of a path through an array of
    documents collects that field from those that have it, and none is null.
    """
    while path:
        part, _, path = path.partition(".")
        column, kind = value
        if isinstance(kind, T.StructType):
            field = next((f for f in kind.fields if f.name == part), None)
            if field is None:
                return null()
            value = Typed(column.getField(part), field.dataType)
        elif isinstance(kind, T.MapType):
            value = Typed(F.try_element_at(column, F.lit(part)), kind.valueType)
        elif isinstance(kind, T.ArrayType) and part.isdigit():
            value = Typed(F.get(column, F.lit(int(part))), kind.elementType)
        elif isinstance(kind, T.ArrayType):
            return _collected(value, f"{part}.{path}" if path else part)
        elif isinstance(kind, T.VariantType):
            whole = f"{part}.{path}" if path else part
            steps = "".join(f"[{p}]" if p.isdigit() else f"['{p}']" if re.search(r"\W", p) else f".{p}" for p in whole.split("."))
            return Typed(F.try_variant_get(column, "$" + steps, "variant"), T.VariantType())
        else:
            return null()
    return value


def _collected(value: Typed, path: str) -> Typed:
    element = value.type.elementType
    probe = inside(Typed(F.lit(None), element), path).type
    if isinstance(probe, T.NullType):
        return null()
    got = F.filter(F.transform(value.column, lambda x: inside(Typed(x, element), path).column), lambda x: x.isNotNull())
    return Typed(F.when(F.size(got) > 0, got), T.ArrayType(probe))


# --- order -------------------------------------------------------------------


def sort_columns(value: Typed, ascending: bool) -> list[Column]:
    """Sort keys of a value: null first, not-a-number before all numbers; reversed when descending."""
    turn = (lambda c: c.asc_nulls_first()) if ascending else (lambda c: c.desc_nulls_last())
    if isinstance(value.type, (T.DoubleType, T.FloatType)):
        real = F.when(~F.isnan(value.column), value.column)
        return [turn(F.when(value.column.isNotNull(), ~F.isnan(value.column))), turn(real)]
    if isinstance(value.type, T.VariantType):
        return [turn(variant_key(value.column))]
    return [turn(value.column)]


def order_key(value: Typed, ascending: bool) -> Column:
    """A value whose natural order is the asked one, so that it can be part of a struct that is compared as a whole."""
    column, kind = value
    if isinstance(kind, T.VariantType):
        column, kind = variant_key(column), T.StructType()
        if not ascending:
            raise bad_value("a descending sort on mixed types can't be followed by a stage that depends on order")
    some = column.isNotNull()
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        rank = F.when(column.isNull(), 0).when(F.isnan(column), 1).otherwise(2)
        real = F.coalesce(F.when(~F.isnan(column), column), F.lit(0.0))
        return F.struct(rank if ascending else -rank, real if ascending else -real)
    if ascending:
        return F.struct(some, column)
    if isinstance(kind, T.NumericType):
        return F.struct(~some, -column.cast(T.DecimalType(38, kind.scale) if isinstance(kind, T.DecimalType) else T.DecimalType(20, 0)))
    if isinstance(kind, T.BooleanType):
        return F.struct(~some, ~column)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.struct(~some, -F.unix_micros(column.cast("timestamp")))
    if isinstance(kind, T.DateType):
        return F.struct(~some, -F.unix_date(column))
    if isinstance(kind, (T.StringType, T.BinaryType)):  # bytes turned over, and an end that is past all of them
        return F.struct(~some, F.concat(F.translate(F.hex(column), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G")))
    raise bad_value(f"a descending sort on {kind.simpleString()} can't be followed by a stage that depends on order")


def variant_kind(column: Column) -> Column:
    """Bracket of a variant: number, string, object, array, bool, date, binData or null; SQL null if missing."""
    name = F.schema_of_variant(column)
    return (
        F.when(column.isNull(), None)
        .when(name.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)"), "number")
        .when(name.startswith("STRING"), "string")
        .when(name.startswith("OBJECT"), "object")
        .when(name.startswith("ARRAY"), "array")
        .when(name.startswith("BOOLEAN"), "bool")
        .when(name.rlike("^(TIMESTAMP|DATE)"), "date")
        .when(name.startswith("BINARY"), "binData")
        .otherwise("null")
    )


def variant_key(column: Column) -> Column:
    """A comparable form of a variant, in the order null, numbers, strings, objects, arrays, bytes, booleans, dates.

    Objects and arrays are compared by their JSON text.
    """
    kind = variant_kind(column)
    rank = F.when(column.isNull() | (kind == "null"), 1).when(kind == "number", 2).when(kind == "string", 3).when(kind == "object", 4).when(kind == "array", 5).when(kind == "binData", 6).when(kind == "bool", 8).otherwise(9)
    number = F.when(kind == "number", F.try_variant_get(column, "$", "double")).when(kind == "bool", F.try_variant_get(column, "$", "boolean").cast("double"))
    text = F.when(kind == "string", F.try_variant_get(column, "$", "string")).when(kind.isin("object", "array", "date", "binData"), F.to_json(column))
    return F.struct(rank.alias("rank"), number.alias("number"), text.alias("text"))


def comparable(value: Typed) -> Column:
    """A form of the value that can be grouped by and tested for equality."""
    return variant_key(value.column) if isinstance(value.type, T.VariantType) else value.column
