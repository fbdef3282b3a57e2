"""Aggregation expressions compiled to typed columns.

Results are typed by their operands: arithmetic gives a long unless a double
or decimal takes part, then a double.  Comparison follows the total order in
which null is smallest and values of different brackets differ.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, functions as F, types as T

from ..functions.errors import bad_value
from ..functions.values import SCORE, Typed, comparable, inside, kind_of, literal, null, root

Operator = Callable[[Any, "Scope"], Typed]
_own: dict[str, Operator] = {}
#: Brackets from smallest to largest.
_RANK = {name: k for k, name in enumerate(("null", "number", "string", "object", "array", "binData", "bool", "date"))}


class Scope:
    """What names mean: the row's schema and the variables bound around it."""

    def __init__(self, schema: T.StructType, variables: dict[str, Typed] | None = None):
        self.schema, self.variables = schema, variables or {}

    def visible(self) -> list[T.StructField]:
        return [f for f in self.schema.fields if not f.name.startswith("__")]


def register_expr_op(name: str, compiled: Operator) -> None:
    """Add an expression operator: called with its operand and the scope, returns a typed column."""
    if not name.startswith("$"):
        raise bad_value("an operator's name begins with $")
    _own[name] = compiled


def compile_expr(spec: Any, scope: Scope) -> Typed:
    if isinstance(spec, str) and spec.startswith("$$"):
        return _variable(spec[2:], scope)
    if isinstance(spec, str) and spec.startswith("$"):
        return root(scope.schema, spec[1:])
    if isinstance(spec, dict) and len(spec) == 1 and next(iter(spec)).startswith("$"):
        (name, operand), = spec.items()
        if name == "$literal":
            return literal(operand)
        if name in _own:
            return _own[name](operand, scope)
        if name not in _OPERATORS:
            raise bad_value(f"unknown expression operator {name}")
        return _OPERATORS[name](operand, scope)
    return literal(spec)


def _variable(name: str, scope: Scope) -> Typed:
    head, _, rest = name.partition(".")
    if head in ("ROOT", "CURRENT"):
        fields = scope.visible()
        whole = Typed(F.struct(*[F.col(f"`{f.name}`") for f in fields]), T.StructType(fields))
        return inside(whole, rest) if rest else whole
    if head not in scope.variables:
        raise bad_value(f"undefined variable {head}")
    return inside(scope.variables[head], rest) if rest else scope.variables[head]


def _list(operand: Any, scope: Scope, name: str, least: int = 1, most: int | None = None) -> list[Typed]:
    if not isinstance(operand, (list, tuple)) or len(operand) < least or (most is not None and len(operand) > most):
        raise bad_value(f"{name} needs an array of {least if most == least else f'{least} or more'} expressions")
    return [compile_expr(x, scope) for x in operand]


def truthy(x: Typed) -> Column:
    kind = kind_of(x.type)
    if kind == "null":
        return F.lit(False)
    if kind == "bool":
        return F.coalesce(x.column, F.lit(False))
    if kind == "number":
        return F.coalesce(x.column != 0, F.lit(False))
    return x.column.isNotNull()


def text(x: Typed) -> Column:
    """A value as $concat prints it: whole doubles have no fraction."""
    if isinstance(x.type, (T.DoubleType, T.FloatType)):
        whole = (x.column == F.floor(x.column)) & (F.abs(x.column) < 1e15)
        return F.when(whole, x.column.cast("bigint").cast("string")).otherwise(x.column.cast("string"))
    return x.column.cast("string")


def _is_real(*xs: Typed) -> bool:
    return any(isinstance(x.type, (T.DoubleType, T.FloatType, T.DecimalType)) for x in xs)


def _need_numbers(xs: list[Typed], name: str) -> list[Typed]:
    out = []
    for x in xs:
        if kind_of(x.type) not in ("number", "null", "variant"):
            raise bad_value(f"{name} needs numbers")
        to = T.DoubleType() if _is_real(x) or kind_of(x.type) == "variant" else T.LongType()
        column = F.try_variant_get(x.column, "$", "double") if kind_of(x.type) == "variant" else x.column.cast(to)
        out.append(Typed(F.coalesce(column, F.raise_error(F.lit(f"{name} needs numbers")).cast(to)), to))
    return out


def _concat(operand, scope):
    return Typed(F.concat(*[text(x) for x in _list(operand, scope, "$concat")]), T.StringType())


def _case(name: str, to: Callable[[Column], Column]) -> Operator:
    def compiled(operand, scope):
        x = compile_expr(operand[0] if isinstance(operand, (list, tuple)) and len(operand) == 1 else operand, scope)
        if kind_of(x.type) not in ("string", "null"):
            raise bad_value(f"{name} needs a string")
        return Typed(to(F.coalesce(x.column.cast("string"), F.raise_error(F.lit(f"{name} needs a string")).cast("string"))), T.StringType())

    return compiled


def _multiply(operand, scope):
    xs = _need_numbers(_list(operand, scope, "$multiply", 2), "$multiply")
    to = T.DoubleType() if _is_real(*xs) else T.LongType()
    return Typed(reduce(lambda a, b: a * b, [x.column.cast(to) for x in xs]), to)


def _add(operand, scope):
    xs = _list(operand, scope, "$add")
    if len(xs) == 2 and any(kind_of(x.type) == "string" for x in xs):
        return Typed(F.concat(*[F.coalesce(text(x), F.lit("")) for x in xs]), T.StringType())
    numbers = [x for x in xs if kind_of(x.type) == "number"]
    to = T.DoubleType() if _is_real(*numbers) else T.LongType()
    return Typed(reduce(lambda a, b: a + b, [F.coalesce(x.column.cast(to), F.lit(0).cast(to)) for x in numbers], F.lit(0).cast(to)), to)


def _subtract(operand, scope):
    a, b = _need_numbers(_list(operand, scope, "$subtract", 2, 2), "$subtract")
    to = T.DoubleType() if _is_real(a, b) else T.LongType()
    return Typed(a.column.cast(to) - b.column.cast(to), to)


def _divide(operand, scope):
    a, b = _need_numbers(_list(operand, scope, "$divide", 2, 2), "$divide")
    return Typed(F.when(b.column == 0, F.raise_error(F.lit("$divide by zero")).cast("double")).otherwise(a.column.cast("double") / b.column.cast("double")), T.DoubleType())


def united(a: Typed, b: Typed) -> T.DataType:
    """A type that holds both values."""
    if isinstance(a.type, T.NullType):
        return b.type
    if isinstance(b.type, T.NullType) or a.type == b.type:
        return a.type
    if kind_of(a.type) == kind_of(b.type) == "number":
        return T.DoubleType() if _is_real(a, b) else T.LongType()
    if kind_of(a.type) == kind_of(b.type) and kind_of(a.type) in ("date",):
        return T.TimestampNTZType()
    return T.StringType() if {kind_of(a.type), kind_of(b.type)} <= {"number", "string", "bool", "date"} else T.VariantType()


def _cast(x: Typed, to: T.DataType) -> Column:
    if x.type == to:
        return x.column
    if isinstance(to, T.VariantType):
        return F.to_variant_object(x.column) if kind_of(x.type) in ("object", "array") else F.parse_json(F.to_json(F.struct(x.column.alias("x")))).cast("variant")
    return text(x) if isinstance(to, T.StringType) else x.column.cast(to)


def _cond(operand, scope):
    c, a, b = _list(operand, scope, "$cond", 3, 3)
    to = united(a, b)
    return Typed(F.when(truthy(c), _cast(a, to)).otherwise(_cast(b, to)), to)


def _if_null(operand, scope):
    a, b = _list(operand, scope, "$ifNull", 2, 2)
    to = united(a, b)
    return Typed(F.coalesce(_cast(a, to), _cast(b, to)), to)


def _element(operand, scope):
    a, i = _list(operand, scope, "$arrayElemAt", 2, 2)
    if not isinstance(a.type, T.ArrayType):
        return null()
    index = i.column.cast("int")
    return Typed(F.get(a.column, F.when(index < 0, F.when(F.size(a.column) + index >= 0, F.size(a.column) + index)).otherwise(index)), a.type.elementType)


def _pair(a: Typed, b: Typed) -> tuple[Column, Column] | None:
    """Both values in one comparable type; None if their brackets differ."""
    if isinstance(a.type, T.VariantType) or isinstance(b.type, T.VariantType):
        return comparable(a), comparable(b)
    if kind_of(a.type) != kind_of(b.type):
        return None
    to = united(a, b)
    return (a.column, b.column) if a.type == b.type else (a.column.cast(to), b.column.cast(to))


def _equal(a: Typed, b: Typed) -> Column:
    both = _pair(a, b)
    return both[0].eqNullSafe(both[1]) if both else a.column.isNull() & b.column.isNull()


def _less(a: Typed, b: Typed) -> Column:
    """a < b in the total order: never null."""
    both = _pair(a, b)
    if both is None:
        below = _RANK[kind_of(a.type)] < _RANK[kind_of(b.type)]
        return F.when(a.column.isNull(), b.column.isNotNull()).when(b.column.isNull(), False).otherwise(F.lit(below))
    return F.when(a.column.isNull(), b.column.isNotNull()).otherwise(F.coalesce(both[0] < both[1], F.lit(False)))


def _comparison(name: str, test: Callable[[Typed, Typed], Column]) -> Operator:
    def compiled(operand, scope):
        a, b = _list(operand, scope, name, 2, 2)
        return Typed(test(a, b), T.BooleanType())

    return compiled


def _logic(name: str, join: Callable[[Column, Column], Column], empty: bool) -> Operator:
    def compiled(operand, scope):
        if not isinstance(operand, (list, tuple)):
            raise bad_value(f"{name} needs an array")
        return Typed(reduce(join, [truthy(compile_expr(x, scope)) for x in operand]) if operand else F.lit(empty), T.BooleanType())

    return compiled


def _not(operand, scope):
    inner = operand[0] if isinstance(operand, (list, tuple)) and len(operand) == 1 else operand
    return Typed(~truthy(compile_expr(inner, scope)), T.BooleanType())


def _meta(operand, scope):
    if operand == "textScore":
        if SCORE not in scope.schema.names:
            raise bad_value("textScore needs a text search")
        return root(scope.schema, SCORE)
    if operand == "indexKey":
        return null()
    raise bad_value(f"$meta {operand} is not supported")


_OPERATORS: dict[str, Operator] = {
    "$concat": _concat,
    "$toUpper": _case("$toUpper", F.upper),
    "$toLower": _case("$toLower", F.lower),
    "$multiply": _multiply,
    "$add": _add,
    "$subtract": _subtract,
    "$divide": _divide,
    "$cond": _cond,
    "$ifNull": _if_null,
    "$arrayElemAt": _element,
    "$eq": _comparison("$eq", _equal),
    "$ne": _comparison("$ne", lambda a, b: ~_equal(a, b)),
    "$gt": _comparison("$gt", lambda a, b: _less(b, a)),
    "$gte": _comparison("$gte", lambda a, b: ~_less(a, b)),
    "$lt": _comparison("$lt", _less),
    "$lte": _comparison("$lte", lambda a, b: ~_less(b, a)),
    "$and": _logic("$and", lambda a, b: a & b, True),
    "$or": _logic("$or", lambda a, b: a | b, False),
    "$not": _not,
    "$meta": _meta,
}
