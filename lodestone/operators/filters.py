"""Filter documents compiled to predicates.

A compiled predicate may be null where a field is; a filter keeps only rows
for which it is true, so it is left as it is and can be pushed to the scan.
Complements ($ne, $nin, $not, $nor) close it to true or false first.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, functions as F, types as T

from ..functions.errors import EngineError, bad_value
from ..functions.values import Typed, inside, kind_of, kind_of_literal, literal, root, variant_kind

FieldOperator = Callable[[Typed, Any], Column]
_own: dict[str, FieldOperator] = {}

# Type names.
TYPES = {
    "double": (T.DoubleType, T.FloatType),
    "string": (T.StringType,),
    "object": (T.StructType, T.MapType),
    "array": (T.ArrayType,),
    "binData": (T.BinaryType,),
    "undefined": (),
    "objectId": (),
    "bool": (T.BooleanType,),
    "date": (T.TimestampType, T.TimestampNTZType, T.DateType),
    "null": (T.NullType,),
    "regex": (),
    "javascript": (),
    "int": (T.IntegerType, T.ShortType, T.ByteType),
    "timestamp": (),
    "long": (T.LongType,),
    "decimal": (T.DecimalType,),
}
NUMBER = ("int", "long", "double", "decimal")


def register_filter_op(name: str, compiled: FieldOperator) -> None:
    """Add a field operator: called with the typed field and the operand, returns a predicate."""
    if not name.startswith("$"):
        raise bad_value("an operator's name begins with $")
    _own[name] = compiled


def closed(predicate: Column) -> Column:
    return F.coalesce(predicate, F.lit(False))


def negated(predicate: Column) -> Column:
    return ~closed(predicate)


def compile_filter(spec: dict, schema: T.StructType) -> Column:
    """A filter document as a predicate over rows of ``schema``; an empty one matches all."""
    return document(spec, lambda path: root(schema, path))


def document(spec: Any, at: Callable[[str], Typed]) -> Column:
    if not isinstance(spec, dict):
        raise bad_value("a filter must be a document")
    parts = []
    for key, value in spec.items():
        if key in ("$and", "$or", "$nor"):
            if not isinstance(value, (list, tuple)) or not value or not all(isinstance(v, dict) for v in value):
                raise bad_value(f"{key} needs a non-empty array of documents")
            each = [document(v, at) for v in value]
            joined = reduce(lambda a, b: a & b, each) if key == "$and" else reduce(lambda a, b: a | b, each)
            parts.append(negated(joined) if key == "$nor" else joined)
        elif key.startswith("$"):
            raise bad_value(f"unknown top-level operator {key}")
        else:
            parts.append(condition(at(key), value))
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def condition(field: Typed, value: Any) -> Column:
    """What one field must satisfy: a literal, a pattern, or a document of operators."""
    if isinstance(value, re.Pattern):
        return regex(field, value, None)
    if isinstance(value, dict) and any(k.startswith("$") for k in value):
        if not all(k.startswith("$") for k in value):
            raise bad_value("operators and fields can't be mixed in one condition")
        return operators(field, value)
    return eq(field, value)


def operators(field: Typed, spec: dict) -> Column:
    parts = []
    for name, value in spec.items():
        if name == "$options":
            if "$regex" not in spec:
                raise bad_value("$options needs $regex")
            continue
        if name == "$regex":
            parts.append(regex(field, value, spec.get("$options")))
        elif name in _own:
            parts.append(_own[name](field, value))
        elif name in _FIELD:
            parts.append(_FIELD[name](field, value))
        else:
            raise bad_value(f"unknown operator {name}")
    return reduce(lambda a, b: a & b, parts)


# --- leaves ------------------------------------------------------------------


def _any(field: Typed, test: Callable[[Typed], Column], whole: Column | None = None) -> Column:
    """Arrays match by any element or as a whole; other values by themselves."""
    column, kind = field
    if isinstance(kind, T.ArrayType):
        some = F.exists(column, lambda x: closed(test(Typed(x, kind.elementType))))
        return some if whole is None else closed(some) | whole
    if isinstance(kind, T.VariantType):
        inner = F.try_variant_get(column, "$", "array<variant>")
        return closed(test(field)) | closed((variant_kind(column) == "array") & F.exists(inner, lambda x: closed(test(Typed(x, T.VariantType())))))
    return test(field)


def _variant_scalar(column: Column, kind: str) -> Column:
    to = {"number": "double", "string": "string", "bool": "boolean", "date": "timestamp", "binData": "binary"}[kind]
    return F.when(variant_kind(column) == kind, F.try_variant_get(column, "$", to))


def _compare(value: Any, test: Callable[[Column, Column], Column]) -> Callable[[Typed], Column]:
    """A comparison within the literal's bracket; false outside it."""
    kind = kind_of_literal(value)

    def leaf(x: Typed) -> Column:
        if isinstance(x.type, T.VariantType):
            if kind in ("array", "object"):
                return test(F.to_json(x.column), F.to_json(F.parse_json(F.lit(_json(value)))))
            return test(_variant_scalar(x.column, kind), literal(value, T.TimestampType()).column)
        if kind_of(x.type) != kind:
            return F.lit(False)
        other = literal(value, x.type)
        if kind in ("array", "object") and other.type != x.type:
            return test(x.column, other.column.cast(x.type)) if _castable(other.type, x.type) else F.lit(False)
        return test(x.column, other.column)

    return leaf


def _castable(a: T.DataType, b: T.DataType) -> bool:
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return isinstance(a.elementType, T.NullType) or _castable(a.elementType, b.elementType)
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return a.names == b.names and all(_castable(x.dataType, y.dataType) for x, y in zip(a, b, strict=True))
    return isinstance(a, T.NullType) or kind_of(a) == kind_of(b)


def _json(value: Any) -> str:
    import json

    return json.dumps(value, default=str)


def eq(field: Typed, value: Any) -> Column:
    if value is None:
        if isinstance(field.type, T.VariantType):
            return field.column.isNull() | _any(field, lambda x: F.is_variant_null(x.column))
        if isinstance(field.type, T.ArrayType):
            return field.column.isNull() | closed(F.exists(field.column, lambda x: x.isNull()))
        return field.column.isNull()
    test = _compare(value, lambda a, b: a == b)
    whole = test(field) if isinstance(value, (list, tuple)) and isinstance(field.type, T.ArrayType) else None
    return _any(field, test, None if whole is None else closed(whole))


def ne(field: Typed, value: Any) -> Column:
    return negated(eq(field, value))


def _ordered(test: Callable[[Column, Column], Column], equal: bool) -> FieldOperator:
    def compiled(field: Typed, value: Any) -> Column:
        if value is None:  # null is only as large as null
            if not equal:
                return F.lit(False)
            return _any(field, lambda x: F.is_variant_null(x.column) if isinstance(x.type, T.VariantType) else x.column.isNull())
        return _any(field, _compare(value, test))

    return compiled


def within(field: Typed, values: Any) -> Column:
    if not isinstance(values, (list, tuple)):
        raise bad_value("$in needs an array")
    if any(isinstance(v, (re.Pattern, dict)) and (isinstance(v, re.Pattern) or any(k.startswith("$") for k in v)) for v in values):
        raise bad_value("$in takes no patterns or operators")
    known = [v for v in values if v is not None and kind_of_literal(v) not in ("array", "object")]
    odd = [v for v in values if v is not None and kind_of_literal(v) in ("array", "object")]
    parts = [eq(field, None)] if len(known) + len(odd) < len(values) else []
    parts += [eq(field, v) for v in odd]
    kind = field.type.elementType if isinstance(field.type, T.ArrayType) else field.type
    if isinstance(kind, T.VariantType):
        parts += [eq(field, v) for v in known]
    else:
        fit = [literal(v, kind).column for v in known if kind_of_literal(v) == kind_of(kind)]
        if fit:
            parts.append(F.exists(field.column, lambda x: closed(x.isin(*fit))) if isinstance(field.type, T.ArrayType) else field.column.isin(*fit))
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


def exists(field: Typed, value: Any) -> Column:
    if not isinstance(value, bool):
        raise bad_value("$exists needs true or false")
    return field.column.isNotNull() if value else field.column.isNull()


def of_type(field: Typed, names: Any) -> Column:
    names = [names] if isinstance(names, str) else names
    if not isinstance(names, (list, tuple)) or not all(isinstance(n, str) for n in names):
        raise bad_value("$type needs a name or an array of names")
    wanted: set[str] = set()
    for name in names:
        if name != "number" and name not in TYPES:
            raise bad_value(f"unknown type {name}")
        wanted |= set(NUMBER) if name == "number" else {name}

    def leaf(x: Typed) -> Column:
        if isinstance(x.type, T.VariantType):
            kind, shape = variant_kind(x.column), F.schema_of_variant(x.column)
            whole = F.try_variant_get(x.column, "$", "bigint")
            exact = F.when(shape.startswith("DECIMAL") | shape.startswith("DOUBLE") | shape.startswith("FLOAT"), "double").when(whole.between(-(1 << 31), (1 << 31) - 1), "int").otherwise("long")
            return F.when(kind == "number", exact).otherwise(kind).isin(*wanted)
        if isinstance(x.type, T.NullType):
            return F.lit("null" in wanted)
        fits = any(isinstance(x.type, TYPES[n]) for n in wanted if TYPES[n])
        some = x.column.isNotNull() if fits else F.lit(False)
        return some | x.column.isNull() if "null" in wanted else some

    if isinstance(field.type, T.ArrayType):
        inner = F.exists(field.column, lambda x: leaf(Typed(x, field.type.elementType)))
        return closed(inner) | leaf(field)
    return _any(field, leaf)


def regex(field: Typed, pattern: Any, options: str | None) -> Column:
    if isinstance(pattern, re.Pattern):
        flags = "".join(c for c, bit in (("i", re.I), ("m", re.M), ("s", re.S), ("x", re.X)) if pattern.flags & bit)
        pattern, options = pattern.pattern, options or flags
    if not isinstance(pattern, str):
        raise bad_value("$regex needs a pattern")
    if options and not set(options) <= set("imsx"):
        raise bad_value(f"unknown options {options}")
    whole = (f"(?{options})" if options else "") + pattern

    def leaf(x: Typed) -> Column:
        if isinstance(x.type, T.VariantType):
            return _variant_scalar(x.column, "string").rlike(whole)
        return x.column.rlike(whole) if kind_of(x.type) == "string" else F.lit(False)

    return _any(field, leaf)


def every(field: Typed, values: Any) -> Column:
    if not isinstance(values, (list, tuple)):
        raise bad_value("$all needs an array")
    here = field.column.isNotNull()
    return reduce(lambda a, b: a & b, [closed(eq(field, v)) for v in values], here)


def elem_match(field: Typed, spec: Any) -> Column:
    if not isinstance(spec, dict):
        raise bad_value("$elemMatch needs a document")
    if isinstance(field.type, T.VariantType):
        array, kind = F.when(variant_kind(field.column) == "array", F.try_variant_get(field.column, "$", "array<variant>")), T.VariantType()
    elif isinstance(field.type, T.ArrayType):
        array, kind = field.column, field.type.elementType
    else:
        return F.lit(False)
    if spec and all(k.startswith("$") and k not in ("$and", "$or", "$nor") for k in spec):
        return F.exists(array, lambda x: closed(operators(Typed(x, kind), spec)))
    return F.exists(array, lambda x: closed(document(spec, lambda path: inside(Typed(x, kind), path))))


def opposite(field: Typed, spec: Any) -> Column:
    if isinstance(spec, re.Pattern):
        return negated(regex(field, spec, None))
    if not isinstance(spec, dict):
        raise bad_value("$not needs a document or a pattern")
    return negated(operators(field, spec))


_FIELD: dict[str, FieldOperator] = {
    "$eq": eq,
    "$ne": ne,
    "$gt": _ordered(lambda a, b: a > b, False),
    "$gte": _ordered(lambda a, b: a >= b, True),
    "$lt": _ordered(lambda a, b: a < b, False),
    "$lte": _ordered(lambda a, b: a <= b, True),
    "$in": within,
    "$nin": lambda field, values: negated(within(field, values)),
    "$exists": exists,
    "$type": of_type,
    "$all": every,
    "$elemMatch": elem_match,
    "$not": opposite,
}

__all__ = ["EngineError", "compile_filter", "register_filter_op"]
