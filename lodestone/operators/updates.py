"""Update documents compiled to column expressions: each operator is a function of the row as it was."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, functions as F, types as T

from ..functions.errors import EngineError, bad_value
from ..functions.values import Typed, inside, kind_of, literal, null, order_key, root
from .expressions import _cast, _equal, _less, united
from .reshape import set_path


class Row:
    """The columns of a document while update operators change it."""

    def __init__(self, schema: T.StructType):
        self.fields = {f.name: root(schema, f.name) for f in schema.fields if not f.name.startswith("__")}

    def get(self, path: str) -> Typed:
        head, _, rest = path.partition(".")
        return inside(self.fields[head], rest) if head in self.fields else null()

    def set(self, path: str, value: Typed) -> None:
        head, *rest = path.split(".")
        old = self.fields.get(head)
        have = self.get(path)
        if not isinstance(have.type, T.NullType) and have.type != value.type:
            to = united(have, value) if kind_of(have.type) != "array" else have.type
            value = Typed(_cast(value, to) if kind_of(value.type) != "array" else value.column.cast(to), to)
        self.fields[head] = set_path(old, rest, value)

    def unset(self, path: str) -> None:
        have = self.get(path)
        if not isinstance(have.type, T.NullType):
            head, *rest = path.split(".")
            gone = Typed(F.lit(None).cast(have.type), have.type)
            if rest and rest[-1].isdigit():
                holder = self.get(path.rpartition(".")[0])
                if isinstance(holder.type, T.ArrayType):
                    k = int(rest[-1])
                    self.set(path.rpartition(".")[0], Typed(F.filter(holder.column, lambda x, i: i != k), holder.type))
                    return
            self.fields[head] = set_path(self.fields[head], rest, gone)


def _array(row: Row, path: str, like: list[Any]) -> Typed:
    """The array at a path; a missing one is empty and takes the type of the operands."""
    have = row.get(path)
    if isinstance(have.type, T.NullType):
        kind = literal(like).type if like else T.ArrayType(T.StringType())
        return Typed(F.array().cast(kind), kind)
    if not isinstance(have.type, T.ArrayType):
        raise bad_value(f"{path} is not an array")
    return Typed(F.coalesce(have.column, F.array().cast(have.type)), have.type)


def _values(values: Any, kind: T.ArrayType) -> Column:
    if not isinstance(values, (list, tuple)):
        raise bad_value("an array is needed")
    return F.array(*[_constant(v, kind.elementType) for v in values]).cast(kind) if values else F.array().cast(kind)


def _constant(value: Any, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType) and isinstance(value, dict):
        return F.struct(*[(_constant(value[f.name], f.dataType) if f.name in value else F.lit(None).cast(f.dataType)).alias(f.name) for f in kind.fields])
    return literal(value, kind).column.cast(kind)


def _number(value: Any, name: str) -> Typed:
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise bad_value(f"{name} needs a number")
    return literal(value)


def _inc(row: Row, path: str, value: Any) -> None:
    n, have = _number(value, "$inc"), row.get(path)
    if kind_of(have.type) not in ("number", "null"):
        raise EngineError("TypeMismatch", f"$inc needs a number at {path}")
    if isinstance(have.type, T.NullType):
        row.set(path, n)
        return
    whole = all(isinstance(x.type, T.IntegerType) for x in (have, n))
    to = T.IntegerType() if whole else T.LongType() if all(isinstance(x.type, (T.LongType, T.IntegerType)) for x in (have, n)) else T.DoubleType()
    row.set(path, Typed(F.when(have.column.isNull(), n.column.cast(to)).otherwise(have.column.cast(to) + n.column.cast(to)), to))


def _mul(row: Row, path: str, value: Any) -> None:
    n, have = _number(value, "$mul"), row.get(path)
    if kind_of(have.type) not in ("number", "null"):
        raise EngineError("TypeMismatch", f"$mul needs a number at {path}")
    if isinstance(have.type, T.NullType):
        row.set(path, literal(0))
        return
    head, *rest = path.split(".")
    product = F.coalesce(have.column.cast("double") * n.column.cast("double"), F.lit(0.0))
    row.fields[head] = set_path(row.fields[head], rest, Typed(product, T.DoubleType()))


def _bound(lower: bool):
    def run(row: Row, path: str, value: Any) -> None:
        have = row.get(path)
        new = literal(value, None if isinstance(have.type, T.NullType) else have.type)
        if isinstance(have.type, T.NullType):
            row.set(path, new)
            return
        to = united(have, new)
        better = _less(new, have) if lower else _less(have, new)
        row.set(path, Typed(F.when(have.column.isNull() | better, _cast(new, to)).otherwise(_cast(have, to)), to))

    return run


def _push(row: Row, path: str, value: Any) -> None:
    modifiers = value if isinstance(value, dict) and any(k.startswith("$") for k in value) else {"$each": [value]}
    each = modifiers.get("$each")
    if not isinstance(each, (list, tuple)):
        raise bad_value("$each needs an array")
    unknown = set(modifiers) - {"$each", "$position", "$sort", "$slice"}
    if unknown:
        raise bad_value(f"unknown modifiers {sorted(unknown)}")
    have = _array(row, path, list(each))
    new, column = _values(each, have.type), have.column
    if "$position" in modifiers:
        at = int(modifiers["$position"])
        place = F.least(F.lit(at), F.size(column)) if at >= 0 else F.greatest(F.size(column) + at, F.lit(0))
        column = F.concat(F.slice(column, F.lit(1), place), new, F.slice(column, place + 1, F.size(column)))
    else:
        column = F.concat(column, new)
    if "$sort" in modifiers:
        column = _sorted(column, have.type, modifiers["$sort"])
    if "$slice" in modifiers:
        n = int(modifiers["$slice"])
        column = F.slice(column, 1, n) if n >= 0 else F.slice(column, F.greatest(F.size(column) + n, F.lit(0)) + 1, F.lit(-n))
    row.set(path, Typed(column, have.type))


def _sorted(column: Column, kind: T.ArrayType, spec: Any) -> Column:
    """Stable: equal keys keep their order."""
    element = kind.elementType
    path, up = (next(iter(spec)), int(next(iter(spec.values()))) > 0) if isinstance(spec, dict) else (None, int(spec) > 0)

    def key(x: Column, i: Column) -> Column:
        value = inside(Typed(x, element), path) if path else Typed(x, element)
        return F.struct((order_key(value, up) if not isinstance(value.type, T.NullType) else F.lit(0)).alias("k"), i.alias("i"), x.alias("x"))

    return F.transform(F.array_sort(F.transform(column, key)), lambda p: p["x"])


def _pull(row: Row, path: str, value: Any) -> None:
    if isinstance(value, dict) and any(k.startswith("$") for k in value):
        raise bad_value("$pull takes a value, not a condition")
    _pull_all(row, path, [value])


def _pull_all(row: Row, path: str, values: Any) -> None:
    have = row.get(path)
    if isinstance(have.type, T.NullType):
        return
    if not isinstance(have.type, T.ArrayType):
        raise bad_value(f"{path} is not an array")
    gone = [Typed(_constant(v, have.type.elementType), have.type.elementType) for v in values if v is None or kind_of(literal(v).type) == kind_of(have.type.elementType)]

    def stays(x: Column) -> Column:
        out = F.lit(True)
        for g in gone:
            out = out & ~_equal(Typed(x, have.type.elementType), g)
        return out

    row.set(path, Typed(F.filter(have.column, stays), have.type))


def _pop(row: Row, path: str, value: Any) -> None:
    if value not in (1, -1):
        raise EngineError("FailedToParse", "$pop needs 1 or -1")
    have = row.get(path)
    if isinstance(have.type, T.NullType):
        return
    if not isinstance(have.type, T.ArrayType):
        raise bad_value(f"{path} is not an array")
    rest = F.greatest(F.size(have.column) - 1, F.lit(0))
    row.set(path, Typed(F.slice(have.column, F.lit(1 if value == 1 else 2), rest), have.type))


def _add_to_set(row: Row, path: str, value: Any) -> None:
    each = value["$each"] if isinstance(value, dict) and "$each" in value else [value]
    have = _array(row, path, list(each))
    column = have.column
    for v in each:
        one = Typed(_constant(v, have.type.elementType), have.type.elementType)
        column = F.when(_has(column, have.type, one), column).otherwise(F.concat(column, F.array(one.column)))
    row.set(path, Typed(column, have.type))


def _has(column: Column, kind: T.ArrayType, one: Typed) -> Column:
    return F.exists(column, lambda x: _equal(Typed(x, kind.elementType), one))


def _rename(row: Row, path: str, value: Any) -> None:
    if not isinstance(value, str):
        raise bad_value("$rename needs a name")
    have = row.get(path)
    if isinstance(have.type, T.NullType):
        return
    there = row.get(value)
    moved = have if isinstance(there.type, T.NullType) else Typed(F.coalesce(have.column, there.column.cast(have.type)), have.type)
    row.set(value, moved)
    row.unset(path)


def _current_date(row: Row, path: str, value: Any) -> None:
    if value is True or value == {"$type": "date"}:
        row.set(path, Typed(F.current_timestamp(), T.TimestampType()))
    elif value == {"$type": "timestamp"}:
        kind = T.StructType([T.StructField("t", T.IntegerType()), T.StructField("i", T.IntegerType())])
        row.set(path, Typed(F.struct(F.unix_timestamp().cast("int").alias("t"), F.lit(1).alias("i")), kind))
    else:
        raise bad_value("$currentDate needs true or a $type")


def _set(row: Row, path: str, value: Any) -> None:
    have = row.get(path)
    if isinstance(have.type, T.NullType):
        row.set(path, literal(value))
    elif value is None:
        row.set(path, Typed(F.lit(None).cast(have.type), have.type))
    elif isinstance(have.type, (T.StructType, T.ArrayType)) and kind_of(literal(value).type) == kind_of(have.type):
        row.set(path, Typed(_constant(value, have.type) if isinstance(have.type, T.StructType) else _values(value, have.type), have.type))
    else:
        row.set(path, literal(value, have.type))


_OPERATORS = {
    "$set": _set,
    "$unset": lambda row, path, value: row.unset(path),
    "$inc": _inc,
    "$mul": _mul,
    "$min": _bound(True),
    "$max": _bound(False),
    "$push": _push,
    "$pull": _pull,
    "$pullAll": _pull_all,
    "$pop": _pop,
    "$addToSet": _add_to_set,
    "$rename": _rename,
    "$currentDate": _current_date,
}


def is_replacement(update: dict) -> bool:
    first = [k.startswith("$") for k in update]
    if any(first) and not all(first):
        raise EngineError("FailedToParse", "an update is all operators or a replacement")
    return not any(first)


def compile_update(update: dict, schema: T.StructType, inserting: bool = False) -> dict[str, Typed]:
    """All fields of the document after the update; ``_id`` must not change."""
    if not isinstance(update, dict):
        raise EngineError("FailedToParse", "an update must be a document")
    row = Row(schema)
    for name, spec in update.items():
        if name == "$setOnInsert":
            if not inserting:
                continue
            name = "$set"
        if name not in _OPERATORS:
            raise EngineError("FailedToParse", f"unknown update operator {name}")
        if not isinstance(spec, dict):
            raise EngineError("FailedToParse", f"{name} needs a document")
        for path, value in spec.items():
            if path == "_id" and not inserting:
                raise EngineError("ImmutableField", "_id can't be changed")
            _OPERATORS[name](row, path, value)
    return row.fields
