"""Projection and reshaping: inclusion, exclusion, computed fields, dotted set and unset."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, functions as F, types as T

from ..functions.errors import bad_value
from ..functions.values import HIDDEN, Typed, quoted, root
from .expressions import Scope, compile_expr


def hidden(schema: T.StructType) -> list[str]:
    return [n for n in schema.names if n.startswith("__")]


def _truth(value: Any) -> bool | None:
    return bool(value) if isinstance(value, (bool, int, float)) else None


def project(spec: dict, schema: T.StructType, variables: dict | None = None) -> list[Column]:
    """Columns of a $project: the kept fields, and the engine's hidden ones."""
    own = [quoted(n) for n in hidden(schema)]
    fields = [f for f in schema.fields if not f.name.startswith("__")]
    scope = Scope(schema, variables)
    meta = {k: v for k, v in spec.items() if isinstance(v, dict) and list(v) == ["$meta"]}
    plain = {k: v for k, v in spec.items() if k not in meta}
    extra = [compile_expr(v, scope).column.alias(k) for k, v in meta.items()]
    rest = {k: v for k, v in plain.items() if k != "_id"}
    computed = any(_truth(v) is None for v in plain.values())
    including = computed or any(_truth(v) for v in rest.values()) or (not rest and _truth(plain.get("_id", 0)) is True)
    if including and any(_truth(v) is False for v in rest.values()):
        raise bad_value("inclusion and exclusion can't be mixed")
    for key, value in plain.items():
        if isinstance(value, dict) and (len(value) != 1 or not next(iter(value)).startswith("$")):
            raise bad_value(f"the projection of {key} must be one operator")
        if isinstance(value, list):
            raise bad_value(f"the projection of {key} can't be an array")
    if not plain:
        return [*map(quoted, (f.name for f in fields if f.name not in meta)), *extra, *own]
    if not including:
        out = []
        for f in fields:
            below = [k.partition(".")[2] for k in plain if k.partition(".")[0] == f.name]
            if f.name in meta or "" in below:
                continue
            out.append(_without(Typed(quoted(f.name), f.dataType), below).alias(f.name) if below else quoted(f.name))
        return [*out, *extra, *own]
    kept: dict[str, Column] = {}
    tree: dict[str, list[str]] = {}
    if "_id" not in plain and "_id" in [f.name for f in fields]:
        kept["_id"] = quoted("_id")
    for key, value in plain.items():
        head, _, below = key.partition(".")
        if _truth(value) is None:
            column = compile_expr(value, scope).column
            for part in reversed(below.split(".") if below else []):
                column = F.struct(column.alias(part))
            kept[head] = column.alias(head)
        elif _truth(value):
            tree.setdefault(head, []).append(below)
    for f in fields:
        if f.name in tree:
            below = tree[f.name]
            kept[f.name] = quoted(f.name) if "" in below else _only(Typed(quoted(f.name), f.dataType), below).alias(f.name)
    first = [f.name for f in fields if f.name in kept]
    return [*(kept[n] for n in first), *(c for n, c in kept.items() if n not in first), *extra, *own]


def _only(value: Typed, paths: list[str]) -> Column:
    column, kind = value
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType)):
        return F.transform(column, lambda x: _only(Typed(x, kind.elementType), paths))
    if not isinstance(kind, T.StructType):
        return F.lit(None).cast(kind)
    parts = []
    for f in kind.fields:
        below = [p.partition(".")[2] for p in paths if p.partition(".")[0] == f.name]
        if below:
            inner = Typed(column.getField(f.name), f.dataType)
            parts.append((inner.column if "" in below else _only(inner, below)).alias(f.name))
    return F.when(column.isNotNull(), F.struct(*parts)) if parts else F.lit(None).cast("struct<>")


def _without(value: Typed, paths: list[str]) -> Column:
    column, kind = value
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: _without(Typed(x, kind.elementType), paths)) if isinstance(kind.elementType, (T.StructType, T.ArrayType)) else column
    if not isinstance(kind, T.StructType):
        return column
    parts = []
    for f in kind.fields:
        below = [p.partition(".")[2] for p in paths if p.partition(".")[0] == f.name]
        if "" in below:
            continue
        inner = Typed(column.getField(f.name), f.dataType)
        parts.append((_without(inner, below) if below else inner.column).alias(f.name))
    return F.when(column.isNotNull(), F.struct(*parts))


def set_path(value: Typed | None, path: list[str], new: Typed) -> Typed:
    """``value`` with ``new`` at a path below it; missing documents and arrays on the way are made."""
    if not path:
        return new
    part, rest = path[0], path[1:]
    if value is not None and isinstance(value.type, T.StructType):
        inner = next((f for f in value.type.fields if f.name == part), None)
        got = set_path(None if inner is None else Typed(value.column.getField(part), inner.dataType), rest, new)
        fields = [Typed(value.column.getField(f.name), f.dataType) if f.name != part else got for f in value.type.fields]
        names = list(value.type.names)
        if inner is None:
            fields, names = [*fields, got], [*names, part]
        return Typed(F.struct(*[x.column.alias(n) for x, n in zip(fields, names, strict=True)]), T.StructType([T.StructField(n, x.type) for x, n in zip(fields, names, strict=True)]))
    if value is not None and isinstance(value.type, T.ArrayType):
        element = value.type.elementType
        if part.isdigit():
            k = int(part)
            got = set_path(Typed(F.get(value.column, F.lit(k)), element), rest, new)
            size = F.greatest(F.coalesce(F.size(value.column), F.lit(0)), F.lit(k + 1))
            return Typed(F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.when(i == k, got.column.cast(element) if got.type != element else got.column).otherwise(F.get(value.column, i))), T.ArrayType(element))
        if isinstance(element, T.StructType) and rest:  # only the first document is entered
            got = set_path(Typed(F.get(value.column, F.lit(0)), element), path, new)
            return Typed(F.transform(value.column, lambda x, i: F.when(i == 0, got.column).otherwise(x)), T.ArrayType(element)) if got.type == element else value
        return value
    if part.isdigit():
        got = set_path(None, rest, new)
        return Typed(F.concat(F.array_repeat(F.lit(None).cast(got.type), int(part)), F.array(got.column)), T.ArrayType(got.type))
    got = set_path(None, rest, new)
    return Typed(F.struct(got.column.alias(part)), T.StructType([T.StructField(part, got.type)]))


def set_fields(schema: T.StructType, new: dict[str, Typed]) -> dict[str, Column]:
    """Columns that put each value at its path; all read the row as it was."""
    out: dict[str, Typed] = {}
    for path, value in new.items():
        head, *rest = path.split(".")
        old = out.get(head)
        if old is None and head in schema.names:
            old = root(schema, head)
        out[head] = set_path(old, rest, value)
    return {k: v.column for k, v in out.items()}


def add_fields(spec: dict, schema: T.StructType, variables: dict | None = None) -> dict[str, Column]:
    if not isinstance(spec, dict) or not spec:
        raise bad_value("$addFields needs a document")
    scope = Scope(schema, variables)
    return set_fields(schema, {k: compile_expr(v, scope) for k, v in spec.items()})


def replace_root(spec: Any, schema: T.StructType, variables: dict | None = None) -> list[Column]:
    if not isinstance(spec, dict) or "newRoot" not in spec:
        raise bad_value("$replaceRoot needs newRoot")
    got = compile_expr(spec["newRoot"], Scope(schema, variables))
    if not isinstance(got.type, T.StructType):
        raise bad_value("newRoot must be a document")
    whole = F.coalesce(got.column, F.raise_error(F.lit("newRoot must be a document")).cast(got.type))
    own = [quoted(n) for n in hidden(schema)]
    return [*[whole.getField(n).alias(n) for n in got.type.names], *own]


__all__ = ["HIDDEN", "add_fields", "project", "replace_root", "set_fields", "set_path"]
