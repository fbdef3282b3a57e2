"""$setWindowFields compiled to window expressions.

With ``partitionBy`` each partition is one window of Spark's.  Without it the
whole table is one partition, which must not meet in one task: rows are dealt
into ranges of the asked order, every range has its own windows, and what lies
before or after a range comes from one row of totals for each range.
"""

from __future__ import annotations

from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.errors import EngineError, bad_value
from ..functions.values import ORDER, Typed, comparable, order_key, quoted, root, sort_columns
from . import accumulators
from .expressions import Scope, compile_expr
from .reshape import set_fields

_RANKS = ("$documentNumber", "$rank")
_FRAMED = ("$sum", "$avg", "$min", "$max", "$first", "$last")
_BEGIN, _END = Window.unboundedPreceding, Window.unboundedFollowing
#: Ranges for each shuffle partition, and sampled keys for each range.  They
#: decide how evenly rows are dealt, never what the result is.
RANGES, SAMPLED = 4, 32


class Field(NamedTuple):
    """One output; bounds are rows from the current one, None if unbounded."""

    path: str
    name: str
    x: Typed | None = None
    lo: int | None = None
    hi: int | None = None

    @property
    def type(self) -> T.DataType:
        if self.x is None:
            return T.IntegerType()
        if self.name == "$sum":
            return accumulators.number(self.x).type
        return T.DoubleType() if self.name == "$avg" else self.x.type

    @property
    def empty(self) -> bool:
        return self.lo is not None and self.hi is not None and self.lo > self.hi

    @property
    def reach(self) -> int:
        """How many rows away from the current one a bound lies."""
        return 0 if self.empty else max(abs(self.lo or 0), abs(self.hi or 0))


def _bound(value: Any) -> int | None:
    if value == "unbounded":
        return None
    if value == "current":
        return 0
    if isinstance(value, bool) or not isinstance(value, int):
        raise bad_value("a window's bounds are whole numbers, current or unbounded")
    return value


def _field(path: str, field: Any, scope: Scope, running: bool) -> Field:
    if not isinstance(field, dict) or not field:
        raise bad_value(f"{path} needs a window operator")
    name, operand = next(iter(field.items()))
    if name in _RANKS:
        return Field(path, name)
    if name not in _FRAMED:
        raise bad_value(f"unknown window operator {name}")
    x = compile_expr(operand, scope)
    window = field.get("window")
    if window is None:
        return Field(path, name, x, None, 0 if running else None)
    if set(window) != {"documents"} or not isinstance(window["documents"], (list, tuple)) or len(window["documents"]) != 2:
        raise bad_value("only windows of documents with two bounds are supported")
    lo, hi = map(_bound, window["documents"])
    if lo is not None and hi is not None and lo > hi + 1:
        raise bad_value("the lower bound lies above the upper bound")
    return Field(path, name, x, lo, hi)


def set_window_fields(df: DataFrame, spec: dict, variables: dict | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """New columns; frames are clamped into their partition, so a frame beyond its edge still holds the edge row."""
    if not isinstance(spec, dict) or not isinstance(spec.get("output"), dict) or not spec["output"]:
        raise bad_value("$setWindowFields needs output")
    schema = df.schema
    scope = Scope(schema, variables)
    by = [quoted(k) for k in keys]
    part = spec.get("partitionBy")
    if isinstance(part, dict) and not (len(part) == 1 and next(iter(part)).startswith("$")):
        by += [comparable(compile_expr(v, scope)) for v in part.values()]
    elif part is not None:
        by.append(comparable(compile_expr(part, scope)))
    sort = [(root(schema, path), way == 1) for path, way in (spec.get("sortBy") or {}).items()]
    fields = [_field(path, field, scope, bool(sort)) for path, field in spec["output"].items()]
    if not by:
        try:
            order = [order_key(value, ascending) for value, ascending in sort]
        except EngineError:  # a descending sort on values without a reversed key: Spark's one window
            by = [F.lit(1)]
        else:
            return _whole_table(df, fields, order)
    sorts = [c for value, ascending in sort for c in sort_columns(value, ascending)]
    rows = Window.partitionBy(*by)
    ordered = rows.orderBy(*sorts, quoted(ORDER).asc())
    place, count = F.row_number().over(ordered), F.count(F.lit(1)).over(rows)
    out = {}
    for f in fields:
        if f.name == "$documentNumber":
            column = place
        elif f.name == "$rank":
            column = F.rank().over(rows.orderBy(*sorts)) if sorts else F.lit(1)
        else:
            column = _framed(f, ordered, place, count)
        out[f.path] = Typed(column, f.type)
    return df.withColumns(set_fields(schema, out))


def _framed(f: Field, ordered, place: Column, count: Column) -> Column:
    if f.empty:
        return F.lit(None).cast(f.type)
    whole = ordered.rowsBetween(_BEGIN, _END)
    column = accumulators.over(f.name, f.x, ordered.rowsBetween(_BEGIN if f.lo is None else f.lo, _END if f.hi is None else f.hi))
    if f.hi is not None and f.hi < 0:
        column = F.when(place + f.hi < 1, accumulators.of_one(f.name, f.x, lambda c: F.first(c).over(whole))).otherwise(column)
    if f.lo is not None and f.lo > 0:
        column = F.when(place + f.lo > count, accumulators.of_one(f.name, f.x, lambda c: F.last(c).over(whole))).otherwise(column)
    return column


# --- the whole table as one partition ------------------------------------------


def _parts(f: Field) -> list[tuple[str, Column]]:
    """What is kept of the rows of a range, so that ranges can be put together."""
    if f.name == "$sum":
        return [("sum", accumulators.number(f.x).column)]
    if f.name == "$avg":
        real = accumulators.number(f.x).column.cast("double")
        return [("sum", real), ("count", real)]
    if f.name in ("$min", "$max"):
        return [(f.name[1:], f.x.column)]
    return [(f.name[1:], F.struct(f.x.column.alias("x")))]


_OVER = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "first": F.first, "last": F.last}
_TOTAL = _OVER | {"first": lambda c: F.min_by(c, "__wk"), "last": lambda c: F.max_by(c, "__wk")}
_MERGED = _OVER | {"count": F.sum}


def _put(kind: str, left: Column, right: Column) -> Column:
    """Two neighbouring stretches of rows as one; null is a stretch without rows or values."""
    if kind in ("sum", "count"):
        return F.coalesce(left + right, left, right)
    if kind in ("min", "max"):
        return (F.least if kind == "min" else F.greatest)(left, right)
    return F.coalesce(left, right) if kind == "first" else F.coalesce(right, left)


def _value(f: Field, parts: list[Column]) -> Column:
    if f.name == "$sum":
        return F.coalesce(parts[0], F.lit(0)).cast(f.type)
    if f.name == "$avg":
        return F.when(parts[1] > 0, parts[0] / parts[1])
    return parts[0]["x"] if f.name in ("$first", "$last") else parts[0]


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _ranges(df: DataFrame, parts: int) -> DataFrame:
    """Adds ``__wb``, the range of each row by its key ``__wk``.

    Borders are taken from keys sampled by hash, about SAMPLED for each range
    whatever the number of rows; the same rows give the same borders again.
    """
    ranges = parts * RANGES
    key, scale = F.col("__wk"), 1 << 40
    rows = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    sample = df.select("__wk").where(F.pmod(F.xxhash64(key), F.lit(scale)) < F.lit(float(scale * ranges * SAMPLED)) / F.greatest(rows, F.lit(1))).distinct()
    keys = sample.agg(F.array_sort(F.collect_list(key)).alias("s"))
    borders = keys.select(F.transform(F.sequence(F.lit(1), F.lit(ranges - 1)), lambda i: F.get("s", _div(i * F.size("s"), F.lit(ranges)).cast("int"))).alias("b")).scalar()
    df = df.withColumns({"__ws": borders, "__wb": F.lit(0)})
    for k in reversed(range(ranges.bit_length())):  # a binary search; one projection a step keeps it in generated code
        above = F.get("__ws", F.col("__wb") + ((1 << k) - 1)) <= key
        df = df.withColumn("__wb", F.col("__wb") + F.when(above, 1 << k).otherwise(0))
    return df.drop("__ws")


def _ranked(df: DataFrame, order: list[Column], parts: int) -> DataFrame:
    """Adds ``__wr``, one more than the rows with a smaller key; equal keys are counted before they are dealt."""
    key = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(order)])
    counts = _ranges(df.groupBy(key.alias("__wk")).agg(F.count(F.lit(1)).alias("__wn")), parts)
    totals = counts.groupBy("__wb").agg(F.sum("__wn").alias("__wt"))
    totals = totals.select("__wb", F.sum("__wt").over(Window.orderBy("__wb").rowsBetween(_BEGIN, -1)).alias("__wt"))
    inside = F.sum("__wn").over(Window.partitionBy("__wb").orderBy("__wk").rowsBetween(_BEGIN, -1))
    ranks = counts.join(totals, "__wb").select(F.col("__wk").alias("__wj"), (F.coalesce("__wt", F.lit(0)) + F.coalesce(inside, F.lit(0)) + 1).alias("__wr"))
    return df.withColumn("__wj", key).join(ranks, "__wj").drop("__wj")


def _whole_table(df: DataFrame, fields: list[Field], order: list[Column]) -> DataFrame:
    schema = df.schema
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out: dict[str, Typed] = {}
    if any(f.name == "$rank" for f in fields) and order:
        df = _ranked(df, order, parts)
    far = {k: f for k, f in enumerate(fields) if f.x is not None and not f.empty and (f.lo is None or f.hi is None)}
    if far or any(f.name == "$documentNumber" or f.reach for f in fields):
        df = df.withColumn("__wk", F.struct(*[k.alias(f"k{i}") for i, k in enumerate(order)], quoted(ORDER).alias("o")))
        df = _along(_ranges(df, parts), far)
    reach = max(f.reach for f in fields)
    if reach:
        df = _blocks(df, reach, parts)
    near = Window.partitionBy("__wx").orderBy("__wp")
    for k, f in enumerate(fields):
        if f.name == "$documentNumber":
            column = F.col("__wp").cast("int")
        elif f.name == "$rank":
            column = F.col("__wr").cast("int") if order else F.lit(1)
        elif f.empty:
            column = F.lit(None).cast(f.type)
        elif k in far and not f.reach:
            column = F.col(f"__wv{k}")
        elif k in far:  # the running value of the row that the bound names
            at = f.hi if f.lo is None else f.lo
            column = _framed(Field(f.path, "$first", Typed(F.col(f"__wv{k}"), f.type), at, at), near, F.col("__wp"), F.col("__wc"))
        elif f.reach:
            column = _framed(f, near, F.col("__wp"), F.col("__wc"))
        else:
            column = accumulators.of_one(f.name, f.x, lambda c: c)
        out[f.path] = Typed(column, f.type)
    if reach:
        df = df.withColumns({f"__wz{k}": t.column for k, t in enumerate(out.values())}).where(F.col("__wx") == F.col("__wo"))
        out = {path: Typed(F.col(f"__wz{k}"), t.type) for k, (path, t) in enumerate(out.items())}
    df = df.withColumns(set_fields(schema, out))
    return df.drop(*[n for n in df.columns if n.startswith("__w")])


def _along(df: DataFrame, far: dict[int, Field]) -> DataFrame:
    """Adds each row's place ``__wp``, the number of rows ``__wc``, and the value of frames that reach to an end of the table and the current row."""
    kept = {(k, j): part for k, f in far.items() for j, part in enumerate(_parts(f))}
    totals = df.groupBy("__wb").agg(F.count(F.lit(1)).alias("__wn"), *[_TOTAL[kind](c).alias(f"__wt{k}_{j}") for (k, j), (kind, c) in kept.items()])
    along = Window.orderBy("__wb")
    before, after, whole = along.rowsBetween(_BEGIN, -1), along.rowsBetween(1, _END), along.rowsBetween(_BEGIN, _END)
    sums = [F.sum("__wn").over(before).alias("__wn"), F.sum("__wn").over(whole).alias("__wc")]
    for (k, j), (kind, _) in kept.items():
        over = whole if far[k].lo is None and far[k].hi is None else before if far[k].lo is None else after
        sums.append(_MERGED[kind](F.col(f"__wt{k}_{j}")).over(over).alias(f"__wt{k}_{j}"))
    df = df.join(totals.select("__wb", *sums), "__wb")
    inside = Window.partitionBy("__wb").orderBy("__wk")
    new = {"__wp": F.row_number().over(inside).cast("bigint") + F.coalesce("__wn", F.lit(0))}
    for k, f in far.items():
        values = []
        for j, (kind, c) in enumerate(_parts(f)):
            rest = F.col(f"__wt{k}_{j}")
            if f.lo is None and f.hi is None:
                values.append(rest)
            elif f.lo is None:
                values.append(_put(kind, rest, _OVER[kind](c).over(inside.rowsBetween(_BEGIN, 0))))
            else:
                values.append(_put(kind, _OVER[kind](c).over(inside.rowsBetween(0, _END)), rest))
        new[f"__wv{k}"] = _value(f, values)
    return df.withColumns(new)


def _blocks(df: DataFrame, reach: int, parts: int) -> DataFrame:
    """Rows in equal blocks ``__wx`` of places, and again in a neighbouring block whose frames reach them; ``__wo`` is a row's own."""
    size = F.greatest(F.lit(reach).cast("bigint"), _div(F.col("__wc"), F.lit(parts * RANGES)) + 1)
    at = F.col("__wp") - 1
    blocks = F.sequence(_div(F.greatest(at - reach, F.lit(0)), size), _div(at + reach, size))
    return df.withColumns({"__wo": _div(at, size), "__wx": F.explode(blocks)})
