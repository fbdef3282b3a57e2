"""Aggregation pipelines: a left fold of stages over a DataFrame.

A frame carries the DataFrame, a hidden column with the natural order of its
rows, and the hidden columns that a per-document sub-pipeline is keyed by.
The order column is an expression over columns that are there anyway; Catalyst
drops it wherever no stage depends on order.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.errors import EngineError, bad_value
from ..functions.values import ORDER, SCORE, Typed, comparable, kind_of, order_key, quoted, root, sort_columns
from ..operators import accumulators, text
from ..operators.expressions import Scope, compile_expr
from ..operators.filters import compile_filter
from ..operators.reshape import add_fields, hidden, project, replace_root, set_fields
from ..operators.windows import set_window_fields


@dataclass(frozen=True)
class Frame:
    """df has the hidden column ORDER; keys: hidden columns of the local documents that a sub-pipeline runs for."""

    df: DataFrame
    keys: tuple[str, ...] = ()
    variables: dict[str, Typed] = field(default_factory=dict)
    sorted: bool = False

    def but(self, df: DataFrame, **changes) -> Frame:
        return replace(self, df=df, **({"sorted": False} | changes))


@dataclass(frozen=True)
class Context:
    """What stages read besides their input: other collections, and the input's text index."""

    collection: Callable[[str], DataFrame]
    text_fields: list[str] | None = None


#: Bytes of input for each partition that documents are gathered in, the most such partitions, and a size that stands for none known.
PART_BYTES, MOST_PARTS, UNKNOWN = 8 << 20, 10_000, 1 << 60

Stage = Callable[[Frame, Any, Context], Frame]
_own: dict[str, Stage] = {}


def register_stage(name: str, run: Stage) -> None:
    if not name.startswith("$"):
        raise bad_value("a stage's name begins with $")
    _own[name] = run


def run(frame: Frame, stages: list[dict], context: Context) -> Frame:
    """All stages, one after another; pairs that are a plain join are run as one."""
    if not isinstance(stages, (list, tuple)):
        raise bad_value("a pipeline is an array of stages")
    for stage in stages:
        if not isinstance(stage, dict) or len(stage) != 1:
            raise bad_value("a stage has exactly one field")
    k = 0
    while k < len(stages):
        (name, spec), = stages[k].items()
        if name == "$lookup" and k + 1 < len(stages):
            joined = _plain_join(frame, spec, stages[k + 1 :], context)
            if joined is not None:
                frame, k = joined, k + 2
                continue
        if name == "$sort" and name not in _own and _unordered(stages[k + 1 :]):
            frame = _sort(frame, spec, context, rows=False)
        elif name in _own:
            frame = _own[name](frame, spec, context)
        elif name in _STAGES:
            frame = _STAGES[name](frame, spec, context)
        else:
            raise EngineError("UnrecognizedPipelineStage", f"unknown stage {name}")
        k += 1
    return frame


def _unordered(after: list[dict]) -> bool:
    """Whether the order of rows is lost before any stage needs it; the hidden order of accumulators does without."""
    for stage in after:
        name = next(iter(stage))
        if name in ("$group", "$count", "$sort"):
            return True
        if name not in ("$match", "$addFields", "$set", "$project", "$unwind", "$setWindowFields"):
            return False
    return False


def output(frame: Frame) -> DataFrame:
    """The frame's documents without hidden columns."""
    return frame.df.drop(*hidden(frame.df.schema))


# --- stages ------------------------------------------------------------------


def _match(frame: Frame, spec: Any, context: Context) -> Frame:
    if not isinstance(spec, dict):
        raise bad_value("$match needs a document")
    search, rest = text.extract(spec)
    df = frame.df
    if search is not None:
        df = df.withColumn(SCORE, text.score(df.schema, context.text_fields, search)).where(quoted(SCORE) > 0)
    return frame.but(df.where(compile_filter(rest, df.schema)) if rest else df, sorted=frame.sorted)


def _project(frame: Frame, spec: Any, context: Context) -> Frame:
    if not isinstance(spec, dict):
        raise bad_value("$project needs a document")
    return frame.but(frame.df.select(*project(spec, frame.df.schema, frame.variables)), sorted=frame.sorted)


def _add_fields(frame: Frame, spec: Any, context: Context) -> Frame:
    return frame.but(frame.df.withColumns(add_fields(spec, frame.df.schema, frame.variables)), sorted=frame.sorted)


def _replace_root(frame: Frame, spec: Any, context: Context) -> Frame:
    return frame.but(frame.df.select(*replace_root(spec, frame.df.schema, frame.variables)), sorted=frame.sorted)


def sort_spec(schema: T.StructType, spec: Any) -> list[tuple[Typed, bool]]:
    if not isinstance(spec, dict) or not spec:
        raise bad_value("a sort needs at least one field")
    out = []
    for path, way in spec.items():
        if isinstance(way, dict):
            if way.get("$meta") != "textScore" or SCORE not in schema.names:
                raise bad_value("a sort by $meta needs a text search")
            out.append((root(schema, SCORE), False))
        else:
            out.append((root(schema, path), way == 1))
    return out


def _sort(frame: Frame, spec: Any, context: Context, rows: bool = True) -> Frame:
    """rows: also put the rows in order, not only their hidden column."""
    keys = [(x, up) for x, up in sort_spec(frame.df.schema, spec) if not isinstance(x.type, T.NullType)]
    df = frame.df
    if not frame.keys and rows:
        df = df.orderBy(*[c for x, up in keys for c in sort_columns(x, up)], quoted(ORDER).asc())
    try:
        order = F.struct(*[order_key(x, up).alias(f"k{i}") for i, (x, up) in enumerate(keys)], quoted(ORDER).alias("o"))
    except EngineError as error:  # raised by the stage that needs the order, if any does
        if frame.keys:
            raise
        order = F.raise_error(F.lit(str(error))).cast("int")
    return frame.but(df.withColumn(ORDER, order), sorted=True)


def _count_of(spec: Any, name: str) -> int:
    if isinstance(spec, bool) or not isinstance(spec, (int, float)) or spec != int(spec) or spec < 0:
        raise bad_value(f"{name} needs a whole number of 0 or more")
    return int(spec)


def _place(frame: Frame) -> Column:
    return F.row_number().over(Window.partitionBy(*map(quoted, frame.keys)).orderBy(quoted(ORDER).asc()))


def _cut(frame: Frame, least: int, most: int | None) -> Frame:
    """Rows after the first ``least``, ``most`` of them."""
    df = frame.df
    if frame.keys:
        df = df.withColumn("__place", _place(frame)).where(F.col("__place") > least)
        if most is not None:
            df = df.where(F.col("__place") <= least + most)
        return frame.but(df.drop("__place"), sorted=frame.sorted)
    df = df if frame.sorted else df.orderBy(quoted(ORDER).asc())
    df = df.offset(least) if least else df
    return frame.but(df if most is None else df.limit(most), sorted=True)


def _skip(frame: Frame, spec: Any, context: Context) -> Frame:
    n = _count_of(spec, "$skip")
    return _cut(frame, n, None) if n else frame


def _limit(frame: Frame, spec: Any, context: Context) -> Frame:
    return _cut(frame, 0, _count_of(spec, "$limit"))


def _count(frame: Frame, spec: Any, context: Context) -> Frame:
    if not isinstance(spec, str) or not spec or spec.startswith("$"):
        raise bad_value("$count needs a name")
    n = F.count(F.lit(1)).cast("int").alias(spec)
    if frame.keys:
        return frame.but(frame.df.groupBy(*map(quoted, frame.keys)).agg(n, F.min(ORDER).alias(ORDER)))
    return frame.but(frame.df.agg(n).withColumn(ORDER, F.struct(F.lit(0))))


def _group(frame: Frame, spec: Any, context: Context) -> Frame:
    if not isinstance(spec, dict) or "_id" not in spec:
        raise bad_value("$group needs _id")
    df, scope = frame.df, Scope(frame.df.schema, {})
    own = spec["_id"]
    if isinstance(own, dict):
        parts = {k: compile_expr(v, scope) for k, v in own.items() if not (isinstance(v, dict) and any(x.startswith("$") for x in v))}
        if len(parts) < len(own) or not parts:
            raise bad_value("a compound _id holds field paths and literals")
        keys = {f"__k{i}": comparable(x) for i, x in enumerate(parts.values())}
        result = F.struct(*[quoted(f"__k{i}").alias(n) for i, n in enumerate(parts)])
        originals = dict(zip(keys, parts.values(), strict=True))
    else:
        x = compile_expr(own, scope)
        column = x.column.cast("int") if isinstance(x.type, T.NullType) else comparable(x)
        keys, result, originals = {"__k0": column}, quoted("__k0"), {"__k0": x}
    aggregates = []
    for name, value in spec.items():
        if name == "_id":
            continue
        if not isinstance(value, dict) or len(value) != 1:
            raise bad_value(f"{name} needs one accumulator")
        (operator, operand), = value.items()
        aggregates.append(accumulators.accumulate(operator, compile_expr(operand, scope), quoted(ORDER)).alias(name))
    mixed = [k for k, x in originals.items() if isinstance(x.type, T.VariantType)]
    aggregates += [F.first(originals[k].column).alias(k + "v") for k in mixed]
    grouped = df.groupBy(*map(quoted, frame.keys), *[c.alias(k) for k, c in keys.items()]).agg(*aggregates, F.min(ORDER).alias(ORDER))
    if mixed:
        result = F.struct(*[quoted(k + "v" if k in mixed else k).alias(n) for k, n in zip(keys, own, strict=True)]) if isinstance(own, dict) else quoted("__k0v")
    names = [n for n in spec if n != "_id"]
    return frame.but(grouped.select(result.alias("_id"), *map(quoted, names), *map(quoted, frame.keys), quoted(ORDER)))


def _unwind(frame: Frame, spec: Any, context: Context) -> Frame:
    path, keep = (spec, False) if isinstance(spec, str) else (spec.get("path"), bool(spec.get("preserveNullAndEmptyArrays"))) if isinstance(spec, dict) else (None, False)
    if not isinstance(path, str) or not path.startswith("$"):
        raise bad_value("$unwind needs a path that begins with $")
    path, df = path[1:], frame.df
    value = root(df.schema, path)
    if isinstance(value.type, T.VariantType):
        array = F.when(F.schema_of_variant(value.column).startswith("ARRAY"), F.try_variant_get(value.column, "$", "array<variant>")).when(value.column.isNotNull() & ~F.is_variant_null(value.column), F.array(value.column))
        value = Typed(array, T.ArrayType(T.VariantType()))
    if not isinstance(value.type, T.ArrayType):
        return frame if keep else frame.but(df.where(value.column.isNotNull()), sorted=frame.sorted)
    rows = df.select("*", (F.posexplode_outer if keep else F.posexplode)(value.column).alias("__at", "__one"))
    put = set_fields(df.schema, {path: Typed(quoted("__one"), value.type.elementType)}) if "." in path else {path: quoted("__one")}
    order = F.struct(quoted(ORDER).alias("o"), quoted("__at").alias("p"))
    return frame.but(rows.withColumns(put | {ORDER: order}).drop("__at", "__one"), sorted=frame.sorted)


def _window(frame: Frame, spec: Any, context: Context) -> Frame:
    return frame.but(set_window_fields(frame.df, spec, frame.variables, frame.keys))


# --- lookup ------------------------------------------------------------------


def _lookup_parts(spec: Any) -> tuple[str, str, str | None, str | None, dict, list | None]:
    if not isinstance(spec, dict) or not isinstance(spec.get("from"), str):
        raise bad_value("$lookup 'from' must be a string")
    if not isinstance(spec.get("as"), str):
        raise bad_value("$lookup 'as' must be a string")
    local, foreign = (spec.get(k) if isinstance(spec.get(k), str) else None for k in ("localField", "foreignField"))
    if (local is None) != (foreign is None):
        raise bad_value("$lookup requires both 'localField' and 'foreignField' or neither")
    if not isinstance(spec.get("let", {}), dict):
        raise bad_value("$lookup 'let' must be a document")
    if "pipeline" in spec and not isinstance(spec["pipeline"], (list, tuple)):
        raise bad_value("$lookup 'pipeline' must be an array")
    if local is None and "pipeline" not in spec:
        raise bad_value("$lookup requires either 'localField'/'foreignField' or 'pipeline'")
    return spec["from"], spec["as"], local, foreign, spec.get("let", {}), spec.get("pipeline")


def _same(a: Typed, b: Typed) -> tuple[Column, Column]:
    """Both keys in one comparable type; null equals null."""
    if isinstance(a.type, T.VariantType) or isinstance(b.type, T.VariantType):
        as_key = lambda x: comparable(x if isinstance(x.type, T.VariantType) else Typed(F.parse_json(F.to_json(x.column)) if kind_of(x.type) in ("object", "array") else F.to_variant_object(F.array(x.column)), T.VariantType()))
        return as_key(a), as_key(b)
    if kind_of(a.type) != kind_of(b.type) and "null" not in (kind_of(a.type), kind_of(b.type)):
        return a.column, F.lit(None).cast(a.type)
    if isinstance(a.type, T.NullType):
        return F.lit(None).cast(b.type), b.column
    if isinstance(b.type, T.NullType):
        return a.column, F.lit(None).cast(a.type)
    if a.type != b.type and kind_of(a.type) == "number":
        to = T.DoubleType() if any(isinstance(x.type, (T.DoubleType, T.FloatType, T.DecimalType)) for x in (a, b)) else T.LongType()
        return a.column.cast(to), b.column.cast(to)
    return a.column, b.column


def _unsigned(key: Column, other: Column, df: DataFrame) -> Column:
    """The key with one zero for both, as joins see it; ``other`` has its type, over df."""
    return key + F.lit(0.0).cast(kind) if isinstance(kind := df.select(other).schema[0].dataType, (T.DoubleType, T.FloatType)) else key


def _parts(*inputs: DataFrame) -> int | None:
    """Partitions for what is gathered from these inputs, so that a task's rows don't grow with them; None: few enough as planned.

    Their files' size counts, whatever the number of shuffle partitions.
    """
    spark, size = inputs[0].sparkSession, 0
    for df in inputs:
        leaves = df._jdf.queryExecution().analyzed().collectLeaves()
        sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
        size += sum(n for n in sizes if n < UNKNOWN)
    parts = min(-(-size // PART_BYTES), MOST_PARTS)
    return max(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))) if parts > spark.sparkContext.defaultParallelism else None


def _documents(df: DataFrame) -> Typed:
    fields = [f for f in df.schema.fields if not f.name.startswith("__")]
    return Typed(F.struct(*[quoted(f.name) for f in fields]), T.StructType(fields))


def _nested(right: Frame, by: list[str], name: str) -> DataFrame:
    """The right side's documents, gathered by key in their order."""
    docs = accumulators.in_order(_documents(right.df), quoted(ORDER)).alias(name)
    return right.df.groupBy(*map(quoted, by)).agg(docs) if by else right.df.agg(docs)


def _attach(frame: Frame, gathered: DataFrame, on: Column | None, name: str, drop: list[str], empty: Column | None = None) -> Frame:
    df = frame.df.join(gathered, on, "left") if on is not None else frame.df.crossJoin(gathered)
    kind = gathered.schema["__as"].dataType
    value = F.coalesce(quoted("__as"), F.array().cast(kind) if empty is None else empty)
    put = set_fields(frame.df.schema, {name: Typed(value, kind)})
    return frame.but(df.withColumns(put).drop("__as", *drop))


def _lookup(frame: Frame, spec: Any, context: Context) -> Frame:
    source, name, local, foreign, let, pipeline = _lookup_parts(spec)
    right = context.collection(source)
    inner = Context(context.collection)
    scope = Scope(frame.df.schema, frame.variables)
    bound = {v: compile_expr(e, scope) for v, e in let.items()}
    stages = list(pipeline or [])
    used = {v: x for v, x in bound.items() if f"$${v}" in json.dumps(stages, default=str)}
    depth = sum(n.startswith("__key") for n in frame.df.columns)
    key = f"__key{depth}_"
    left = root(frame.df.schema, local) if local else None
    # Documents that a sub-pipeline turns nothing into, for local documents without a match.
    empty = F.array(F.struct(F.lit(0).alias(stages[-1]["$count"]))) if stages and "$count" in stages[-1] else None
    if left is not None and isinstance(left.type, T.ArrayType):
        # One row for each local document and distinct element, then for each pair of documents: as a foreign document
        # has one key, it meets a local document once, and no pair needs to be sought out and dropped.
        other = root(right.schema, foreign)
        b = _same(Typed(F.lit(None).cast(left.type.elementType), left.type.elementType), other)[1]
        wanted = F.array_distinct(F.transform(left.column, lambda x: _unsigned(_same(Typed(x, left.type.elementType), other)[0], b, right)))
        each = frame.df.groupBy(quoted(ORDER).alias(key)).agg(F.array_distinct(F.flatten(F.collect_set(wanted))).alias("__want"), *[F.first(x.column).alias(f"{key}{v}") for v, x in used.items()])
        pairs = each.withColumn("__want", F.explode("__want"))
        found = pairs.join(right.withColumn("__has", b), quoted("__want").eqNullSafe(quoted("__has"))).drop("__want", "__has")
        parts = _parts(frame.df, right)
        found = found.repartition(parts, quoted(key)) if parts else found
        variables = {v: Typed(quoted(f"{key}{v}"), x.type) for v, x in used.items()}
        got = run(Frame(found, (key, *[f"{key}{v}" for v in used]), variables), stages, inner)
        gathered = _nested(got, [key], "__as").withColumnRenamed(key, key + "r")
        return _attach(frame, gathered, quoted(ORDER) == quoted(key + "r"), name, [key + "r"], empty)
    if not used:
        if left is None:
            got = run(Frame(right), stages, inner)
            return _attach(frame, _nested(got, [], "__as"), None, name, [])
        a, b = _same(left, root(right.schema, foreign))
        got = run(Frame(right.withColumn(key, b), (key,)), stages, inner) if stages else Frame(right.withColumn(key, b))
        gathered = _nested(got, [key], "__as")
        return _attach(frame, gathered, a.eqNullSafe(quoted(key)), name, [key], empty)
    # Variables: the sub-pipeline runs once for each distinct key and set of values.
    names = [f"{key}{v}" for v in used]
    values = [x.column.alias(n) for n, x in zip(names, used.values(), strict=True)]
    if left is None:
        wanted = frame.df.select(*values).distinct()
        found = wanted.crossJoin(right)
        ons = [x.column.eqNullSafe(quoted(n + "r")) for n, x in zip(names, used.values(), strict=True)]
    else:
        a, b = _same(left, root(right.schema, foreign))
        names = [key, *names]
        wanted = frame.df.select(a.alias(key), *values).distinct()
        found = wanted.join(right.withColumn("__has", b), quoted(key).eqNullSafe(quoted("__has"))).drop("__has")
        ons = [a.eqNullSafe(quoted(key + "r")), *[x.column.eqNullSafe(quoted(n + "r")) for n, x in zip(names[1:], used.values(), strict=True)]]
    variables = {v: Typed(quoted(f"{key}{v}"), x.type) for v, x in used.items()}
    got = run(Frame(found, tuple(names), variables), stages, inner)
    gathered = _nested(got, names, "__as")
    for n in names:
        gathered = gathered.withColumnRenamed(n, n + "r")
    on = ons[0]
    for more in ons[1:]:
        on = on & more
    return _attach(frame, gathered, on, name, [n + "r" for n in names], empty)


def _plain_join(frame: Frame, spec: Any, after: list[dict], context: Context) -> Frame | None:
    """$lookup with the stage after it as one join, where that gives the same documents."""
    if not isinstance(spec, dict) or spec.get("let") or frame.keys:
        return None
    source, name, local, foreign, _, stages = _lookup_parts(spec)
    if local is None:
        return None
    left = root(frame.df.schema, local)
    if stages:
        return _joined_pipeline(frame, name, left, foreign, context.collection(source), stages, after, context)
    if isinstance(left.type, T.ArrayType) or "." in name:
        return None
    (stage, value), = after[0].items()
    right = context.collection(source)
    a, b = _same(left, root(right.schema, foreign))
    documents = _documents(right)
    if stage == "$unwind":
        path, keep = (value, False) if isinstance(value, str) else (value.get("path"), bool(value.get("preserveNullAndEmptyArrays")))
        if path != f"${name}":
            return None
        other = right.select(b.alias("__has"), documents.column.alias("__one"), quoted(ORDER).alias("__at"))
        df = frame.df.join(other, a.eqNullSafe(quoted("__has")), "left" if keep else "inner")
        order = F.struct(quoted(ORDER).alias("o"), quoted("__at").alias("p"))
        return frame.but(df.withColumns({name: quoted("__one"), ORDER: order}).drop("__has", "__one", "__at"))
    if stage == "$match" and value in ({name: []}, {name + ".0": {"$exists": True}}):
        anti = value == {name: []}
        if not anti and not _dead(name, after[1:]):
            return None
        df = frame.df.join(right.select(b.alias("__has")), a.eqNullSafe(quoted("__has")), "left_anti" if anti else "left_semi")
        return frame.but(df.withColumn(name, F.array().cast(T.ArrayType(documents.type))))
    return None


def _unwound(name: str, after: dict) -> bool | None:
    """Whether a stage unwinds the field and keeps documents without elements; None for other stages."""
    (stage, value), = after.items()
    if stage != "$unwind":
        return None
    path, keep = (value, False) if isinstance(value, str) else (value.get("path"), bool(value.get("preserveNullAndEmptyArrays"))) if isinstance(value, dict) else (None, False)
    return keep if path == f"${name}" else None


def _joined_pipeline(frame: Frame, name: str, left: Typed, foreign: str, right: DataFrame, stages: list[dict], after: list[dict], context: Context) -> Frame | None:
    """$lookup with a sub-pipeline, and the $unwind after it: the sub-pipeline's documents are joined, never gathered."""
    keep = _unwound(name, after[0])
    if keep is None or isinstance(left.type, T.ArrayType) or "." in name or "$count" in stages[-1]:
        return None
    key = f"__key{sum(n.startswith('__key') for n in frame.df.columns)}_"
    a, b = _same(left, root(right.schema, foreign))
    got = run(Frame(right.withColumn(key, b), (key,)), stages, Context(context.collection))
    other = got.df.select(quoted(key), _documents(got.df).column.alias("__one"), quoted(ORDER).alias("__at"))
    df = frame.df.join(other, a.eqNullSafe(quoted(key)), "left" if keep else "inner")
    order = F.struct(quoted(ORDER).alias("o"), quoted("__at").alias("p"))
    return frame.but(df.withColumns({name: quoted("__one"), ORDER: order}).drop(key, "__one", "__at"))


def _dead(name: str, after: list[dict]) -> bool:
    """Whether no later stage sees the field."""
    if not after:
        return False
    (stage, value), = after[0].items()
    if stage == "$count":
        return True
    if stage in ("$group", "$project"):
        if f'"${name}' in json.dumps(value, default=str):
            return False
        return stage == "$group" or value.get(name) in (0, False) or (name not in value and any(v in (1, True) or isinstance(v, (str, dict)) for k, v in value.items() if k != "_id"))
    return False


_STAGES: dict[str, Stage] = {
    "$match": _match,
    "$project": _project,
    "$sort": _sort,
    "$skip": _skip,
    "$limit": _limit,
    "$count": _count,
    "$group": _group,
    "$unwind": _unwind,
    "$lookup": _lookup,
    "$addFields": _add_fields,
    "$set": _add_fields,
    "$replaceRoot": _replace_root,
    "$setWindowFields": _window,
}
