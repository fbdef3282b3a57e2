"""Collections and databases: the engine's entry points.

A collection is a DataFrame with a natural order.  Reads build a plan and
return a DataFrame; writes return counts and leave a new version of the
DataFrame behind, the old one stays as it was.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.errors import EngineError, bad_value
from ..functions.values import ORDER, SCORE, Typed, kind_of, literal, quoted, root, sort_columns
from ..operators import text
from ..operators.expressions import _cast, united
from ..operators.filters import closed, compile_filter
from ..operators.reshape import project
from ..operators.updates import compile_update, is_replacement
from . import pipeline
from .pipeline import Context, Frame

EMPTY = T.StructType([T.StructField("_id", T.StringType())])
#: Documents in a cursor's first batch, unless it says otherwise.
FIRST_BATCH = 101


@dataclass
class Index:
    """Metadata only: plans never use it; unique ones are checked on writes."""

    name: str
    keys: dict[str, Any]
    unique: bool = False
    sparse: bool = False
    partial: dict | None = None
    expire_after: float | None = None

    @property
    def kind(self) -> str:
        kinds = [v for v in self.keys.values() if isinstance(v, str)]
        return kinds[0] if kinds else "compound" if len(self.keys) > 1 else "single"


@dataclass
class WriteResult:
    matched: int = 0
    modified: int = 0
    inserted: int = 0
    deleted: int = 0
    upserted_id: Any = None
    errors: list[dict] = field(default_factory=list)


@contextmanager
def deadline(spark: SparkSession, max_time_ms: int | None):
    """Jobs started inside are cancelled after ``max_time_ms``; 0 or None: never."""
    if max_time_ms is None:
        max_time_ms = 0
    if isinstance(max_time_ms, bool) or not isinstance(max_time_ms, (int, float)):
        raise bad_value("maxTimeMS must be a number")
    if not 0 <= max_time_ms <= (1 << 31) - 1:
        raise bad_value("maxTimeMS is out of range")
    if not max_time_ms:
        yield
        return
    sc, tag, late, done = spark.sparkContext, uuid.uuid4().hex, threading.Event(), threading.Event()

    def cancel() -> None:
        if done.wait(max_time_ms / 1000):
            return
        late.set()
        sc.cancelJobsWithTag(tag)
        while not done.wait(0.1):  # a job may start only now, after a long planning
            sc.cancelJobsWithTag(tag)

    watch = threading.Thread(target=cancel, daemon=True)
    sc.addJobTag(tag)
    watch.start()
    try:
        yield
    except Exception as error:
        if late.is_set() and not isinstance(error, EngineError):
            raise EngineError("MaxTimeMSExpired", "operation exceeded time limit") from error
        raise
    finally:
        done.set()
        watch.join()
        sc.removeJobTag(tag)
    if late.is_set():
        raise EngineError("MaxTimeMSExpired", "operation exceeded time limit")


class Cursor:
    """Documents in batches; rows come to the driver one partition at a time."""

    def __init__(self, df: DataFrame, batch_size: int = FIRST_BATCH, max_time_ms: int | None = None):
        self.id, self.batch_size, self._spark = uuid.uuid4().hex, batch_size, df.sparkSession
        self._left = max_time_ms
        with deadline(self._spark, max_time_ms):
            pass
        self._rows: Iterator | None = df.toLocalIterator(prefetchPartitions=False)

    def next_batch(self, size: int | None = None) -> list[dict]:
        if self._rows is None:
            raise EngineError("CursorNotFound", f"cursor {self.id} is closed")
        out, begin = [], time.monotonic()
        with deadline(self._spark, self._left):
            for row in self._rows:
                out.append(row.asDict(recursive=True))
                if len(out) >= (size or self.batch_size):
                    break
        if self._left:  # the time that batches take counts together
            self._left = max(1, self._left - int(1000 * (time.monotonic() - begin)))
        return out

    def kill(self) -> None:
        self._rows = None


class Collection:
    """``order``: columns whose values are unique and give the natural order; without them ``_id``."""

    def __init__(self, database: Database, name: str, df: DataFrame, order: list[str] | None = None):
        self.database, self.name, self._df, self._first = database, name, df, df
        self.order = order or (["_id"] if "_id" in df.columns else [])
        self.indexes: dict[str, Index] = {}
        self.version = 0

    # --- reading -------------------------------------------------------------

    @property
    def df(self) -> DataFrame:
        """Documents of the current version."""
        return self._df.drop(ORDER)

    @property
    def ordered(self) -> DataFrame:
        """Documents with the hidden column of their natural order."""
        if ORDER in self._df.columns:
            return self._df
        order = F.struct(*map(quoted, self.order)) if self.order else F.struct(F.monotonically_increasing_id().alias("row"))
        return self._df.withColumn(ORDER, order)

    @property
    def text_fields(self) -> list[str] | None:
        return next((list(i.keys) for i in self.indexes.values() if "text" in i.keys.values()), None)

    def _filtered(self, spec: dict | None) -> DataFrame:
        search, rest = text.extract(spec or {})
        df = self.ordered
        if search is not None:
            df = df.withColumn(SCORE, text.score(df.schema, self.text_fields, search)).where(quoted(SCORE) > 0)
        return df.where(compile_filter(rest, df.schema)) if rest else df

    def find(self, filter: dict | None = None, projection: dict | None = None, sort: dict | None = None, skip: int = 0, limit: int = 0) -> DataFrame:
        """Filter, sort, skip, limit and project, in this order."""
        if skip < 0:
            raise bad_value("skip must not be negative")
        df = self._filtered(filter)
        if sort or skip or limit:
            keys = [c for x, up in (pipeline.sort_spec(df.schema, sort) if sort else []) for c in sort_columns(x, up)]
            df = df.orderBy(*keys, quoted(ORDER).asc())
            df = df.offset(skip) if skip else df
            df = df.limit(abs(limit)) if limit else df
        return pipeline.output(Frame(df.select(*project(projection, df.schema)) if projection else df))

    def find_one(self, filter: dict | None = None, **options) -> dict | None:
        row = self.find(filter, limit=1, **options).first()
        return row.asDict(recursive=True) if row else None

    def cursor(self, filter: dict | None = None, batch_size: int = FIRST_BATCH, max_time_ms: int | None = None, **options) -> Cursor:
        return Cursor(self.find(filter, **options), batch_size, max_time_ms)

    def aggregate(self, stages: list[dict]) -> DataFrame:
        """The documents that a pipeline makes; of one that begins with $changeStream, the stream of this collection's events."""
        if stages and isinstance(stages[0], dict) and "$changeStream" in stages[0]:
            return self.database.watch(stages[0]["$changeStream"], self.name, stages[1:])
        return pipeline.output(self.frame(stages))

    def frame(self, stages: list[dict]) -> Frame:
        context = Context(lambda name: self.database.collection(name).ordered, self.text_fields)
        return pipeline.run(Frame(self.ordered), stages, context)

    def count(self, filter: dict | None = None, skip: int = 0, limit: int = 0) -> DataFrame:
        """One row with the number of documents, n."""
        df = self._filtered(filter)
        df = df.select(F.lit(1).alias("one"))
        df = df.offset(skip) if skip else df
        df = df.limit(abs(limit)) if limit else df
        return df.agg(F.count(F.lit(1)).alias("n"))

    def distinct(self, path: str, filter: dict | None = None) -> DataFrame:
        """One row for each different value at a path; arrays count by their elements, missing values not at all."""
        df = self._filtered(filter)
        value = root(df.schema, path)
        if isinstance(value.type, T.VariantType):
            from ..functions.values import variant_key

            array = F.when(F.schema_of_variant(value.column).startswith("ARRAY"), F.try_variant_get(value.column, "$", "array<variant>")).when(value.column.isNotNull(), F.array(value.column))
            each = df.select(F.explode(array).alias("value"))
            return each.groupBy(variant_key(F.col("value")).alias("key")).agg(F.first("value").alias("value")).select("value")
        if isinstance(value.type, T.ArrayType):
            return df.select(F.explode(value.column).alias("value")).distinct()
        return df.select(value.column.alias("value")).where("value IS NOT NULL").distinct()

    def explain(self, filter: dict | None = None, stages: list[dict] | None = None, mode: str = "formatted") -> str:
        df = self.aggregate(stages) if stages is not None else self.find(filter)
        jvm = df.sparkSession._jvm
        return df._jdf.queryExecution().explainString(jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))

    def stats(self) -> DataFrame:
        """count, size (bytes of the documents as JSON) and avg_size."""
        size = F.octet_length(F.to_json(F.struct(*[quoted(c) for c in self.df.columns])))
        return self.df.agg(F.count(F.lit(1)).alias("count"), F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("size"), F.coalesce(F.avg(size), F.lit(0.0)).alias("avg_size"))

    # --- writing -------------------------------------------------------------

    def _replace(self, df: DataFrame) -> None:
        self._df, self.version = df, self.version + 1

    def _written(self, df: DataFrame) -> DataFrame:
        """A new version; stored, if the database has a folder for versions, so that plans do not grow with the writes."""
        if not self.database.versions:
            return df
        path = f"{self.database.versions}/{self.database.name}/{self.name}/{self.version + 1}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.database.spark.read.schema(df.schema).parquet(path)

    def restore(self) -> None:
        """Back to the version that was registered."""
        self._df, self.version = self._first, 0

    def _json(self, names: list[str]) -> Column:
        return F.to_json(F.struct(*[quoted(n) for n in names]))

    def _document_key(self, names: list[str]) -> Column:
        return self._json(["_id"] if "_id" in names else [n for n in self.order if n in names] or names)

    def _publish(self, kind: str, rows: DataFrame, before: bool = False) -> None:
        """Events for the rows of an insert or a delete."""
        if self.database.log is not None:
            from ..streaming.changes import change_rows

            names = [n for n in rows.columns if not n.startswith("__")]
            document = self._json(names)
            self.database.log.append(change_rows(kind, self.database.name, self.name, rows, self._document_key(names), None if before else document, document if before else None))

    def _publish_update(self, kind: str, new: DataFrame) -> None:
        """Events for the changed rows of an update (``updated``), whose JSON before it is in __before."""
        if self.database.log is not None:
            from ..streaming.changes import change_rows

            names = [n for n in new.columns if not n.startswith("__")]
            after = self._json(names)
            fields = lambda text: F.transform_values(F.from_json(text, "map<string,variant>"), lambda k, v: F.to_json(v))
            rows = new.where("__changed").withColumns({"__after": after, "__old": fields(F.col("__before")), "__new": fields(after)})
            differs = lambda k, v: ~v.eqNullSafe(F.try_element_at(F.col("__old"), k))
            changed = F.map_filter("__new", differs)
            gone = F.array_except(F.map_keys("__old"), F.map_keys("__new"))
            description = F.struct(changed.alias("updatedFields"), gone.alias("removedFields")) if kind == "update" else None
            self.database.log.append(change_rows(kind, self.database.name, self.name, rows, self._document_key(names), F.col("__after"), F.col("__before"), description))

    def insert(self, documents: list[dict] | DataFrame, ordered: bool = True) -> WriteResult:
        """Documents that break a unique key are reported and left out; an ordered insert stops at the first."""
        spark = self.database.spark
        if isinstance(documents, DataFrame):
            return self._insert_frame(documents)
        rows = [{"_id": uuid.uuid4().hex[:24], **d} if "_id" not in d else d for d in documents]
        result, good, seen = WriteResult(), [], set()
        taken = self._taken([r["_id"] for r in rows])
        for k, row in enumerate(rows):
            key = _key(row["_id"])
            if key in seen or key in taken:
                result.errors.append({"index": k, "code": 11000, "keyPattern": {"_id": 1}, "keyValue": {"_id": row["_id"]}})
                if ordered:
                    break
                continue
            seen.add(key)
            good.append((k, row))
        if good:
            new = _frame_of(spark, [r for _, r in good], self.df.schema)
            for index in self.indexes.values():
                if index.unique and (bad := self._clashes(index, new)):
                    result.errors += bad
            if result.errors and any("index" not in e for e in result.errors):
                good = []
        if good:
            self._publish("insert", new)
            self._replace(self._written(_appended(self._df, new, self.order)))
        result.inserted = len(good)
        return result

    def _insert_frame(self, new: DataFrame) -> WriteResult:
        """A whole DataFrame at once; nothing is inserted if a unique key is broken."""
        joined = _appended(self._df, new, self.order)
        other = Collection(self.database, self.name, joined, self.order)
        other.indexes = self.indexes
        for index in [Index("_id_", {"_id": 1}, unique=True), *self.indexes.values()]:
            if index.unique and other.violations(index).limit(1).count():
                raise EngineError("DuplicateKey", f"duplicate key in {index.name}", keyPattern=index.keys)
        self._publish("insert", new)
        self._replace(self._written(joined))
        return WriteResult(inserted=new.count())

    def _taken(self, ids: list) -> set:
        if "_id" not in self.df.columns or not ids:
            return set()
        return {_key(r["_id"]) for r in self.df.where(compile_filter({"_id": {"$in": ids}}, self.df.schema)).select("_id").collect()}

    def _clashes(self, index: Index, new: DataFrame) -> list[dict]:
        other = Collection(self.database, self.name, _appended(self._df, new, self.order), self.order)
        return [{"code": 11000, "keyPattern": index.keys, "keyValue": r.asDict(recursive=True)} for r in other.violations(index).limit(20).collect()]

    def violations(self, index: Index) -> DataFrame:
        """Keys of a unique index that several documents have, and their number n."""
        df = self.df
        if index.partial:
            df = df.where(compile_filter(index.partial, df.schema))
        own = {k: root(df.schema, k) for k in index.keys}
        if index.sparse:
            some = F.lit(False)
            for x in own.values():
                some = some | x.column.isNotNull()
            df = df.where(some)
        names = {k: f"k{i}" for i, k in enumerate(own)}
        df = df.select(F.monotonically_increasing_id().alias("row") if "_id" not in df.columns else quoted("_id").alias("row"), *[x.column.alias(names[k]) for k, x in own.items()])
        for k, x in own.items():
            if isinstance(x.type, T.ArrayType):  # one key for each element
                df = df.withColumn(names[k], F.explode_outer(names[k]))
        same_row = [k for k, x in own.items() if isinstance(x.type, T.ArrayType)]
        count = F.count_distinct("row") if same_row and list(own) != ["_id"] else F.count(F.lit(1))
        return df.groupBy(*names.values()).agg(count.alias("n")).where("n > 1").withColumnsRenamed({v: k for k, v in names.items()})

    def _hit(self, filter: dict | None, many: bool, sort: dict | None = None) -> Column:
        """Which rows a write is for: all that match, or the first in order."""
        df = self.ordered
        match = closed(compile_filter(filter or {}, df.schema))
        if many:
            return match
        keys = [c for x, up in (pipeline.sort_spec(df.schema, sort) if sort else []) for c in sort_columns(x, up)]
        one = df.where(match).orderBy(*keys, quoted(ORDER).asc()).limit(1).select(ORDER).collect()
        return F.lit(False) if not one else quoted(ORDER) == _literal_struct(one[0][0], df.schema[ORDER].dataType)

    def updated(self, filter: dict | None, update: dict, many: bool = False, sort: dict | None = None) -> DataFrame:
        """The collection after an update, with the hidden flags __hit and __changed, and the JSON before it as __before if a log wants it."""
        df = self.ordered.withColumn("__hit", self._hit(filter, many, sort))
        before = {f.name: Typed(quoted(f.name), f.dataType) for f in self.df.schema.fields}
        if is_replacement(update):
            if many:
                raise EngineError("FailedToParse", "a replacement is for one document")
            if "_id" in update and df.where("__hit").where(~quoted("_id").eqNullSafe(literal(update["_id"], df.schema["_id"].dataType).column)).limit(1).count():
                raise EngineError("ImmutableField", "_id can't be changed")
            after = {k: Typed(F.lit(None).cast(x.type), x.type) for k, x in before.items() if k != "_id"} | ({"_id": before["_id"]} if "_id" in before else {})
            after |= {k: literal(v, before[k].type if k in before else None) for k, v in update.items() if k != "_id"}
        else:
            after = compile_update(update, df.schema)
        columns, changed = [], F.lit(False)
        for name in [*before, *[n for n in after if n not in before]]:
            new, old = after[name], before.get(name, Typed(F.lit(None).cast(after[name].type), after[name].type))
            to = old.type if isinstance(new.type, T.NullType) else new.type if kind_of(new.type) in ("object", "array") or name not in before else united(old, new)
            a, b = (_cast(old, to) if kind_of(to) not in ("object", "array") else _widened(old, to)), (_cast(new, to) if not isinstance(new.type, T.NullType) else F.lit(None).cast(to))
            columns.append(F.when(quoted("__hit"), b).otherwise(a).alias(name))
            if not isinstance(to, (T.VariantType, T.MapType)):
                changed = changed | ~a.eqNullSafe(b)
        was = [self._json(list(before)).alias("__before")] if self.database.log is not None else []
        return df.select(*columns, quoted(ORDER), quoted("__hit"), (quoted("__hit") & changed).alias("__changed"), *was)

    def update(self, filter: dict | None, update: dict, many: bool = False, upsert: bool = False, sort: dict | None = None) -> WriteResult:
        new = self._written(self.updated(filter, update, many, sort))
        n, changed = new.agg(F.count_if("__hit"), F.count_if("__changed")).first()
        if not n and upsert:
            row = self.upsert_document(filter or {}, update)
            result = self.insert([row])
            return WriteResult(inserted=result.inserted, upserted_id=row["_id"], errors=result.errors)
        if changed:
            self._publish_update("replace" if is_replacement(update) else "update", new)
        self._replace(new.drop("__hit", "__changed", "__before"))
        return WriteResult(matched=n, modified=changed)

    def upsert_document(self, filter: dict, update: dict) -> dict:
        """What an upsert inserts; only _id comes from the filter."""
        own = filter.get("_id")
        start = {"_id": own} if own is not None and not isinstance(own, dict) else {"_id": update.get("_id") or update.get("$setOnInsert", {}).get("_id") or uuid.uuid4().hex[:24]}
        if is_replacement(update):
            return start | update | start
        base = _frame_of(self.database.spark, [start], T.StructType([f for f in self.df.schema.fields if f.name == "_id"]))
        # Fields that the update sets are typed as the collection has them.
        fields = compile_update(update, base.schema, inserting=True)
        row = base.select(*[x.column.alias(k) for k, x in fields.items()]).first()
        return row.asDict(recursive=True)

    def delete(self, filter: dict | None, many: bool = False) -> WriteResult:
        hit = self._hit(filter, many)
        df = self.ordered
        gone = df.where(hit).count()
        if gone:
            self._publish("delete", df.where(hit), before=True)
        self._replace(self._written(df.where(~hit)))
        return WriteResult(deleted=gone)

    def find_and_modify(self, filter: dict | None, update: dict | None = None, sort: dict | None = None, remove: bool = False, new: bool = False, upsert: bool = False) -> dict | None:
        """The first match before (or, with ``new``, after) it is changed or removed."""
        old = self.find(filter, sort=sort, limit=1).first()
        if old is None and not (upsert and update):
            return None
        if remove:
            hit = self._hit(filter, False, sort)
            self._publish("delete", self.ordered.where(hit), before=True)
            self._replace(self._written(self.ordered.where(~hit)))
            return old.asDict(recursive=True)
        changed = self.updated(filter, update or {}, False, sort)
        result = self.update(filter, update or {}, upsert=upsert, sort=sort)
        if not new:
            return old.asDict(recursive=True) if old else None
        if result.upserted_id is not None:
            return self.find_one({"_id": result.upserted_id})
        row = changed.where("__hit").drop("__hit", "__changed", "__before", ORDER).first()
        return row.asDict(recursive=True)

    # --- indexes -------------------------------------------------------------

    def create_index(self, keys: dict[str, Any], name: str | None = None, **options) -> Index:
        index = Index(name or "_".join(f"{k}_{v}" for k, v in keys.items()), keys, **options)
        if index.unique and self.violations(index).limit(1).count():
            raise EngineError("DuplicateKey", f"duplicate key in {index.name}", keyPattern=keys)
        self.indexes[index.name] = index
        return index

    def list_indexes(self) -> list[Index]:
        return [Index("_id_", {"_id": 1}, unique=True), *self.indexes.values()]

    def index_table(self) -> DataFrame:
        """name, keys (JSON), unique, sparse, partial (JSON) and expireAfterSeconds of all indexes."""
        import json

        rows = [(i.name, json.dumps(i.keys), i.unique, i.sparse, None if i.partial is None else json.dumps(i.partial, default=str), None if i.expire_after is None else float(i.expire_after)) for i in self.list_indexes()]
        return self.database.spark.createDataFrame(rows, "name string, keys string, unique boolean, sparse boolean, partial string, expireAfterSeconds double")

    def drop_index(self, name: str) -> None:
        if name not in self.indexes:
            raise EngineError("IndexNotFound", f"index not found with name [{name}]")
        del self.indexes[name]


def _key(value: Any) -> Any:
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else repr(value)


def _widened(value: Typed, to: T.DataType) -> Column:
    """A struct or array in a type that has further fields."""
    if value.type == to:
        return value.column
    if isinstance(value.type, T.StructType) and isinstance(to, T.StructType):
        have = {f.name: f.dataType for f in value.type.fields}
        parts = [(_widened(Typed(value.column.getField(f.name), have[f.name]), f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in to.fields]
        return F.when(value.column.isNotNull(), F.struct(*parts))
    if isinstance(value.type, T.ArrayType) and isinstance(to, T.ArrayType):
        return F.transform(value.column, lambda x: _widened(Typed(x, value.type.elementType), to.elementType))
    return value.column.cast(to)


def _literal_struct(value: Any, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        return F.struct(*[_literal_struct(value[f.name], f.dataType).alias(f.name) for f in kind.fields])
    return literal(value, kind).column.cast(kind)


def _frame_of(spark: SparkSession, rows: list[dict], schema: T.StructType) -> DataFrame:
    """Rows as a DataFrame; fields that the collection has keep their types, others are inferred from all rows."""
    known = {f.name: f for f in schema.fields}
    names = list(dict.fromkeys([n for r in rows for n in r]))
    fields = []
    for n in names:
        values = [r[n] for r in rows if r.get(n) is not None]
        if n in known and (not values or all(kind_of(literal(v).type) == kind_of(known[n].dataType) for v in values)):
            fields.append(T.StructField(n, known[n].dataType))
        else:
            fields.append(T.StructField(n, literal(values[0]).type if values else T.StringType()))
    out = T.StructType(fields)
    return spark.createDataFrame([tuple(_fit(r.get(f.name), f.dataType) for f in fields) for r in rows], out)


def _fit(value: Any, kind: T.DataType) -> Any:
    if value is None:
        return None
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return float(value)
    if isinstance(kind, T.StructType):
        return tuple(_fit(value.get(f.name), f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return [_fit(v, kind.elementType) for v in value]
    return value


def _appended(old: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """Both sets of documents; fields that one side lacks are null there, and types are widened to hold both."""
    if ORDER in old.columns:
        old = old.drop(ORDER)
    have, come = {f.name: f.dataType for f in old.schema.fields}, {f.name: f.dataType for f in new.schema.fields}
    to = {n: united(Typed(None, have[n]), Typed(None, come[n])) if n in have and n in come else have.get(n) or come[n] for n in [*have, *come]}
    cast = lambda df, own: df.select(*[(_cast(Typed(quoted(n), own[n]), to[n]) if own[n] != to[n] else quoted(n)).alias(n) for n in own])
    return cast(old, have).unionByName(cast(new, come), allowMissingColumns=True)


class Database:
    """Named collections.

    log: a ``ChangeLog`` that every write and namespace operation publishes
    to.  versions: a folder that executors share, to which writes store each
    new version of a collection; without it, versions are plans over the
    collection that was registered.
    """

    def __init__(self, spark: SparkSession, name: str = "main", log: Any = None, versions: str | None = None):
        self.spark, self.name, self.log, self.versions = spark, name, log, versions
        self._collections: dict[str, Collection] = {}

    def _record(self, kind: str, coll: str | None, **more: Any) -> None:
        if self.log is not None:
            self.log.record(kind, self.name, coll, **more)

    def changed(self) -> list[str]:
        """Names of the collections that were written to since they were registered."""
        return [n for n, c in self._collections.items() if c.version]

    def watch(self, options: dict | None = None, coll: str | None = None, stages: list[dict] | None = None, streaming: bool = True) -> DataFrame:
        """Events of a collection, or of all; ``options`` are those of $changeStream."""
        if self.log is None:
            raise EngineError("IllegalOperation", "$changeStream needs a database with a change log")
        if not isinstance(options or {}, dict):
            raise bad_value("$changeStream needs a document")
        known = {"fullDocument", "fullDocumentBeforeChange", "resumeAfter", "startAfter", "startAtOperationTime", "allChangesForCluster"}
        options = options or {}
        if set(options) - known:
            raise EngineError("InvalidOptions", f"unknown options of $changeStream: {sorted(set(options) - known)}")
        after = options.get("resumeAfter") or options.get("startAfter")
        after = after.get("_data") if isinstance(after, dict) else after
        whole = bool(options.get("allChangesForCluster"))
        return self.log.watch(None if whole else self.name, None if whole else coll, stages, after, options.get("startAtOperationTime"), options.get("fullDocument", "default"), options.get("fullDocumentBeforeChange", "off"), streaming)

    def coll_mod(self, name: str, index: dict | None = None) -> dict:
        """Change an index's time to live; the index is given by its name or keyPattern."""
        if name not in self._collections:
            raise EngineError("NamespaceNotFound", "ns does not exist")
        if not index:
            return {}
        own = self._collections[name].indexes.values()
        found = next((i for i in own if i.name == index["name"] if isinstance(index.get("name"), str)), None) if "name" in index else next((i for i in own if i.keys == index.get("keyPattern")), None)
        if found is None:
            raise EngineError("IndexNotFound", "cannot find index for collMod")
        reply = {}
        if "expireAfterSeconds" in index:
            if found.expire_after is not None:
                reply["expireAfterSeconds_old"] = found.expire_after
            found.expire_after = reply["expireAfterSeconds_new"] = int(index["expireAfterSeconds"])
        return reply

    def collection(self, name: str) -> Collection:
        """A collection; one that does not exist reads as empty."""
        if name not in self._collections:
            return Collection(self, name, self.spark.createDataFrame([], EMPTY))
        return self._collections[name]

    __getitem__ = collection

    def register(self, name: str, df: DataFrame, order: list[str] | None = None) -> Collection:
        self._collections[name] = Collection(self, name, df, order)
        return self._collections[name]

    def create(self, name: str) -> Collection:
        if name in self._collections:
            raise EngineError("NamespaceExists", f"{name} exists")
        self._record("create", name)
        # The first insert decides the type of _id.
        return self.register(name, self.spark.createDataFrame([], T.StructType([T.StructField("_id", T.NullType())])))

    def drop(self, name: str) -> None:
        if self._collections.pop(name, None) is None:
            raise EngineError("NamespaceNotFound", f"{name} does not exist")
        self._record("drop", name)

    def rename(self, name: str, to: str, drop_target: bool = False) -> None:
        if name not in self._collections:
            raise EngineError("NamespaceNotFound", f"{name} does not exist")
        if to in self._collections and not drop_target:
            raise EngineError("NamespaceExists", f"{to} exists")
        self._collections[to] = self._collections.pop(name)
        self._collections[to].name = to
        self._record("rename", name, to=(self.name, to))

    def list_collections(self, filter: dict | None = None) -> DataFrame:
        df = self.spark.createDataFrame([(n, "collection") for n in self._collections], "name string, type string")
        return df.where(compile_filter(filter or {}, df.schema))

    def documents(self, rows: list[dict]) -> Collection:
        """An inline source: the documents of an array, in its order."""
        if not isinstance(rows, (list, tuple)) or not all(isinstance(r, dict) for r in rows):
            raise bad_value("$documents needs an array of documents")
        df = _frame_of(self.spark, [{"__n": k, **r} for k, r in enumerate(rows)], T.StructType()) if rows else self.spark.createDataFrame([], EMPTY)
        df = df.withColumn(ORDER, F.struct("__n")).drop("__n") if rows else df
        return Collection(self, "$documents", df)

    def aggregate(self, stages: list[dict]) -> DataFrame:
        """A pipeline that brings its own documents: its first stage is $documents, or $changeStream for the events of all collections."""
        if stages and "$changeStream" in stages[0]:
            return self.watch(stages[0]["$changeStream"], None, stages[1:])
        if not stages or "$documents" not in stages[0]:
            raise bad_value("a pipeline without a collection begins with $documents")
        return self.documents(stages[0]["$documents"]).aggregate(stages[1:])

    def stats(self) -> DataFrame:
        out = None
        for name, c in self._collections.items():
            one = c.stats().select(F.lit(name).alias("collection"), "count", "size", "avg_size")
            out = one if out is None else out.unionByName(one)
        return out if out is not None else self.spark.createDataFrame([], "collection string, count bigint, size bigint, avg_size double")


class Catalog:
    """Named databases."""

    def __init__(self, spark: SparkSession):
        self.spark, self._databases = spark, {}

    def database(self, name: str) -> Database:
        return self._databases.setdefault(name, Database(self.spark, name))

    __getitem__ = database

    def drop_database(self, name: str) -> None:
        gone = self._databases.pop(name, None)
        if gone is not None:
            for own in list(gone._collections):
                gone._record("drop", own)
            gone._record("dropDatabase", None)

    def list_databases(self, filter: dict | None = None) -> DataFrame:
        df = self.spark.createDataFrame([(n, len(d._collections)) for n, d in self._databases.items()], "name string, collections int")
        return df.where(compile_filter(filter or {}, df.schema))


__all__ = ["Catalog", "Collection", "Cursor", "Database", "Index", "WriteResult", "deadline"]
