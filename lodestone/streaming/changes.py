"""Change streams: an append-only log of events, read as a stream.

The log is a folder of JSON files; every event has the next number of one
sequence.  A batch of events is a folder named by its first number.  A writer
claims numbers by creating a file of that name, which only one of several can
do; the file holds the batch's last number, so the end of the log is known
from a list of names and one small file.  The stream is a file source with a
fixed schema: its checkpoint is the resume position, and ``after`` or ``at``
set where a new stream begins.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.errors import EngineError, bad_value
from ..functions.values import ORDER
from ..plans import pipeline
from ..plans.pipeline import Context, Frame

#: Events kept; a stream can't begin before the oldest of them.
RETENTION = 100_000
TRIM_AT = 125_000

_NAMESPACE = T.StructType().add("db", "string").add("coll", "string")
EVENT = (
    T.StructType()
    .add("seq", "long")
    .add("operationType", "string")
    .add("clusterTime", "timestamp")
    .add("wallTime", "timestamp")
    .add("ns", _NAMESPACE)
    .add("to", _NAMESPACE)
    .add("documentKey", "string")
    .add("fullDocument", "string")
    .add("fullDocumentBeforeChange", "string")
    .add("updateDescription", T.StructType().add("updatedFields", T.MapType(T.StringType(), T.StringType())).add("removedFields", T.ArrayType(T.StringType())))
)
KINDS = ("insert", "update", "replace", "delete", "create", "drop", "dropDatabase", "rename", "invalidate")


def token(seq: Column) -> Column:
    """Resume token of an event: its number in 16 hex digits."""
    return F.lpad(F.lower(F.hex(seq)), 16, "0")


class ChangeLog:
    """Writer and reader of one log folder."""

    def __init__(self, spark: SparkSession, path: str, retention: int = RETENTION):
        self.spark, self.path, self.retention = spark, path, retention

    def _fs(self, path: str):
        """File system and path object; claims and batches may lie in any store that Spark reaches."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{path}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def events(self) -> DataFrame:
        fs, at = self._fs("events")
        if not fs.exists(at):  # a log that nothing was written to
            return self.spark.createDataFrame([], EVENT)
        return self.spark.read.schema(EVENT).option("recursiveFileLookup", "true").json(f"{self.path}/events")

    def _claims(self) -> list[str]:
        fs, at = self._fs("claims")
        return sorted(x.getPath().getName() for x in fs.listStatus(at) if not x.getPath().getName().startswith((".", "_"))) if fs.exists(at) else []

    def _end(self, claim: str) -> int:
        fs, at = self._fs(f"claims/{claim}")
        for _ in range(200):  # a claim that was made this moment may not be filled yet
            stream = fs.open(at)
            try:
                return int(stream.readUTF())
            except Exception as error:
                if "EOFException" not in str(error):
                    raise
                time.sleep(0.05)
            finally:
                stream.close()
        raise EngineError("UnknownError", f"claim {claim} of the change log was never filled")

    def last(self) -> int:
        """Number of the last event, in time that does not depend on the log's length."""
        names = self._claims()
        return self._end(names[-1]) if names else 0

    def _claim(self, count: int, begin: int | None = None) -> int:
        """First of ``count`` numbers that no other writer has."""
        while True:
            first = self.last() + 1 if begin is None else begin
            if self._create(f"claims/{first:016x}", str(first + count - 1), begin is not None):
                return first

    def _create(self, path: str, text: str, replace: bool) -> bool:
        """Whether the file was made: of several writers that try at once, one succeeds."""
        fs, at = self._fs(path)
        try:
            if at.toUri().getScheme() in (None, "file") and not replace:
                # Local folders have no exclusive creation in Hadoop's interface, but in Java's own.
                files, folder = self.spark.sparkContext._jvm.java.nio.file.Files, at.toUri().getPath()
                fs.mkdirs(at.getParent())
                files.createFile(self.spark.sparkContext._jvm.java.io.File(folder).toPath(), self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.java.nio.file.attribute.FileAttribute, 0))
                replace = True
            stream = fs.create(at, replace)
        except Exception as error:
            if "AlreadyExists" in str(error) or "already exists" in str(error):
                return False
            raise
        stream.writeUTF(text)
        stream.close()
        return True

    def append(self, events: DataFrame) -> int:
        """Write events that have the log's columns; without ``seq`` they get the next numbers, in the order of ``__ord`` if they have it.

        Numbers come from each partition's size, not from one global window;
        the rows are written once before, so that both readings agree.
        """
        have = set(events.columns)
        if "seq" in have:
            first, last, count = events.agg(F.min("seq"), F.max("seq"), F.count(F.lit(1))).first()
            if not count:
                return self.last()
            self._claim(last - first + 1, first)
        else:
            rows = events.orderBy(ORDER).drop(ORDER) if ORDER in events.columns else events
            place = F.monotonically_increasing_id()
            staged = f"staged-{uuid.uuid4().hex}"
            rows.select("*", F.shiftright(place, 33).alias("__part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("__row")).write.parquet(f"{self.path}/{staged}")
            rows = self.spark.read.parquet(f"{self.path}/{staged}")
            sizes = rows.groupBy("__part").count().orderBy("__part").collect()  # one row for each partition
            if not sizes:
                return self.last()
            first = total = self._claim(sum(r["count"] for r in sizes))
            begins = {}
            for r in sizes:
                begins[r["__part"]] = total
                total += r["count"]
            begin = F.create_map(*[F.lit(x).cast("bigint") for pair in begins.items() for x in pair])
            events = rows.withColumn("seq", begin[F.col("__part")] + F.col("__row")).drop("__part", "__row")
        shaped = events.select(*[(F.col(f"`{f.name}`").cast(f.dataType) if f.name in have or f.name == "seq" else F.lit(None).cast(f.dataType)).alias(f.name) for f in EVENT.fields])
        shaped.write.json(f"{self.path}/events/{first:016x}")
        if "seq" not in have:
            fs, at = self._fs(staged)
            fs.delete(at, True)
        self.trim()
        return self.last()

    def record(self, kind: str, db: str, coll: str | None = None, key: Any = None, document: dict | None = None, before: dict | None = None, to: tuple[str, str] | None = None) -> int:
        """Append one event."""
        import json

        if kind not in KINDS:
            raise bad_value(f"unknown event {kind}")
        change = None
        if kind == "update":
            old, new = before or {}, document or {}
            change = ({k: json.dumps(v, default=str) for k, v in new.items() if k not in old or old[k] != v}, [k for k in old if k not in new])
        text = lambda d: None if d is None else json.dumps(d, default=str)
        seq = self._claim(1)
        row = (seq, kind, None, None, (db, coll), to, None if key is None else json.dumps({"_id": key}, default=str), text(document), text(before), change)
        df = self.spark.createDataFrame([row], EVENT).withColumns({"clusterTime": F.current_timestamp(), "wallTime": F.current_timestamp()})
        df.coalesce(1).write.json(f"{self.path}/events/{seq:016x}")
        self.trim()
        return seq

    def oldest(self, last: int | None = None) -> int:
        """Number of the oldest event that a stream can begin after."""
        last = self.last() if last is None else last
        return max(0, last - self.retention) if last > self.retention * TRIM_AT // RETENTION else 0

    def begin(self, after: str | None = None, at: Any = None) -> Column:
        """Which events a stream sees: after a token, or from a time on; by default those to come."""
        if after is not None and at is not None:
            raise bad_value("a stream begins after a token or at a time")
        last = self.last()
        if after is not None:
            try:
                seq = int(after, 16)
            except ValueError:
                raise bad_value("a resume token is a hexadecimal number") from None
            if seq < self.oldest(last):
                raise EngineError("ChangeStreamHistoryLost", "the resume point is no longer in the log")
            return F.col("seq") > seq
        if at is not None:
            return F.col("clusterTime") >= F.lit(at)
        return F.col("seq") > last

    def watch(self, db: str | None = None, coll: str | None = None, stages: list[dict] | None = None, after: str | None = None, at: Any = None, full_document: str = "default", before_change: str = "off", streaming: bool = True) -> DataFrame:
        """Events of a collection, a database or all, shaped and passed through per-event stages.

        streaming: a stream, else a batch read of what is there.
        """
        start = self.begin(after, at)
        if streaming:
            fs, at = self._fs("events")
            fs.mkdirs(at)
        source = self.spark.readStream.schema(EVENT).option("recursiveFileLookup", "true").json(f"{self.path}/events") if streaming else self.events()
        rows = source.where(start).where(in_scope(db, coll))
        if coll is not None:
            rows = until_invalidated(rows, self._ends(start, db, coll))
        return per_event(shaped(rows, full_document, before_change), stages or [])

    def _ends(self, start: Column, db: str | None, coll: str) -> int | None:
        """Number of the first event that ends a collection's stream, among those written so far."""
        ends = F.col("operationType").isin("drop", "rename")
        return self.events().where(start).where(in_scope(db, coll)).where(ends).agg(F.min("seq")).first()[0]

    def trim(self) -> int:
        """Delete batches that end before the oldest event that a stream can begin after; returns its number."""
        oldest = self.oldest()
        names = self._claims() if oldest else []
        for name, after in zip(names, names[1:], strict=False):
            if int(after, 16) > oldest:
                break
            for folder in ("events", "claims"):
                fs, at = self._fs(f"{folder}/{name}")
                fs.delete(at, True)
        return oldest


def in_scope(db: str | None, coll: str | None) -> Column:
    scope = F.lit(True)
    if db is not None:
        scope = scope & (F.col("ns.db") == db)
    if coll is not None:
        scope = scope & ((F.col("ns.coll") == coll) | ((F.col("operationType") == "rename") & (F.col("to.coll") == coll)))
    return F.coalesce(scope, F.lit(False))


def until_invalidated(rows: DataFrame, end: int | None) -> DataFrame:
    """A collection's stream ends with its drop or rename, which an invalidate event follows.

    ``end``: the number of such an event, if the log has one already.  One
    that arrives later is followed by its invalidate event here, and ``drain``
    and ``follow`` end with it.
    """
    if end is not None:
        rows = rows.where(F.col("seq") <= end)
    ends = F.col("operationType").isin("drop", "rename")
    kinds = F.when(ends, F.array(F.col("operationType"), F.lit("invalidate"))).otherwise(F.array(F.col("operationType")))
    return rows.withColumn("operationType", F.explode(kinds))


def shaped(rows: DataFrame, full_document: str = "default", before_change: str = "off") -> DataFrame:
    """Events as a stream returns them; ``_id`` is the resume token."""
    if full_document not in ("default", "updateLookup", "whenAvailable", "required"):
        raise bad_value(f"unknown fullDocument {full_document}")
    if before_change not in ("off", "whenAvailable", "required"):
        raise bad_value(f"unknown fullDocumentBeforeChange {before_change}")
    kind = F.col("operationType")
    document = F.when(kind.isin("insert", "replace") | ((kind == "update") & F.lit(full_document != "default")), F.col("fullDocument"))
    before = F.when(kind.isin("update", "replace", "delete") & F.lit(before_change != "off"), F.col("fullDocumentBeforeChange"))
    return rows.select(
        token(F.col("seq")).alias("_id"),
        "operationType",
        "clusterTime",
        "wallTime",
        "ns",
        "to",
        F.when(kind.isin("insert", "update", "replace", "delete"), F.parse_json("documentKey")).alias("documentKey"),
        F.parse_json(document).alias("fullDocument"),
        F.parse_json(before).alias("fullDocumentBeforeChange"),
        F.when(kind == "update", F.col("updateDescription")).alias("updateDescription"),
        F.struct("seq").alias(ORDER),
    )


_PER_EVENT = ("$match", "$project", "$addFields", "$set", "$replaceRoot", "$unwind")


def per_event(rows: DataFrame, stages: list[dict]) -> DataFrame:
    """Stages applied to every event by itself, so only those that keep no state are allowed."""
    for stage in stages:
        if next(iter(stage), None) not in _PER_EVENT:
            raise EngineError("IllegalOperation", f"{next(iter(stage), None)} can't run on a change stream")
    if not stages:
        return rows.drop(ORDER)
    frame = pipeline.run(Frame(rows), stages, Context(_nothing))
    return pipeline.output(frame)


def _nothing(name: str) -> DataFrame:
    raise EngineError("IllegalOperation", "a change stream reads no other collection")


def _until_invalidated(handle: Callable[[DataFrame, int], None], checkpoint: str) -> Callable[[DataFrame, int], None]:
    """``handle`` for batches up to the first invalidate event; that the stream has ended is kept beside its checkpoint."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/invalidated")
        fs = mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(mark):
            return
        end = None
        if {"_id", "operationType"} <= set(batch.columns):
            end = batch.where("operationType = 'invalidate'").agg(F.min("_id")).first()[0]
        handle(batch if end is None else batch.where(F.col("_id") <= end), number)
        if end is not None:
            fs.create(mark, True).close()

    return run


def drain(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> None:
    """Everything that has not been handled yet, once: the checkpoint is the position to resume from."""
    stream.writeStream.foreachBatch(_until_invalidated(handle, checkpoint)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def follow(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], max_wait: float, every: str = "200 milliseconds") -> None:
    """Events as they come, for ``max_wait`` seconds; the checkpoint is the position to resume from."""
    query = stream.writeStream.foreachBatch(_until_invalidated(handle, checkpoint)).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
    try:
        query.awaitTermination(max_wait)
    finally:
        query.stop()


def change_rows(kind: str, db: str, coll: str, rows: DataFrame, key: Column, after: Column | None = None, before: Column | None = None, description: Column | None = None) -> DataFrame:
    """Rows of a write as events without numbers; ``key``, ``after`` and ``before`` are JSON."""
    none = F.lit(None).cast("string")
    own = EVENT["updateDescription"].dataType
    return rows.select(
        F.lit(kind).alias("operationType"),
        F.current_timestamp().alias("clusterTime"),
        F.current_timestamp().alias("wallTime"),
        F.struct(F.lit(db).alias("db"), F.lit(coll).alias("coll")).alias("ns"),
        key.alias("documentKey"),
        (none if after is None else after).alias("fullDocument"),
        (none if before is None else before).alias("fullDocumentBeforeChange"),
        (F.lit(None).cast(own) if description is None else description.cast(own)).alias("updateDescription"),
        *([ORDER] if ORDER in rows.columns else []),
    )


def describe_update(before: DataFrame, after: DataFrame, key: str = "_id") -> DataFrame:
    """Top-level fields that differ between two versions of a collection: key, updatedFields (JSON by name) and removedFields."""
    names = [n for n in after.columns if n != key and n in before.columns]
    new = after.select(F.col(key), *[F.col(f"`{n}`").alias(f"n_{n}") for n in names])
    old = before.select(F.col(key).alias("__key"), *[F.col(f"`{n}`").alias(f"o_{n}") for n in names])
    both = new.join(old, F.col(key).eqNullSafe(F.col("__key")))
    changed = [F.when(~F.col(f"o_{n}").eqNullSafe(F.col(f"n_{n}")) & F.col(f"n_{n}").isNotNull(), F.struct(F.lit(n).alias("key"), F.to_json(F.struct(F.col(f"n_{n}").alias("v"))).alias("value"))) for n in names]
    gone = [F.when(F.col(f"n_{n}").isNull() & F.col(f"o_{n}").isNotNull(), F.lit(n)) for n in names]
    described = both.select(key, F.map_from_entries(F.filter(F.array(*changed), lambda x: x.isNotNull())).alias("updatedFields"), F.filter(F.array(*gone), lambda x: x.isNotNull()).alias("removedFields"))
    return described.where((F.size("updatedFields") > 0) | (F.size("removedFields") > 0))
