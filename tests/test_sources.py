"""Readers, the binary decoder, directory layouts, chunked files and change streams."""

import json
import struct
import time

import pytest

from lodestone.functions.errors import EngineError
from lodestone.plans.collection import Catalog
from lodestone.sources import bson, files
from lodestone.plans.collection import Catalog, Database
from lodestone.streaming.changes import ChangeLog, describe_update, drain, follow


def element(kind, name, body):
    return bytes([kind]) + name.encode() + b"\x00" + body


def document(*elements):
    body = b"".join(elements) + b"\x00"
    return struct.pack("<i", len(body) + 4) + body


def text(s):
    return struct.pack("<i", len(s.encode()) + 1) + s.encode() + b"\x00"


SAMPLE = document(
    element(1, "d", struct.pack("<d", 1.5)),
    element(2, "s", text("hé")),
    element(3, "o", document(element(16, "x", struct.pack("<i", -3)))),
    element(4, "a", document(element(16, "0", struct.pack("<i", 1)), element(10, "1", b""))),
    element(5, "b", struct.pack("<iB", 2, 0) + b"\x01\x02"),
    element(7, "_id", bytes(range(12))),
    element(8, "t", b"\x01"),
    element(9, "when", struct.pack("<q", 1000)),
    element(18, "big", struct.pack("<q", 1 << 40)),
    element(17, "ts", struct.pack("<II", 2, 1)),
    element(19, "dec", struct.pack("<QQ", 12345, (6176 - 2) << 49)),
    element(11, "re", b"a.b\x00i\x00"),
)


def test_decode():
    got = bson.decode(SAMPLE)
    assert got["d"] == 1.5 and got["s"] == "hé" and got["o"] == {"x": -3} and got["a"] == [1, None] and got["b"] == b"\x01\x02"
    assert got["_id"] == bytes(range(12)).hex() and got["t"] is True and got["when"].second == 1 and got["big"] == 1 << 40
    assert got["ts"] == {"t": 1, "i": 2} and got["dec"] == "123.45" and got["re"] == "/a.b/i"
    assert len(list(bson.documents(SAMPLE * 3 + SAMPLE[:20]))) == 3
    assert list(bson.documents(b"\x01\x00\x00\x00")) == []
    with pytest.raises(ValueError):
        list(bson.documents(document(element(99, "x", b""))))


def test_directory(spark, tmp_path):
    d = tmp_path / "shop"
    d.mkdir()
    (d / "lines.json").write_text('{"_id":1,"x":5}\n\n  \n{"_id":2,"x":"t","y":null}\n')
    (d / "array.json").write_text('[{"_id":1}, 5, "a", null, {"_id":2}]')
    (d / "lines.metadata.json").write_text("{}")
    (d / "dump.bson").write_bytes(SAMPLE * 2)
    (d / "dump.json").write_text('{"_id":9}')
    cat = files.load_directory(spark, str(tmp_path))
    assert sorted(r["name"] for r in cat["shop"].list_collections().collect()) == ["array", "dump", "lines"]
    assert cat["shop"]["lines"].find({"v.x": 5}).count() == 1 and cat["shop"]["lines"].find({"v.y": {"$exists": True}}).count() == 1
    assert cat["shop"]["array"].find({"v.value": {"$exists": True}}).count() == 3
    dumped = files.load_directory(spark, str(tmp_path), dump=True)
    assert dumped["shop"]["dump"].find({"v.d": 1.5, "v.a": 1, "v.o.x": -3}).count() == 2
    assert files.load_directory(spark, str(tmp_path / "none")).list_databases().count() == 0


def test_typed_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n".join(json.dumps({"_id": i, "n": i * 2, "t": ["x"]}) for i in range(5)))
    c = Catalog(spark)["d"].register("a", files.read_json_lines(spark, str(tmp_path / "a.json")))
    assert [r["_id"] for r in c.find({"n": {"$gt": 2}}, limit=2).collect()] == [2, 3]
    typed = files.typed(files.read_json_variant(spark, str(tmp_path / "a.json")), "_id int, n string")
    assert sorted(r["n"] for r in typed.collect()) == ["0", "2", "4", "6", "8"]


def test_grid_files(spark):
    parts = spark.createDataFrame([(1, 1, b"cd"), (1, 0, b"ab"), (1, 2, b"e")], "files_id int, n int, data binary")
    got = {r["_id"]: bytes(r["data"]) for r in files.grid_files(spark.createDataFrame([(1, "f"), (2, "g")], "_id int, filename string"), parts).collect()}
    assert got == {1: b"abcde", 2: b""}


def test_change_log(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path / "log"))
    assert log.last() == 0
    log.record("insert", "app", "c", 1, {"_id": 1, "n": 1})
    log.record("update", "app", "c", 1, {"_id": 1, "n": 2}, before={"_id": 1, "n": 1, "old": 0})
    log.record("insert", "app", "other", 5, {"_id": 5})
    log.record("drop", "app", "c")
    log.record("insert", "app", "c", 2, {"_id": 2})
    assert log.last() == 5
    start = "0" * 16
    kinds = lambda df: [r["operationType"] for r in df.orderBy("_id").collect()]
    assert sorted(kinds(log.watch("app", "c", after=start, streaming=False))) == ["drop", "insert", "invalidate", "update"]
    assert len(kinds(log.watch("app", after=start, streaming=False))) == 5
    assert kinds(log.watch("app", "c", after="0000000000000004", streaming=False)) == ["insert"]
    update = log.watch("app", "c", [{"$match": {"operationType": "update"}}], after=start, full_document="updateLookup", before_change="whenAvailable", streaming=False).first()
    assert dict(update["updateDescription"]["updatedFields"]) == {"n": "2"} and update["updateDescription"]["removedFields"] == ["old"]
    assert update["fullDocument"] is not None and update["fullDocumentBeforeChange"] is not None
    for bad in (lambda: log.watch(after="zz"), lambda: log.watch(stages=[{"$group": {"_id": None}}], after=start), lambda: log.record("nope", "a")):
        with pytest.raises(EngineError):
            bad()
    with pytest.raises(EngineError, match="HistoryLost"):
        ChangeLog(spark, str(tmp_path / "log"), retention=1).watch(after=start)


def test_append_numbers_events_in_order(spark, tmp_path):
    from pyspark.sql import functions as F

    log = ChangeLog(spark, str(tmp_path / "log"))
    log.record("create", "app", "c")
    events = spark.range(100).repartition(5).select(F.lit("insert").alias("operationType"), F.struct(F.lit("app").alias("db"), F.lit("c").alias("coll")).alias("ns"), F.col("id").cast("string").alias("documentKey"), F.struct((-F.col("id")).alias("o")).alias("__ord"))
    assert log.append(events) == 101
    assert [r["documentKey"] for r in log.events().where("seq > 1").orderBy("seq").collect()] == [str(99 - i) for i in range(100)]
    assert log.append(events.limit(0)) == 101


def test_stream_resumes_from_its_checkpoint(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path / "log"))
    log.record("insert", "app", "c", 1, {"_id": 1})
    seen = []

    def handle(batch, number):
        seen.extend(r["_id"] for r in batch.collect())

    stream = lambda: log.watch("app", after="0" * 16)
    drain(stream(), str(tmp_path / "at"), handle)
    log.record("insert", "app", "c", 2, {"_id": 2})
    time.sleep(0.1)
    drain(stream(), str(tmp_path / "at"), handle)
    assert seen == ["0" * 15 + "1", "0" * 15 + "2"]


def test_describe_update(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "_id int, s string, n int")
    new = spark.createDataFrame([(1, "z", None), (2, "b", 6)], "_id int, s string, n int")
    got = describe_update(old, new).collect()
    assert len(got) == 1 and list(got[0]["updatedFields"]) == ["s"] and got[0]["removedFields"] == ["n"]


def test_two_writers_never_share_a_number(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    log = ChangeLog(spark, str(tmp_path / "log"))
    with ThreadPoolExecutor(6) as pool:
        got = list(pool.map(lambda k: ChangeLog(spark, log.path).record("insert", "app", "c", k, {"_id": k}), range(18)))
    assert sorted(got) == list(range(1, 19)) and log.last() == 18
    assert sorted(r["seq"] for r in log.events().collect()) == list(range(1, 19))


def test_trimming_deletes_old_batches(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path / "log"), retention=4)
    for k in range(9):
        log.record("insert", "app", "c", k, {"_id": k})
    oldest = log.oldest()
    kept = sorted(r["seq"] for r in log.events().collect())
    assert oldest == 5 and kept == [5, 6, 7, 8, 9] and log.last() == 9
    assert [r["_id"] for r in log.watch(after=f"{oldest:016x}", streaming=False).orderBy("_id").collect()] == [f"{k:016x}" for k in (6, 7, 8, 9)]
    with pytest.raises(EngineError, match="HistoryLost"):
        log.watch(after=f"{oldest - 1:016x}", streaming=False)


def test_a_drop_that_arrives_later_ends_the_stream(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path / "log"))
    db = Database(spark, "app", log=log)
    c = db.create("c")
    stream, seen = log.watch("app", "c", after="0" * 16), []
    handle = lambda batch, number: seen.extend(r["operationType"] for r in batch.orderBy("_id").collect())
    drain(stream, str(tmp_path / "at"), handle)
    assert seen == ["create"]
    c.insert([{"_id": 1}])
    db.drop("c")
    db.create("c").insert([{"_id": 2}])
    drain(stream, str(tmp_path / "at"), handle)
    drain(stream, str(tmp_path / "at"), handle)
    assert seen == ["create", "insert", "drop", "invalidate"]


def test_following_a_stream_for_a_while(spark, tmp_path):
    db = Database(spark, "app", log=ChangeLog(spark, str(tmp_path / "log")))
    db.create("c").insert([{"_id": k} for k in range(3)])
    seen = []
    begin = time.monotonic()
    follow(db["c"].aggregate([{"$changeStream": {"resumeAfter": {"_data": "0" * 16}}}, {"$match": {"operationType": "insert"}}]), str(tmp_path / "at"), lambda batch, n: seen.extend(r["_id"] for r in batch.collect()), max_wait=12)
    assert time.monotonic() - begin < 60 and sorted(seen) == [f"{k:016x}" for k in (2, 3, 4)]


def test_writes_publish_events(spark, tmp_path):
    cat = Catalog(spark)
    db = cat["app"]
    db.log = ChangeLog(spark, str(tmp_path / "log"))
    c = db.create("c")
    c.insert([{"_id": 1, "n": 1, "s": "x"}, {"_id": 2, "n": 2, "s": "y"}])
    c.update({"_id": 1}, {"$set": {"n": 5}, "$unset": {"s": ""}})
    c.update({"_id": 1}, {"$set": {"n": 5}})
    c.update({"_id": 2}, {"n": 7})
    c.find_and_modify({"_id": 2}, {"$inc": {"n": 1}})
    c.update({"_id": 9}, {"$set": {"n": 0}}, upsert=True)
    c.delete({"_id": 1})
    c.delete({"_id": 77})
    db.rename("c", "d")
    db.create("e")
    cat.drop_database("app")
    rows = db.log.watch(after="0" * 16, streaming=False, full_document="updateLookup", before_change="whenAvailable").orderBy("_id").collect()
    assert [r["operationType"] for r in rows] == ["create", "insert", "insert", "update", "replace", "update", "insert", "delete", "rename", "create", "drop", "drop", "dropDatabase"]
    change = rows[3]["updateDescription"]
    assert dict(change["updatedFields"]) == {"n": "5"} and change["removedFields"] == ["s"]
    assert rows[7]["fullDocumentBeforeChange"].toPython() == {"_id": 1, "n": 5} and rows[3]["documentKey"].toPython() == {"_id": 1}
    with pytest.raises(EngineError, match="IllegalOperation"):
        Database(spark).aggregate([{"$changeStream": {}}])
    with pytest.raises(EngineError, match="InvalidOptions"):
        db.watch({"nope": 1})
