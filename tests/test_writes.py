"""Updates, deletes, upserts, unique keys, namespaces and cursors."""

import time

import pytest

from lodestone.functions.errors import EngineError
from lodestone.plans.collection import Catalog, Database, Index, deadline


def docs(c):
    return {r["_id"]: r.asDict(recursive=True) for r in c.df.collect()}


def make(db, rows):
    db._collections["c"] = db.documents(rows)
    return db["c"]


CASES = [
    ({"$set": {"n": 9}}, {"n": 9}),
    ({"$set": {"p.a": 5}}, {"p": {"a": 5, "b": "x"}}),
    ({"$set": {"p.new": True}}, {"p": {"a": 1, "b": "x", "new": True}}),
    ({"$set": {"v.1": 7}}, {"v": [3, 7, 2]}),
    ({"$set": {"v.4": 7}}, {"v": [3, 1, 2, None, 7]}),
    ({"$set": {"fresh": "f"}}, {"fresh": "f"}),
    ({"$unset": {"n": ""}}, {"n": None}),
    ({"$inc": {"n": 2}}, {"n": 6}),
    ({"$inc": {"gone": 2}}, {"gone": 2}),
    ({"$inc": {"n": 0.5}}, {"n": 4.5}),
    ({"$mul": {"n": 3}}, {"n": 12.0}),
    ({"$mul": {"gone": 3}}, {"gone": 0}),
    ({"$min": {"n": 3}}, {"n": 3}),
    ({"$min": {"n": 30}}, {"n": 4}),
    ({"$max": {"n": 30}}, {"n": 30}),
    ({"$push": {"v": 8}}, {"v": [3, 1, 2, 8]}),
    ({"$push": {"fresh": "a"}}, {"fresh": ["a"]}),
    ({"$push": {"v": {"$each": [9, 8], "$position": 1}}}, {"v": [3, 9, 8, 1, 2]}),
    ({"$push": {"v": {"$each": [9], "$position": -1}}}, {"v": [3, 1, 9, 2]}),
    ({"$push": {"v": {"$each": [0], "$sort": 1}}}, {"v": [0, 1, 2, 3]}),
    ({"$push": {"v": {"$each": [5], "$sort": -1, "$slice": 2}}}, {"v": [5, 3]}),
    ({"$push": {"v": {"$each": [], "$slice": -2}}}, {"v": [1, 2]}),
    ({"$push": {"v": {"$each": [], "$slice": 0}}}, {"v": []}),
    ({"$push": {"d": {"$each": [{"k": 0, "t": "c"}], "$sort": {"k": 1}}}}, {"d": [{"k": 0, "t": "c"}, {"k": 1, "t": "b"}, {"k": 2, "t": "a"}]}),
    ({"$pull": {"v": 1}}, {"v": [3, 2]}),
    ({"$pull": {"v": 1.0}}, {"v": [3, 2]}),
    ({"$pull": {"d": {"k": 1, "t": "b"}}}, {"d": [{"k": 2, "t": "a"}]}),
    ({"$pullAll": {"v": [1, 3, 77]}}, {"v": [2]}),
    ({"$pop": {"v": 1}}, {"v": [3, 1]}),
    ({"$pop": {"v": -1}}, {"v": [1, 2]}),
    ({"$addToSet": {"v": 1}}, {"v": [3, 1, 2]}),
    ({"$addToSet": {"v": {"$each": [1, 9, 9]}}}, {"v": [3, 1, 2, 9]}),
    ({"$rename": {"n": "m"}}, {"n": None, "m": 4}),
    ({"$set": {"n": 1}, "$push": {"v": 5}}, {"n": 1, "v": [3, 1, 2, 5]}),
    ({"$setOnInsert": {"n": 77}}, {"n": 4}),
]


@pytest.mark.parametrize("change,want", CASES, ids=[str(c[0])[:70] for c in CASES])
def test_operators(db, change, want):
    c = make(db, [{"_id": 1, "n": 4, "v": [3, 1, 2], "p": {"a": 1, "b": "x"}, "d": [{"k": 2, "t": "a"}, {"k": 1, "t": "b"}]}, {"_id": 2, "n": 5, "v": [], "p": {"a": 2, "b": "y"}, "d": []}])
    before = docs(c)
    result = c.update({"_id": 1}, change)
    assert result.matched == 1
    now = docs(c)
    for k, v in want.items():
        assert now[1][k] == v
    other = {k: {n: x for n, x in v.items() if n in before[2][k]} if isinstance(v, dict) else v for k, v in now[2].items() if k in before[2]}
    assert other == before[2]
    assert result.modified == int(any(now[1].get(k) != before[1].get(k) for k in want))


def test_null_elements_survive_pull(db):
    c = make(db, [{"_id": 1, "v": [1, None, 2]}])
    c.update({}, {"$pull": {"v": 1}})
    assert docs(c)[1]["v"] == [None, 2]
    c.update({}, {"$pullAll": {"v": [None]}})
    assert docs(c)[1]["v"] == [2]


@pytest.mark.parametrize("change", [{"$set": {"_id": 5}}, {"$nope": {"a": 1}}, {"$inc": {"t": 1}}, {"$inc": {"n": "x"}}, {"$pop": {"v": 3}}, {"$push": {"n": 1}}, {"$set": 5}, {"$set": {"a": 1}, "b": 2}])
def test_bad_updates(db, change):
    c = make(db, [{"_id": 1, "n": 4, "t": "x", "v": [1]}])
    with pytest.raises(EngineError):
        c.update({}, change)


def test_one_many_replace_upsert_delete(db):
    c = make(db, [{"_id": i, "k": i % 2, "s": "x"} for i in range(4)])
    assert c.update({"k": 1}, {"$set": {"s": "y"}}).matched == 1 and [d["s"] for d in docs(c).values()].count("y") == 1
    many = c.update({"k": 1}, {"$set": {"s": "y"}}, many=True)
    assert (many.matched, many.modified) == (2, 1)
    c.update({"_id": 0}, {"k": 8})
    assert docs(c)[0] == {"_id": 0, "k": 8, "s": None}
    with pytest.raises(EngineError, match="ImmutableField"):
        c.update({"_id": 0}, {"_id": 9, "k": 8})
    up = c.update({"_id": 50}, {"$set": {"k": 3}, "$setOnInsert": {"s": "new"}}, upsert=True)
    assert up.upserted_id == 50 and docs(c)[50] == {"_id": 50, "k": 3, "s": "new"}
    assert c.delete({"k": 1}).deleted == 1 and c.delete({"k": 1}, many=True).deleted == 1
    assert sorted(docs(c)) == [0, 2, 50]


def test_find_and_modify(db):
    c = make(db, [{"_id": 1, "n": 5}, {"_id": 2, "n": 9}])
    assert c.find_and_modify({}, {"$inc": {"n": 1}}, sort={"n": -1}) == {"_id": 2, "n": 9}
    assert c.find_and_modify({"_id": 2}, {"$inc": {"n": 1}}, new=True) == {"_id": 2, "n": 11}
    assert c.find_and_modify({"_id": 77}, {"$inc": {"n": 1}}) is None
    assert c.find_and_modify({"_id": 77}, {"$set": {"n": 1}}, upsert=True, new=True) == {"_id": 77, "n": 1}
    assert c.find_and_modify({"_id": 1}, remove=True) == {"_id": 1, "n": 5} and sorted(docs(c)) == [2, 77]


def test_insert_and_unique_keys(db):
    c = make(db, [{"_id": 1, "email": "a", "tags": ["x"]}])
    got = c.insert([{"_id": 2, "email": "b", "tags": ["y"]}, {"_id": 1.0, "email": "c", "tags": []}, {"_id": 3, "email": "d", "tags": []}])
    assert got.inserted == 1 and got.errors[0]["index"] == 1 and got.errors[0]["code"] == 11000
    got = c.insert([{"_id": 1, "email": "c", "tags": []}, {"_id": 3, "email": "d", "tags": []}], ordered=False)
    assert got.inserted == 1 and len(got.errors) == 1
    c.create_index({"email": 1}, unique=True)
    assert c.insert([{"_id": 9, "email": "a", "tags": []}]).inserted == 0
    c.create_index({"tags": 1}, name="t", unique=True, sparse=True, partial={"_id": {"$lt": 100}})
    assert c.insert([{"_id": 10, "email": "q", "tags": ["y", "z"]}]).errors
    assert c.insert([{"_id": 200, "email": "r", "tags": ["y"]}]).inserted == 1
    with pytest.raises(EngineError, match="DuplicateKey"):
        c.update({"_id": 2}, {"$set": {"email": "same"}}, many=True) and c.update({"_id": 3}, {"$set": {"email": "same"}}) and c.create_index({"email": 1}, name="again", unique=True)
    assert [i.name for i in c.list_indexes()][:2] == ["_id_", "email_1"]
    assert Index("g", {"p": "2dsphere"}).kind == "2dsphere" and Index("h", {"a": 1, "b": 1}).kind == "compound"
    with pytest.raises(EngineError, match="IndexNotFound"):
        c.drop_index("none")


def test_versions_are_copies(db):
    c = make(db, [{"_id": 1, "n": 1}])
    old = c.df
    c.update({}, {"$set": {"n": 2}})
    assert old.first()["n"] == 1 and c.df.first()["n"] == 2 and c.version == 1


def test_namespaces_distinct_cursor_stats_explain(spark):
    cat = Catalog(spark)
    db = cat["app"]
    db._collections["c"] = db.documents([{"_id": i, "t": ["a", "b"] if i % 2 else None, "n": i % 3} for i in range(10)])
    assert sorted(r["value"] for r in db["c"].distinct("t").collect()) == ["a", "b"]
    assert sorted(r["value"] for r in db["c"].distinct("n", {"_id": {"$lt": 2}}).collect()) == [0, 1]
    cursor = db["c"].cursor({}, batch_size=4)
    assert [len(cursor.next_batch()) for _ in range(4)] == [4, 4, 2, 0]
    cursor.kill()
    with pytest.raises(EngineError, match="CursorNotFound"):
        cursor.next_batch()
    assert db["c"].stats().first()["count"] == 10 and db.stats().count() == 1
    assert "Physical Plan" in db["c"].explain({"n": 1})
    db.create("d")
    with pytest.raises(EngineError, match="NamespaceExists"):
        db.create("d")
    db.rename("d", "e")
    assert [r["name"] for r in db.list_collections({"name": "e"}).collect()] == ["e"]
    db.drop("e")
    with pytest.raises(EngineError, match="NamespaceNotFound"):
        db.drop("e")
    assert cat.list_databases({"name": "app"}).count() == 1
    cat.drop_database("app")
    assert cat.list_databases().count() == 0


def test_changed_collections_and_restore(db):
    c = make(db, [{"_id": 1, "n": 1}])
    db.register("other", c.df)
    assert db.changed() == []
    c.update({}, {"$set": {"n": 2}})
    assert db.changed() == ["c"]
    c.restore()
    assert db.changed() == [] and docs(c)[1]["n"] == 1


def test_stored_versions_keep_plans_small(spark, tmp_path):
    db = Database(spark, versions=str(tmp_path / "versions"))
    c = make(db, [{"_id": k, "n": 0} for k in range(5)])
    sizes = []
    for k in range(4):
        assert c.update({"_id": {"$lt": k + 1}}, {"$inc": {"n": 1}}, many=True).modified == k + 1
        sizes.append(len(c.df._jdf.queryExecution().optimizedPlan().toString()))
    assert max(sizes) < 1.5 * min(sizes) and {d: v["n"] for d, v in docs(c).items()} == {0: 4, 1: 3, 2: 2, 3: 1, 4: 0}
    c.delete({"_id": 0})
    c.insert([{"_id": 9, "n": 1}])
    assert sorted(docs(c)) == [1, 2, 3, 4, 9]


def test_collmod(db):
    c = make(db, [{"_id": 1, "at": 1}])
    c.create_index({"at": 1}, expire_after=5)
    assert db.coll_mod("c", {"name": "at_1", "expireAfterSeconds": 60}) == {"expireAfterSeconds_old": 5, "expireAfterSeconds_new": 60}
    assert db.coll_mod("c", {"keyPattern": {"at": 1}, "expireAfterSeconds": 7})["expireAfterSeconds_new"] == 7 and db.coll_mod("c") == {}
    with pytest.raises(EngineError, match="IndexNotFound"):
        db.coll_mod("c", {"name": "none", "expireAfterSeconds": 60})
    with pytest.raises(EngineError, match="NamespaceNotFound"):
        db.coll_mod("nowhere")


def test_deadlines(spark, db):
    slow = spark.range(0, 1 << 38, 1, 4).selectExpr("sum(id % 7 * (id % 11))")
    with pytest.raises(EngineError, match="MaxTimeMSExpired"), deadline(spark, 300):
        slow.collect()
    with pytest.raises(EngineError, match="MaxTimeMSExpired"), deadline(spark, 50):
        time.sleep(0.3)  # the job starts after the deadline
        slow.collect()
    with deadline(spark, 60_000):
        assert spark.range(3).count() == 3
    for bad in ("x", -1, 1 << 40, True):
        with pytest.raises(EngineError, match="BadValue"), deadline(spark, bad):
            pass
    c = make(db, [{"_id": k} for k in range(5)])
    assert len(c.cursor({}, batch_size=3, max_time_ms=60_000).next_batch()) == 3
    with pytest.raises(EngineError, match="BadValue"):
        c.cursor({}, max_time_ms=-1)
