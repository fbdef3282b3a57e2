"""Stages, expressions, accumulators, lookups and windows on small documents."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions.errors import EngineError
from lodestone.operators.expressions import Scope, compile_expr, register_expr_op
from lodestone.functions.values import Typed
from lodestone.plans import pipeline


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


@pytest.fixture
def people(db):
    c = db.documents([{"_id": i, "name": n, "age": a, "category": k, "value": v, "tags": t} for i, n, a, k, v, t in [(1, "Ann", 30, "x", 10, ["a", "b"]), (2, "Bob", 25, "y", 20, []), (3, "Cid", 35, "x", 30, ["b"]), (4, "Dan", None, "y", 40, None), (5, "Eve", 28, None, 50, ["c", "c"])]])
    db._collections["people"] = c
    return c


def test_find_sort_skip_limit_project(people):
    got = people.find({"age": {"$exists": True}}, {"name": 1}, {"age": -1}, skip=1, limit=2)
    assert rows(got) == [{"_id": 1, "name": "Ann"}, {"_id": 5, "name": "Eve"}]
    assert [r["_id"] for r in rows(people.find({}, sort={"age": 1}))] == [4, 2, 5, 1, 3]
    assert [r["_id"] for r in rows(people.find({}, limit=-2))] == [1, 2]


def test_projection_forms(people):
    assert set(people.find({}, {"_id": 0, "name": 1}).columns) == {"name"}
    assert set(people.find({}, {"name": 0, "tags": 0}).columns) == {"_id", "age", "category", "value"}
    assert rows(people.find({"_id": 1}, {"_id": 1})) == [{"_id": 1}]
    assert rows(people.find({"_id": 1}, {"twice": {"$multiply": ["$value", 2]}, "n": "$name"})) == [{"_id": 1, "twice": 20, "n": "Ann"}]
    with pytest.raises(EngineError):
        people.find({}, {"name": 1, "age": 0})
    with pytest.raises(EngineError):
        people.find({}, {"x": {"$add": [1], "$concat": []}})


def test_expression_values(people):
    def one(spec, doc=1):
        return rows(people.aggregate([{"$match": {"_id": doc}}, {"$project": {"_id": 0, "x": spec}}]))[0]["x"]

    assert one({"$add": ["$value", None, "$age"]}) == 40
    assert one({"$add": ["$name", "!"]}) == "Ann!"
    assert one({"$subtract": ["$value", 0.5]}) == 9.5
    assert one({"$divide": ["$value", 4]}) == 2.5
    assert one({"$concat": ["$name", "-", 1.0]}) == "Ann-1"
    assert one({"$concat": ["$name", "$nothing"]}) is None
    assert one({"$toUpper": "$name"}) == "ANN"
    assert one({"$arrayElemAt": ["$tags", -1]}) == "b"
    assert one({"$arrayElemAt": ["$tags", 5]}) is None
    assert one({"$arrayElemAt": ["$tags", -3]}) is None
    assert one({"$ifNull": ["$age", 7]}, 4) == 7
    assert one({"$cond": ["$age", "some", "none"]}, 4) == "none"
    assert one({"$lt": ["$age", 1]}, 4) is True
    assert one({"$gt": ["$name", 5]}) is True
    assert one({"$eq": ["$nothing", None]}) is True
    assert one({"$and": []}) is True
    assert one({"$or": []}) is False
    assert one({"$not": ["$nothing"]}) is True
    assert one("$$ROOT.name") == "Ann"


def test_expression_errors(people):
    for spec in ({"$multiply": ["$value"]}, {"$nope": 1}, "$$undefined", {"$toUpper": "$age"}, {"$multiply": ["$name", 2]}):
        with pytest.raises(EngineError):
            people.aggregate([{"$addFields": {"x": spec}}])
    with pytest.raises(Exception, match="divide by zero"):
        people.aggregate([{"$addFields": {"x": {"$divide": ["$value", 0]}}}]).collect()


def test_own_expression_operator(people):
    register_expr_op("$negate", lambda operand, scope: Typed(-compile_expr(operand, scope).column, compile_expr(operand, scope).type))
    assert isinstance(Scope(people.df.schema).visible(), list)
    assert rows(people.aggregate([{"$match": {"_id": 1}}, {"$project": {"x": {"$negate": "$value"}}}]))[0]["x"] == -10


def test_add_fields_sees_the_original_and_sets_dotted_paths(people):
    got = rows(people.aggregate([{"$match": {"_id": 1}}, {"$addFields": {"value": 1, "copy": "$value", "deep.er": "$name", "tags.0": "z"}}]))[0]
    assert (got["value"], got["copy"], got["deep"], got["tags"]) == (1, 10, {"er": "Ann"}, ["z", "b"])


def test_group(people):
    got = {r["_id"]: r for r in rows(people.aggregate([{"$group": {"_id": "$category", "n": {"$sum": 1}, "avg": {"$avg": "$age"}, "first": {"$first": "$age"}, "last": {"$last": "$age"}, "all": {"$push": "$age"}, "text": {"$sum": "$name"}}}]))}
    assert got["x"]["n"] == 2 and got["x"]["avg"] == 32.5 and got["x"]["text"] == 0
    assert got["y"]["first"] == 25 and got["y"]["last"] is None and got["y"]["all"] == [25, None] and got["y"]["avg"] == 25
    assert got[None]["n"] == 1
    sets = {r["_id"]: r["s"] for r in rows(people.aggregate([{"$unwind": "$tags"}, {"$group": {"_id": None, "s": {"$addToSet": "$tags"}}}]))}
    assert sets[None] == ["a", "b", "c"]


def test_group_after_descending_sort(people):
    got = rows(people.aggregate([{"$sort": {"name": -1}}, {"$group": {"_id": None, "first": {"$first": "$name"}, "all": {"$push": "$_id"}}}]))
    assert got[0]["first"] == "Eve" and got[0]["all"] == [5, 4, 3, 2, 1]


def test_empty_input(people):
    none = {"$match": {"_id": 99}}
    assert rows(people.aggregate([none, {"$group": {"_id": None, "n": {"$sum": 1}}}])) == []
    assert rows(people.aggregate([none, {"$count": "n"}])) == [{"n": 0}]


def test_unwind(people):
    assert [(r["_id"], r["tags"]) for r in rows(people.aggregate([{"$unwind": "$tags"}, {"$sort": {"_id": 1}}]))] == [(1, "a"), (1, "b"), (3, "b"), (5, "c"), (5, "c")]
    kept = people.aggregate([{"$unwind": {"path": "$tags", "preserveNullAndEmptyArrays": True}}, {"$match": {"tags": None}}])
    assert sorted(r["_id"] for r in rows(kept)) == [2, 4]
    assert people.aggregate([{"$unwind": "$age"}]).count() == 4


def test_replace_root(people):
    assert rows(people.aggregate([{"$match": {"_id": 1}}, {"$addFields": {"d": "$$ROOT"}}, {"$replaceRoot": {"newRoot": "$d"}}]))[0]["name"] == "Ann"
    with pytest.raises(EngineError):
        people.aggregate([{"$replaceRoot": {"newRoot": "$name"}}])


@pytest.mark.parametrize("stages", [[{"$nope": 1}], [{"$limit": -1}], [{"$skip": "x"}], [{"$match": 5}], [{"$sort": {}}], [{"$group": {"n": {"$sum": 1}}}], [{"$group": {"_id": 1, "n": {"$median": 1}}}], [{"$unwind": "tags"}], [{"a": 1, "b": 2}], [{"$lookup": {"from": "x", "as": "y"}}], [{"$lookup": {"from": "x", "as": "y", "localField": "a"}}], [{"$count": ""}]])
def test_bad_stages(people, stages):
    with pytest.raises(EngineError):
        people.aggregate(stages)


# --- lookup ------------------------------------------------------------------


@pytest.fixture
def shop(db):
    for name, docs in {
        "orders": [{"_id": 1, "c": "a", "item": "pen", "parts": [1, 2, 2]}, {"_id": 2, "c": "b", "item": "ink", "parts": [9]}, {"_id": 3, "c": "a", "item": "cup", "parts": []}, {"_id": 4, "c": None, "item": "hat", "parts": None}],
        "customers": [{"_id": "a", "name": "Ann", "credit": 5}, {"_id": "z", "name": "Zed", "credit": 1}, {"_id": None, "name": "Nul", "credit": 2}],
        "parts": [{"_id": 1, "w": 10}, {"_id": 2, "w": 20}, {"_id": 3, "w": 30}],
    }.items():
        db._collections[name] = db.documents(docs)
    return db


def test_lookup_equality_with_null_keys(shop):
    got = {r["_id"]: [c["name"] for c in r["who"]] for r in rows(shop["orders"].aggregate([{"$lookup": {"from": "customers", "localField": "c", "foreignField": "_id", "as": "who"}}]))}
    assert got == {1: ["Ann"], 2: [], 3: ["Ann"], 4: ["Nul"]}


def test_lookup_array_local_key(shop):
    got = {r["_id"]: [p["w"] for p in r["p"]] for r in rows(shop["orders"].aggregate([{"$lookup": {"from": "parts", "localField": "parts", "foreignField": "_id", "as": "p"}}]))}
    assert got == {1: [10, 20], 2: [], 3: [], 4: []}


def test_lookup_array_local_key_finds_each_document_once(spark, db):
    docs = spark.createDataFrame([(1, [0.0, -0.0, 2.0, None, 2.0]), (2, []), (3, None), (4, [7.0])], "k int, a array<double>")
    db.register("l", docs.withColumn("__ord", F.struct("k")), ["k"])
    # Two documents of one place in the natural order are still two.
    db.register("r", spark.createDataFrame([(1, 0, "x"), (1, 0, "y"), (2, 2, "z"), (3, None, "n")], "id int, v int, t string").withColumn("__ord", F.struct("id")), ["id"])
    at = {"from": "r", "localField": "a", "foreignField": "v", "as": "o"}
    assert {r["k"]: [o["t"] for o in r["o"]] for r in rows(db["l"].aggregate([{"$lookup": at}]))} == {1: ["x", "y", "z", "n"], 2: [], 3: [], 4: []}
    let = at | {"let": {"q": "$k"}, "pipeline": [{"$addFields": {"m": "$$q"}}]}
    assert {r["k"]: [o["m"] for o in r["o"]] for r in rows(db["l"].aggregate([{"$lookup": let}]))} == {1: [1, 1, 1, 1], 2: [], 3: [], 4: []}


def test_lookup_array_local_key_gathers_in_partitions_of_the_input(spark, sf, monkeypatch):
    from lodestone.plans import catalogue

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    few = catalogue.queries()["lookup_array_local_all"](spark, sf)
    assert "REPARTITION_BY_NUM" not in plan(few)
    monkeypatch.setattr(pipeline, "PART_BYTES", 4096)
    many = catalogue.queries()["lookup_array_local_all"](spark, sf)
    parts = pipeline._parts(spark.read.parquet(f"{sf}/lineitem.parquet"), spark.read.parquet(f"{sf}/part.parquet"))
    assert parts > 8 and f", {parts}), REPARTITION_BY_NUM" in plan(many)
    assert sorted(many.collect()) == sorted(few.collect())
    # Pairs are joined and gathered: no sort of whole documents to drop repeated ones.
    assert "first(p_name" not in plan(few)


def test_lookup_missing_collection(shop):
    assert all(r["x"] == [] for r in rows(shop["orders"].aggregate([{"$lookup": {"from": "none", "localField": "c", "foreignField": "_id", "as": "x"}}])))


def test_lookup_sub_pipelines(shop):
    at = {"from": "orders", "localField": "_id", "foreignField": "c", "as": "o"}
    top = {r["_id"]: [o["item"] for o in r["o"]] for r in rows(shop["customers"].aggregate([{"$lookup": at | {"pipeline": [{"$sort": {"item": 1}}, {"$limit": 1}]}}]))}
    assert top == {"a": ["cup"], "z": [], None: ["hat"]}
    count = {r["_id"]: r["o"] for r in rows(shop["customers"].aggregate([{"$lookup": at | {"pipeline": [{"$count": "n"}]}}]))}
    assert count == {"a": [{"n": 2}], "z": [{"n": 0}], None: [{"n": 1}]}
    let = {r["_id"]: [o["who"] for o in r["o"]] for r in rows(shop["customers"].aggregate([{"$lookup": at | {"let": {"w": "$name"}, "pipeline": [{"$addFields": {"who": "$$w"}}]}}]))}
    assert let == {"a": ["Ann", "Ann"], "z": [], None: ["Nul"]}
    free = rows(shop["customers"].aggregate([{"$lookup": {"from": "parts", "as": "p", "pipeline": [{"$match": {"w": {"$gt": 10}}}, {"$skip": 1}]}}]))
    assert all([p["_id"] for p in r["p"]] == [3] for r in free) and len(free) == 3


def test_lookup_then_array_elem_and_if_null(shop):
    stages = [{"$lookup": {"from": "customers", "localField": "c", "foreignField": "_id", "as": "w"}}, {"$addFields": {"w": {"$arrayElemAt": ["$w", 0]}}}, {"$addFields": {"credit": {"$ifNull": ["$w.credit", -1]}}}, {"$project": {"w": 0}}]
    assert {r["_id"]: r["credit"] for r in rows(shop["orders"].aggregate(stages))} == {1: 5, 2: -1, 3: 5, 4: 2}


def test_plain_joins_have_no_nested_arrays(shop):
    to = {"$lookup": {"from": "customers", "localField": "c", "foreignField": "_id", "as": "w"}}
    inner = shop["orders"].aggregate([to, {"$unwind": "$w"}])
    assert sorted(r["_id"] for r in rows(inner)) == [1, 3, 4]
    assert "collect_list" not in inner._jdf.queryExecution().toString()
    left = rows(shop["orders"].aggregate([to, {"$unwind": {"path": "$w", "preserveNullAndEmptyArrays": True}}]))
    assert {r["_id"]: r["w"] and r["w"]["name"] for r in left} == {1: "Ann", 2: None, 3: "Ann", 4: "Nul"}
    anti = shop["orders"].aggregate([to, {"$match": {"w": []}}])
    assert [(r["_id"], r["w"]) for r in rows(anti)] == [(2, [])] and "LeftAnti" in anti._jdf.queryExecution().toString()
    semi = shop["orders"].aggregate([to, {"$match": {"w.0": {"$exists": True}}}, {"$project": {"item": 1}}])
    assert sorted(r["_id"] for r in rows(semi)) == [1, 3, 4] and "LeftSemi" in semi._jdf.queryExecution().toString()
    kept = rows(shop["orders"].aggregate([to, {"$match": {"w.0": {"$exists": True}}}]))
    assert all(len(r["w"]) == 1 for r in kept)


# --- windows -----------------------------------------------------------------


def windows(db, docs, spec):
    return {r["_id"]: r["w"] for r in rows(db.documents(docs).aggregate([{"$setWindowFields": spec}]))}


def test_rank_and_document_number(db):
    docs = [{"_id": i, "s": s} for i, s in enumerate([100, 90, 90, 80])]
    assert windows(db, docs, {"sortBy": {"s": -1}, "output": {"w": {"$rank": {}}}}) == {0: 1, 1: 2, 2: 2, 3: 4}
    assert windows(db, docs, {"sortBy": {"s": -1}, "output": {"w": {"$documentNumber": {}}}}) == {0: 1, 1: 2, 2: 3, 3: 4}
    assert windows(db, docs, {"output": {"w": {"$rank": {}}}}) == {0: 1, 1: 1, 2: 1, 3: 1}


@pytest.mark.parametrize("name", ["$sum", "$min", "$max", "$avg", "$first", "$last"])
@pytest.mark.parametrize("lo,hi", [(-3, -2), (2, 3), (-1, 1), (0, 0), ("unbounded", -1), (1, "unbounded"), (-9, -8), (8, 9)])
def test_frames_are_clamped(db, name, lo, hi):
    values = [3, None, 7, 1, 5]
    docs = [{"_id": i, "v": v} for i, v in enumerate(values)]
    got = windows(db, docs, {"sortBy": {"_id": 1}, "output": {"w": {name: "$v", "window": {"documents": [lo, hi]}}}})
    for i in range(5):
        a = 0 if lo == "unbounded" else min(max(i + lo, 0), 4)
        b = 4 if hi == "unbounded" else min(max(i + hi, 0), 4)
        frame, some = values[a : b + 1], [v for v in values[a : b + 1] if v is not None]
        want = {"$sum": sum(some), "$min": min(some, default=None), "$max": max(some, default=None), "$avg": sum(some) / len(some) if some else None, "$first": frame[0], "$last": frame[-1]}[name]
        assert got[i] == want, (i, frame)


@pytest.mark.parametrize("sort", [{"t": 1}, {"d": -1, "q": 1}, {"t": -1}, None])
def test_windows_without_partition_equal_one_partition(spark, db, sort):
    """Ties, a value of a third of the rows, nulls and not-a-numbers; ranges must not change any value."""
    n = 1200
    k = F.col("id")
    hot = F.when(k % 3 == 0, "hot").otherwise(F.concat(F.lit("v"), (k % 97).cast("string")))
    real = F.when(k % 11 == 0, None).when(k % 13 == 0, float("nan")).otherwise(k * 31 % 1000 / 8)
    docs = db.register("w", spark.range(n).select((k * 7919 % n).alias("k"), hot.alias("t"), real.alias("d"), (k % 5).alias("q"), F.lit(1).alias("one")), order=["k"])
    output = {"place": {"$documentNumber": {}}, "rank": {"$rank": {}}, "first": {"$first": "$t"}}
    frames = [["unbounded", "unbounded"], ["unbounded", "current"], ["unbounded", -3], [2, "unbounded"], [-2, 1], [300, 310], [2, 1]]
    for i, frame in enumerate(frames):
        output |= {f"{name[1:]}{i}": {name: "$q" if name in ("$sum", "$avg") else "$d", "window": {"documents": frame}} for name in ("$sum", "$avg", "$min", "$max", "$first", "$last")[i % 2 :: 2]}
    spec = {"output": output} | ({"sortBy": sort} if sort else {})
    got = docs.aggregate([{"$setWindowFields": spec}])
    want = docs.aggregate([{"$setWindowFields": spec | {"partitionBy": "$one"}}])
    assert got.columns == want.columns
    assert [repr(r) for r in got.orderBy("k").collect()] == [repr(r) for r in want.orderBy("k").collect()]


def test_windows_without_partition_stay_distributed(spark, db):
    docs = db.register("w", spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 7).alias("s")), order=["k"])
    plan = docs.aggregate([{"$setWindowFields": {"sortBy": {"s": -1}, "output": {"n": {"$documentNumber": {}}, "w": {"$sum": "$k", "window": {"documents": [-1, 1]}}}}}])._jdf.queryExecution().executedPlan().toString()
    over_rows = [line for line in plan.splitlines() if " Window " in line and "sum(__wn" not in line]
    assert over_rows and all("[__wb#" in line or "[__wx#" in line for line in over_rows)


def test_windows_of_an_empty_table(spark, db):
    docs = db.register("w", spark.createDataFrame([], "k bigint, s string"), order=["k"])
    assert docs.aggregate([{"$setWindowFields": {"sortBy": {"s": 1}, "output": {"r": {"$rank": {}}, "w": {"$avg": "$k", "window": {"documents": [-1, 1]}}, "n": {"$documentNumber": {}}}}}]).collect() == []


def test_window_errors(people):
    for output in ({"$median": "$v"}, {"$sum": "$v", "window": {"range": [0, 1]}}, {"$sum": "$v", "window": {"documents": [3, 1]}}):
        with pytest.raises(EngineError):
            people.aggregate([{"$setWindowFields": {"sortBy": {"_id": 1}, "output": {"w": output}}}])


def test_own_stage(people):
    pipeline.register_stage("$onlyFirst", lambda frame, spec, context: frame.but(frame.df.where("_id = 1")))
    assert people.aggregate([{"$onlyFirst": {}}]).count() == 1


# --- text --------------------------------------------------------------------


def test_text(db):
    docs = [{"_id": 1, "t": "Red fox red", "u": ["deep Fox"], "s": "x"}, {"_id": 2, "t": "fox,", "u": None, "s": "y"}, {"_id": 3, "t": "a\tRED\nb", "u": ["red", None], "s": "x"}]
    c = db.documents(docs)
    with pytest.raises(EngineError, match="IndexNotFound"):
        c.find({"$text": {"$search": "red"}})
    c.create_index({"t": "text"})
    assert sorted(r["_id"] for r in rows(c.find({"$text": {"$search": "RED"}}))) == [1, 3]
    scored = {r["_id"]: r["n"] for r in rows(c.find({"$text": {"$search": "red red fox"}}, {"n": {"$meta": "textScore"}}))}
    assert scored == {1: 5, 3: 2}
    assert rows(c.find({"$text": {"$search": "red"}, "s": "x"}, sort={"n": {"$meta": "textScore"}}))[0]["_id"] == 1
    assert c.find({"$text": {"$search": "  "}}).count() == 0
    assert c.count({"$text": {"$search": "fox"}}).first()[0] == 1
    c.drop_index("t_text")
    c.create_index({"$**": "text"})
    assert {r["_id"]: r["n"] for r in rows(c.aggregate([{"$match": {"$text": {"$search": "fox red"}}}, {"$project": {"n": {"$meta": "textScore"}}}]))} == {1: 4, 3: 2}


# --- mixed types -------------------------------------------------------------


def test_variant_sort_group_distinct_and_unwind(spark, db):
    from pyspark.sql import functions as F

    docs = [(1, '{"x":"b"}'), (2, '{"x":3}'), (3, '{"x":null}'), (4, '{"x":3.0}'), (5, '{"x":[1,2]}'), (6, '{"x":true}'), (7, "{}")]
    c = db.register("mixed", spark.createDataFrame(docs, "_id int, j string").select("_id", F.parse_json("j").alias("v")))
    assert [r["_id"] for r in c.find({}, {"_id": 1}, {"v.x": 1}).collect()] == [3, 7, 2, 4, 1, 5, 6]
    groups = c.aggregate([{"$group": {"_id": "$v.x", "n": {"$sum": 1}}}])
    assert sorted(r["n"] for r in groups.collect()) == [1, 1, 1, 2, 2]
    assert c.distinct("v.x").count() == 6
    assert c.aggregate([{"$unwind": "$v.x"}]).count() == 6


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_sort_before_a_group_sorts_no_rows(db):
    c = db.documents([{"_id": i, "k": i % 2, "n": (i * 7) % 5} for i in range(10)])
    got = c.aggregate([{"$sort": {"n": -1}}, {"$match": {"n": {"$gte": 0}}}, {"$group": {"_id": "$k", "first": {"$first": "$_id"}, "all": {"$push": "$n"}}}])
    assert "rangepartitioning" not in plan_of(got)
    assert {r["_id"]: (r["first"], r["all"]) for r in got.collect()} == {0: (2, [4, 3, 2, 1, 0]), 1: (7, [4, 3, 2, 1, 0])}
    assert "rangepartitioning" in plan_of(c.aggregate([{"$sort": {"n": -1}}, {"$project": {"n": 1}}]))


def test_a_sub_pipeline_with_unwind_is_a_join(db):
    db._collections["l"] = db.documents([{"_id": i, "k": i % 3 if i < 8 else None} for i in range(9)])
    db._collections["r"] = db.documents([{"_id": i, "k": i % 2, "n": i} for i in range(6)])
    lookup = {"$lookup": {"from": "r", "localField": "k", "foreignField": "k", "pipeline": [{"$sort": {"n": -1}}, {"$limit": 2}, {"$project": {"n": 1}}], "as": "x"}}
    for keep in (False, True):
        unwind = {"$unwind": {"path": "$x", "preserveNullAndEmptyArrays": keep}}
        joined = db["l"].aggregate([lookup, unwind])
        nested = db.register("n", db["l"].aggregate([lookup]), ["_id"]).aggregate([unwind])
        assert "collect_list" not in plan_of(joined) and "Generate" not in plan_of(joined)
        both = [sorted(str((r["_id"], r["x"] and r["x"]["n"])) for r in df.collect()) for df in (joined, nested)]
        assert both[0] == both[1] and len(both[0]) == (12 if not keep else 15)
