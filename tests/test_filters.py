"""Truth of filters on native and VARIANT documents."""

import re

import pytest
from pyspark.sql import functions as F

from lodestone.functions.errors import EngineError
from lodestone.operators.filters import compile_filter, register_filter_op

TYPED = "_id int, age int, name string, score double, tags array<string>, nums array<int>, addr struct<city:string>, users array<struct<age:int,status:string>>"
ROWS = [
    (1, 25, "Ann", 1.5, ["a", "b"], [1, 2], ("Rome",), [(30, "on"), (10, "off")]),
    (2, None, "bob", None, [], None, None, []),
    (3, 40, None, 3.0, ["b", None], [5, 9], ("Oslo",), [(10, "on")]),
    (4, 25, "Anna", -2.0, None, [7], (None,), None),
]


def found(df, spec):
    return sorted(r["_id"] for r in df.where(compile_filter(spec, df.schema)).collect())


@pytest.fixture(scope="module")
def typed(spark):
    return spark.createDataFrame(ROWS, TYPED).cache()


CASES = [
    ({}, [1, 2, 3, 4]),
    ({"age": 25}, [1, 4]),
    ({"age": None}, [2]),
    ({"age": {"$ne": 25}}, [2, 3]),
    ({"age": {"$gt": 25}}, [3]),
    ({"age": {"$gte": 25, "$lt": 40}}, [1, 4]),
    ({"age": {"$gte": None}}, [2]),
    ({"age": {"$gt": None}}, []),
    ({"age": {"$gt": "20"}}, []),
    ({"age": {"$in": [25, "x", 3.5]}}, [1, 4]),
    ({"age": {"$in": [None, 40]}}, [2, 3]),
    ({"age": {"$in": []}}, []),
    ({"age": {"$nin": [25]}}, [2, 3]),
    ({"age": {"$nin": [None]}}, [1, 3, 4]),
    ({"age": {"$exists": True}}, [1, 3, 4]),
    ({"age": {"$exists": False}}, [2]),
    ({"nothing": {"$exists": False}}, [1, 2, 3, 4]),
    ({"nothing": None}, [1, 2, 3, 4]),
    ({"nothing": {"$ne": 5}}, [1, 2, 3, 4]),
    ({"score": {"$type": "double"}}, [1, 3, 4]),
    ({"age": {"$type": "number"}}, [1, 3, 4]),
    ({"age": {"$type": ["string", "bool"]}}, []),
    ({"tags": {"$type": "array"}}, [1, 2, 3]),
    ({"tags": {"$type": "string"}}, [1, 3]),
    ({"name": {"$regex": "^ann"}}, []),
    ({"name": {"$regex": "^ann", "$options": "i"}}, [1, 4]),
    ({"name": re.compile("a$")}, [4]),
    ({"name": {"$not": re.compile("^A")}}, [2, 3]),
    ({"name": {"$not": {"$regex": "b"}}}, [1, 3, 4]),
    ({"tags": "b"}, [1, 3]),
    ({"tags": ["a", "b"]}, [1]),
    ({"tags": []}, [2]),
    ({"tags": None}, [3, 4]),
    ({"tags": {"$ne": "a"}}, [2, 3, 4]),
    ({"tags": {"$in": ["a", "z"]}}, [1]),
    ({"tags": {"$all": ["a", "b"]}}, [1]),
    ({"tags": {"$all": []}}, [1, 2, 3]),
    ({"name": {"$all": ["bob"]}}, [2]),
    ({"nums": {"$gt": 4}}, [3, 4]),
    ({"nums": {"$elemMatch": {"$gt": 4, "$lt": 8}}}, [3, 4]),
    ({"nums": {"$elemMatch": {"$gt": 5, "$lt": 8}}}, [4]),
    ({"age": {"$elemMatch": {"$gt": 4}}}, []),
    ({"users": {"$elemMatch": {"age": 10, "status": "on"}}}, [3]),
    ({"users.status": "off"}, [1]),
    ({"users.age": {"$gt": 20}}, [1]),
    ({"users.0.age": 30}, [1]),
    ({"tags.1": "b"}, [1]),
    ({"tags.9": {"$exists": False}}, [1, 2, 3, 4]),
    ({"addr.city": "Rome"}, [1]),
    ({"addr.city": None}, [2, 4]),
    ({"$and": [{"age": 25}, {"name": "Ann"}]}, [1]),
    ({"$or": [{"age": 40}, {"name": "bob"}]}, [2, 3]),
    ({"$nor": [{"age": 25}, {"name": "bob"}]}, [3]),
    ({"age": {"$not": {"$gt": 30}}}, [1, 2, 4]),
]


@pytest.mark.parametrize("spec,ids", CASES, ids=[str(c[0])[:60] for c in CASES])
def test_typed(typed, spec, ids):
    assert found(typed, spec) == ids


@pytest.mark.parametrize(
    "spec",
    [{"$and": []}, {"$or": 3}, {"$where": "x"}, {"a": {"$size": 2}}, {"a": {"$gt": 1, "b": 2}}, {"a": {"$exists": 1}}, {"a": {"$type": "binary"}}, {"a": {"$type": 2}}, {"a": {"$in": 5}}, {"a": {"$options": "i"}}, {"a": {"$not": 5}}, {"a": {"$regex": "x", "$options": "q"}}],
)
def test_errors_are_raised_while_planning(typed, spec):
    with pytest.raises(EngineError):
        compile_filter(spec, typed.schema)


VARIANTS = [(1, '{"x":5}'), (2, '{"x":5.5}'), (3, '{"x":"nope"}'), (4, '{"x":null}'), (5, "{}"), (6, '{"x":[1,"a",null]}'), (7, '{"x":{"y":1}}'), (8, '{"x":true}'), (9, '{"x":5000000000}'), (10, '{"x":[{"y":3},{"y":4}]}')]
MIXED = [
    ({"v.x": 5}, [1]),
    ({"v.x": None}, [4, 5, 6]),
    ({"v.x": {"$exists": True}}, [1, 2, 3, 4, 6, 7, 8, 9, 10]),
    ({"v.x": {"$exists": False}}, [5]),
    ({"v.x": {"$gt": 5}}, [2, 9]),
    ({"v.x": {"$lte": 5}}, [1, 6]),
    ({"v.x": "a"}, [6]),
    ({"v.x": True}, [8]),
    ({"v.x": {"$type": "int"}}, [1, 6]),
    ({"v.x": {"$type": "long"}}, [9]),
    ({"v.x": {"$type": "double"}}, [2]),
    ({"v.x": {"$type": "number"}}, [1, 2, 6, 9]),
    ({"v.x": {"$type": "null"}}, [4, 6]),
    ({"v.x": {"$type": "object"}}, [7, 10]),
    ({"v.x": {"$in": [5, "nope", True]}}, [1, 3, 8]),
    ({"v.x": {"$ne": 5}}, [2, 3, 4, 5, 6, 7, 8, 9, 10]),
    ({"v.x.y": 1}, [7]),
    ({"v.x": {"$elemMatch": {"y": {"$gt": 3}}}}, [10]),
    ({"v.x": {"$regex": "^no"}}, [3]),
]


@pytest.mark.parametrize("spec,ids", MIXED, ids=[str(c[0]) for c in MIXED])
def test_variant_keeps_null_and_missing_apart(spark, spec, ids):
    df = spark.createDataFrame(VARIANTS, "_id int, j string").select("_id", F.parse_json("j").alias("v"))
    assert found(df, spec) == ids


def test_own_operator(typed):
    register_filter_op("$even", lambda field, value: (field.column % 2 == 0) == value)
    assert found(typed, {"age": {"$even": True}}) == [3]


def test_filters_reach_the_scan(spark, sf):
    df = spark.read.parquet(f"{sf}/orders.parquet")
    plan = df.where(compile_filter({"o_orderstatus": {"$in": ["F"]}, "o_custkey": {"$gt": 5}}, df.schema))._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(" in plan or "PushedFilters: [" in plan and "GreaterThan(o_custkey,5)" in plan
