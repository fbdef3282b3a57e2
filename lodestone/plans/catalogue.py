"""Named queries over the document engine and their DuckDB equivalents."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.files import read_table
from .collection import Collection, Database

#: Key columns of the tables, which give their natural order.
KEYS = {
    "region": ["r_regionkey"],
    "nation": ["n_nationkey"],
    "customer": ["c_custkey"],
    "supplier": ["s_suppkey"],
    "part": ["p_partkey"],
    "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_linenumber"],
    "events": ["event_id"],
    "documents": ["doc_id"],
    "embeddings": ["vec_id"],
    "pages": ["page_id"],
    "benchmark": ["item_id"],
    "labels": ["doc_id"],
    "conversations": ["conv_id", "turn"],
}

_found: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


class Tables(Database):
    """A database whose collections are the Parquet tables of one folder, opened when they are asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__(spark, "tables")
        self.sf_dir = sf_dir

    def collection(self, name: str) -> Collection:
        if name not in self._collections and name in KEYS:
            self.register(name, read_table(self.spark, f"{self.sf_dir}/{name}.parquet", KEYS[name]), KEYS[name])
        return super().collection(name)

    __getitem__ = collection


def pipe(name: str, table: str, stages: list[dict], sql: str | None) -> None:
    _found[name] = (lambda spark, sf_dir: Tables(spark, sf_dir)[table].aggregate(stages)), sql


def find(name: str, table: str, sql: str, filter: dict | None = None, **options: Any) -> None:
    _found[name] = (lambda spark, sf_dir: Tables(spark, sf_dir)[table].find(filter, **options)), sql


def query(name: str, sql: str | None = None):
    def keep(run: Callable[[Database], DataFrame]):
        _found[name] = (lambda spark, sf_dir: run(Tables(spark, sf_dir))), sql
        return run

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _found.items() if sql}


# --- filters -----------------------------------------------------------------

ORDER_KEY = {"o_orderkey": 1}
find("filter_eq", "orders", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'", {"o_orderstatus": "F"}, projection=ORDER_KEY)
find("filter_ne", "orders", "SELECT o_orderkey FROM orders WHERE o_orderstatus IS DISTINCT FROM 'F'", {"o_orderstatus": {"$ne": "F"}}, projection=ORDER_KEY)
find(
    "filter_range",
    "orders",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01' AND o_totalprice > 1000",
    {"o_orderdate": {"$gte": datetime(1995, 1, 1), "$lt": datetime(1996, 1, 1)}, "o_totalprice": {"$gt": 1000}},
    projection={"o_orderkey": 1, "o_totalprice": 1},
)
find("filter_lte", "part", "SELECT p_partkey FROM part WHERE p_size <= 10", {"p_size": {"$lte": 10}}, projection={"p_partkey": 1})
find("filter_bracket", "part", "SELECT p_partkey FROM part WHERE false", {"p_size": {"$gt": "10"}}, projection={"p_partkey": 1})
find("filter_in", "orders", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P')", {"o_orderstatus": {"$in": ["F", "P", 5, None]}}, projection=ORDER_KEY)
find("filter_nin", "orders", "SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('F', 'P')", {"o_orderstatus": {"$nin": ["F", "P"]}}, projection=ORDER_KEY)
find(
    "filter_and",
    "lineitem",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 25 AND l_discount < 0.05 AND l_returnflag = 'R'",
    {"$and": [{"l_quantity": {"$gt": 25}}, {"l_discount": {"$lt": 0.05}}], "l_returnflag": "R"},
    projection={"l_orderkey": 1, "l_linenumber": 1},
)
find(
    "filter_or",
    "lineitem",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45 OR (l_returnflag = 'A' AND l_tax > 0.05)",
    {"$or": [{"l_quantity": {"$gt": 45}}, {"l_returnflag": "A", "l_tax": {"$gt": 0.05}}]},
    projection={"l_orderkey": 1, "l_linenumber": 1},
)
find("filter_nor", "lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_quantity > 10 OR l_returnflag = 'A')", {"$nor": [{"l_quantity": {"$gt": 10}}, {"l_returnflag": "A"}]}, projection={"l_orderkey": 1, "l_linenumber": 1})
find("filter_not", "lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_quantity >= 5)", {"l_quantity": {"$not": {"$gte": 5}}}, projection={"l_orderkey": 1, "l_linenumber": 1})
find("filter_exists", "part", "SELECT p_partkey FROM part WHERE p_brand IS NOT NULL", {"p_brand": {"$exists": True}, "p_nothing": {"$exists": False}}, projection={"p_partkey": 1})
find("filter_type", "part", "SELECT p_partkey FROM part WHERE p_retailprice IS NOT NULL", {"p_retailprice": {"$type": "number"}, "p_name": {"$type": ["string", "bool"]}}, projection={"p_partkey": 1})
find("filter_regex", "part", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(?i)^[a-m].*e')", {"p_name": re.compile("^[a-m].*e", re.I)}, projection={"p_partkey": 1, "p_name": 1})
find("filter_array_any", "embeddings", "SELECT vec_id FROM embeddings WHERE list_max(embedding) > 0.3", {"embedding": {"$gt": 0.3}}, projection={"vec_id": 1})
find(
    "filter_elemmatch",
    "embeddings",
    "SELECT vec_id FROM embeddings WHERE len(list_filter(embedding, lambda x: x > 0.2 AND x < 0.21)) > 0",
    {"embedding": {"$elemMatch": {"$gt": 0.2, "$lt": 0.21}}},
    projection={"vec_id": 1},
)
find("filter_index_path", "embeddings", "SELECT vec_id FROM embeddings WHERE embedding[1] > 0", {"embedding.0": {"$gt": 0}}, projection={"vec_id": 1})
find("filter_empty", "region", "SELECT r_regionkey, r_name FROM region", {})


@query("filter_all", "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING list_has_all(list(o_orderstatus), ['F', 'O', 'P'])")
def _(db: Database) -> DataFrame:
    grouped = db["orders"].aggregate([{"$group": {"_id": "$o_custkey", "states": {"$push": "$o_orderstatus"}}}])
    return db.register("states", grouped).find({"states": {"$all": ["F", "O", "P"]}}).select(F.col("_id").alias("o_custkey"))


@query("filter_variant", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 50")
def _(db: Database) -> DataFrame:
    parsed = db["events"].ordered.withColumn("props", F.parse_json("props"))
    found = db.register("parsed", parsed, ["event_id"]).find({"props.k": {"$gte": 50, "$type": "number", "$exists": True}, "props.none": {"$exists": False}})
    return found.select("event_id", F.variant_get("props", "$.k", "bigint").alias("k"))


# --- projection and reshaping ------------------------------------------------

pipe("project_include", "customer", [{"$project": {"c_custkey": 1, "c_name": True}}], "SELECT c_custkey, c_name FROM customer")
pipe("project_exclude", "customer", [{"$project": {"c_name": 0, "c_acctbal": 0}}], "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
pipe("project_computed", "part", [{"$project": {"p_partkey": 1, "label": {"$concat": ["$p_brand", "/", "$p_type"]}}}], "SELECT p_partkey, p_brand || '/' || p_type AS label FROM part")
pipe("project_path", "part", [{"$project": {"p_partkey": 1, "brand": "$p_brand"}}], "SELECT p_partkey, p_brand AS brand FROM part")
pipe(
    "project_nested",
    "orders",
    [{"$addFields": {"who.key": "$o_custkey", "who.status": "$o_orderstatus"}}, {"$project": {"o_orderkey": 1, "who.key": 1}}, {"$project": {"o_orderkey": 1, "key": "$who.key"}}],
    "SELECT o_orderkey, o_custkey AS key FROM orders",
)
REVENUE = {"$multiply": ["$l_extendedprice", {"$subtract": [1, "$l_discount"]}]}
pipe(
    "add_fields",
    "lineitem",
    [{"$addFields": {"revenue": REVENUE, "big": {"$cond": [{"$gt": ["$l_quantity", 25]}, "yes", "no"]}, "none": {"$ifNull": ["$l_nothing", "gone"]}}}, {"$project": {"l_orderkey": 1, "l_linenumber": 1, "revenue": 1, "big": 1, "none": 1}}],
    "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS revenue, CASE WHEN l_quantity > 25 THEN 'yes' ELSE 'no' END AS big, 'gone' AS none FROM lineitem",
)
pipe(
    "replace_root",
    "orders",
    [{"$addFields": {"d.key": "$o_orderkey", "d.status": "$o_orderstatus"}}, {"$replaceRoot": {"newRoot": "$d"}}],
    "SELECT o_orderkey AS key, o_orderstatus AS status FROM orders",
)

# --- expressions -------------------------------------------------------------

pipe(
    "expr_string",
    "customer",
    [{"$project": {"c_custkey": 1, "up": {"$toUpper": "$c_mktsegment"}, "low": {"$toLower": "$c_name"}, "both": {"$concat": ["$c_name", "-", "$c_nationkey"]}}}],
    "SELECT c_custkey, upper(c_mktsegment) AS up, lower(c_name) AS low, c_name || '-' || CAST(c_nationkey AS VARCHAR) AS both FROM customer",
)
pipe(
    "expr_arith",
    "lineitem",
    [{"$project": {"l_orderkey": 1, "l_linenumber": 1, "s": {"$add": ["$l_quantity", "$l_tax", "$l_none"]}, "d": {"$subtract": ["$l_partkey", "$l_suppkey"]}, "m": {"$multiply": ["$l_quantity", 2]}, "q": {"$divide": ["$l_extendedprice", "$l_quantity"]}}}],
    "SELECT l_orderkey, l_linenumber, l_quantity + l_tax AS s, l_partkey - l_suppkey AS d, l_quantity * 2 AS m, l_extendedprice / l_quantity AS q FROM lineitem",
)
pipe(
    "expr_compare_bool",
    "orders",
    [
        {
            "$project": {
                "o_orderkey": 1,
                "eq": {"$eq": ["$o_orderstatus", "F"]},
                "ne": {"$ne": ["$o_orderstatus", "F"]},
                "gt": {"$gt": ["$o_totalprice", 1000]},
                "null_low": {"$lt": ["$o_none", "$o_totalprice"]},
                "lte": {"$lte": ["$o_custkey", 100]},
                "both": {"$and": [{"$gte": ["$o_custkey", 10]}, {"$not": [{"$eq": ["$o_orderstatus", "O"]}]}]},
                "one": {"$or": [{"$eq": ["$o_orderstatus", "P"]}, "$o_none"]},
            }
        }
    ],
    "SELECT o_orderkey, o_orderstatus = 'F' AS eq, o_orderstatus <> 'F' AS ne, o_totalprice > 1000 AS gt, true AS null_low, o_custkey <= 100 AS lte, "
    "o_custkey >= 10 AND NOT o_orderstatus = 'O' AS both, o_orderstatus = 'P' AS one FROM orders",
)
pipe(
    "expr_array_elem",
    "embeddings",
    [{"$project": {"vec_id": 1, "a": {"$arrayElemAt": ["$embedding", 0]}, "z": {"$arrayElemAt": ["$embedding", -1]}, "none": {"$ifNull": [{"$arrayElemAt": ["$embedding", 99]}, -5.0]}}}],
    "SELECT vec_id, embedding[1] AS a, embedding[-1] AS z, CAST(-5.0 AS DOUBLE) AS none FROM embeddings",
)
pipe("expr_root", "region", [{"$project": {"r_regionkey": 1, "name": "$$ROOT.r_name"}}], "SELECT r_regionkey, r_name AS name FROM region")

# --- aggregation -------------------------------------------------------------

pipe("group_null", "lineitem", [{"$group": {"_id": None, "n": {"$sum": 1}, "qty": {"$sum": "$l_quantity"}}}, {"$project": {"_id": 0}}], "SELECT count(*) AS n, sum(l_quantity) AS qty FROM lineitem")
pipe("group_key", "lineitem", [{"$group": {"_id": "$l_linestatus", "n": {"$sum": 1}}}], "SELECT l_linestatus AS _id, count(*) AS n FROM lineitem GROUP BY 1")
pipe(
    "group_compound",
    "lineitem",
    [{"$group": {"_id": {"flag": "$l_returnflag", "status": "$l_linestatus"}, "n": {"$sum": 1}}}, {"$project": {"_id": 0, "flag": "$_id.flag", "status": "$_id.status", "n": 1}}],
    "SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n FROM lineitem GROUP BY 1, 2",
)
pipe("group_literal", "orders", [{"$group": {"_id": 7, "n": {"$sum": 2}}}], "SELECT 7 AS _id, 2 * count(*) AS n FROM orders")
pipe("group_empty", "orders", [{"$match": {"o_orderkey": -1}}, {"$group": {"_id": None, "n": {"$sum": 1}}}, {"$project": {"_id": 0}}], "SELECT CAST(0 AS BIGINT) AS n WHERE false")
pipe(
    "group_sum_avg_min_max",
    "lineitem",
    [{"$group": {"_id": "$l_returnflag", "sum": {"$sum": "$l_quantity"}, "avg": {"$avg": "$l_quantity"}, "min": {"$min": "$l_extendedprice"}, "max": {"$max": "$l_shipdate"}, "none": {"$sum": "$l_linestatus"}}}],
    "SELECT l_returnflag AS _id, sum(l_quantity) AS sum, avg(l_quantity) AS avg, min(l_extendedprice) AS min, max(l_shipdate) AS max, CAST(0 AS BIGINT) AS none FROM lineitem GROUP BY 1",
)
pipe(
    "group_first_last",
    "orders",
    [{"$sort": {"o_orderdate": 1}}, {"$group": {"_id": "$o_custkey", "first": {"$first": "$o_orderkey"}, "last": {"$last": "$o_orderkey"}}}],
    "SELECT o_custkey AS _id, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last FROM orders GROUP BY 1",
)
pipe(
    "group_last_descending",
    "orders",
    [{"$sort": {"o_orderpriority": -1, "o_totalprice": 1}}, {"$group": {"_id": "$o_custkey", "first": {"$first": "$o_orderkey"}}}],
    "SELECT o_custkey AS _id, first FROM (SELECT o_custkey, o_orderkey AS first, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority DESC, o_totalprice, o_orderkey) AS n FROM orders) WHERE n = 1",
)


@query("group_push", "SELECT o_custkey AS _id, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS keys, len(list(o_orderkey)) AS n FROM orders GROUP BY 1")
def _(db: Database) -> DataFrame:
    got = db["orders"].aggregate([{"$group": {"_id": "$o_custkey", "keys": {"$push": "$o_orderkey"}}}])
    return got.select("_id", F.array_join(F.transform("keys", lambda x: x.cast("string")), ",").alias("keys"), F.size("keys").cast("bigint").alias("n"))


@query("group_addtoset", "SELECT o_custkey AS _id, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS states FROM orders GROUP BY 1")
def _(db: Database) -> DataFrame:
    got = db["orders"].aggregate([{"$group": {"_id": "$o_custkey", "states": {"$addToSet": "$o_orderstatus"}}}])
    return got.select("_id", F.array_join(F.array_sort("states"), ",").alias("states"))


pipe("count_stage", "orders", [{"$match": {"o_orderstatus": "F"}}, {"$count": "n"}], "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
pipe("count_stage_zero", "orders", [{"$match": {"o_orderstatus": "none"}}, {"$count": "n"}], "SELECT 0 AS n")
pipe("count_documents", "orders", [{"$match": {"o_orderstatus": "O"}}, {"$group": {"_id": 1, "n": {"$sum": 1}}}], "SELECT 1 AS _id, count(*) AS n FROM orders WHERE o_orderstatus = 'O'")
query("count_cmd", "SELECT least(50, greatest(0, count(*) - 10)) AS n FROM orders WHERE o_orderstatus = 'P'")(lambda db: db["orders"].count({"o_orderstatus": "P"}, skip=10, limit=50))
query("distinct_cmd", "SELECT DISTINCT o_orderpriority AS value FROM orders")(lambda db: db["orders"].distinct("o_orderpriority"))
query("distinct_array", "SELECT DISTINCT unnest(embedding) AS value FROM embeddings WHERE label < 3")(lambda db: db["embeddings"].distinct("embedding", {"label": {"$lt": 3}}))

# --- order, limits, arrays ---------------------------------------------------

find("sort_multi", "orders", "SELECT o_orderkey FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 500", {}, projection=ORDER_KEY, sort={"o_orderpriority": 1, "o_totalprice": -1}, limit=500)
pipe("top_k", "lineitem", [{"$sort": {"l_extendedprice": -1}}, {"$limit": 100}, {"$project": {"l_orderkey": 1, "l_linenumber": 1, "l_extendedprice": 1}}], "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100")
pipe("skip_limit", "orders", [{"$sort": {"o_totalprice": 1}}, {"$skip": 20}, {"$limit": 30}, {"$project": {"o_orderkey": 1}}], "SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 30 OFFSET 20")
pipe("limit_natural", "orders", [{"$limit": 25}, {"$project": {"o_orderkey": 1}}], "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25")
pipe("unwind", "embeddings", [{"$unwind": "$embedding"}, {"$group": {"_id": "$vec_id", "n": {"$sum": 1}, "low": {"$min": "$embedding"}}}], "SELECT vec_id AS _id, count(*) AS n, min(e) AS low FROM (SELECT vec_id, unnest(embedding) AS e FROM embeddings) GROUP BY 1")

@query("filter_elemmatch_document", "SELECT DISTINCT l_orderkey AS _id FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
def _(db: Database) -> DataFrame:
    grouped = db["lineitem"].aggregate([{"$group": {"_id": "$l_orderkey", "items": {"$push": "$$ROOT"}}}])
    return db.register("grouped", grouped).find({"items": {"$elemMatch": {"l_quantity": {"$gt": 45}, "l_returnflag": "R"}}}, projection={"_id": 1})


# --- joins -------------------------------------------------------------------

TO_ORDERS = {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "o"}
pipe(
    "unwind_preserve",
    "customer",
    [{"$lookup": TO_ORDERS}, {"$unwind": {"path": "$o", "preserveNullAndEmptyArrays": True}}, {"$project": {"c_custkey": 1, "o_orderkey": "$o.o_orderkey"}}],
    "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey",
)


@query("unwind_preserve_array", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def _(db: Database) -> DataFrame:
    nested = db.register("nested", db["customer"].aggregate([{"$lookup": TO_ORDERS}]))
    return nested.aggregate([{"$unwind": {"path": "$o", "preserveNullAndEmptyArrays": True}}, {"$project": {"c_custkey": 1, "o_orderkey": "$o.o_orderkey"}}])


@query("lookup_nest", "SELECT c_custkey, count(o_orderkey) AS n, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey), '') AS keys FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def _(db: Database) -> DataFrame:
    got = db["customer"].aggregate([{"$lookup": TO_ORDERS}])
    return got.select("c_custkey", F.size("o").cast("bigint").alias("n"), F.array_join(F.transform("o", lambda x: x["o_orderkey"].cast("string")), ",").alias("keys"))


@query(
    "lookup_array_local_all",
    "SELECT k AS _id, count(DISTINCT p_partkey) AS n, sum(p_size) AS size FROM (SELECT DISTINCT l_orderkey AS k, l_partkey FROM lineitem) JOIN part ON l_partkey = p_partkey GROUP BY 1",
)
def _(db: Database) -> DataFrame:
    stages = [
        {"$group": {"_id": "$l_orderkey", "parts": {"$push": "$l_partkey"}}},
        {"$lookup": {"from": "part", "localField": "parts", "foreignField": "p_partkey", "as": "p"}},
    ]
    got = db["lineitem"].aggregate(stages)
    return got.select("_id", F.size("p").cast("bigint").alias("n"), F.aggregate("p", F.lit(0).cast("bigint"), lambda a, x: a + x["p_size"]).alias("size"))


@query(
    "lookup_pipeline",
    "SELECT o_orderkey, count(l_orderkey) AS n, coalesce(sum(l_quantity), 0) AS qty FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'R') ON o_orderkey = l_orderkey GROUP BY 1",
)
def _(db: Database) -> DataFrame:
    stages = [{"$lookup": {"from": "lineitem", "localField": "o_orderkey", "foreignField": "l_orderkey", "as": "l", "pipeline": [{"$match": {"l_returnflag": "R"}}, {"$project": {"l_quantity": 1}}]}}]
    got = db["orders"].aggregate(stages)
    return got.select("o_orderkey", F.size("l").cast("bigint").alias("n"), F.aggregate("l", F.lit(0.0), lambda a, x: a + x["l_quantity"]).alias("qty"))


@query("lookup_uncorrelated", "SELECT n_nationkey, (SELECT string_agg(r_name, ',' ORDER BY r_regionkey) FROM region WHERE r_regionkey < 3) AS names FROM nation")
def _(db: Database) -> DataFrame:
    got = db["nation"].aggregate([{"$lookup": {"from": "region", "as": "r", "pipeline": [{"$match": {"r_regionkey": {"$lt": 3}}}]}}])
    return got.select("n_nationkey", F.array_join(F.transform("r", lambda x: x["r_name"]), ",").alias("names"))


@query("lookup_let", "SELECT n_nationkey, string_agg(r_name || ':' || n_name, ',') AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def _(db: Database) -> DataFrame:
    inner = [{"$addFields": {"both": {"$concat": ["$r_name", ":", "$$name"]}}}]
    got = db["nation"].aggregate([{"$lookup": {"from": "region", "localField": "n_regionkey", "foreignField": "r_regionkey", "let": {"name": "$n_name"}, "as": "r", "pipeline": inner}}])
    return got.select("n_nationkey", F.array_join(F.transform("r", lambda x: x["both"]), ",").alias("names"))


pipe(
    "lookup_topn_per_key",
    "customer",
    [
        {"$lookup": TO_ORDERS | {"pipeline": [{"$sort": {"o_totalprice": -1}}, {"$limit": 2}]}},
        {"$unwind": "$o"},
        {"$project": {"c_custkey": 1, "o_orderkey": "$o.o_orderkey"}},
    ],
    "SELECT c_custkey, o_orderkey FROM customer JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) ON c_custkey = o_custkey WHERE n <= 2",
)
pipe(
    "lookup_count_per_key",
    "customer",
    [{"$lookup": TO_ORDERS | {"pipeline": [{"$match": {"o_orderstatus": "P"}}, {"$count": "n"}]}}, {"$unwind": "$o"}, {"$project": {"c_custkey": 1, "n": "$o.n"}}],
    "SELECT c_custkey, CAST(count(o_orderkey) AS INTEGER) AS n FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON c_custkey = o_custkey GROUP BY 1",
)
pipe(
    "lookup_group_per_key",
    "customer",
    [{"$lookup": TO_ORDERS | {"pipeline": [{"$group": {"_id": "$o_orderstatus", "n": {"$sum": 1}}}]}}, {"$unwind": "$o"}, {"$project": {"c_custkey": 1, "status": "$o._id", "n": "$o.n"}}],
    "SELECT c_custkey, o_orderstatus AS status, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2",
)
pipe("lookup_inner", "customer", [{"$lookup": TO_ORDERS}, {"$unwind": "$o"}, {"$project": {"c_custkey": 1, "o_orderkey": "$o.o_orderkey"}}], "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey")
pipe("lookup_semi", "customer", [{"$lookup": TO_ORDERS}, {"$match": {"o.0": {"$exists": True}}}, {"$project": {"c_custkey": 1}}], "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
pipe("lookup_anti", "customer", [{"$lookup": TO_ORDERS}, {"$match": {"o": []}}, {"$project": {"c_custkey": 1}}], "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
pipe(
    "lookup_chain",
    "region",
    [
        {"$lookup": {"from": "nation", "localField": "r_regionkey", "foreignField": "n_regionkey", "as": "n"}},
        {"$unwind": "$n"},
        {"$addFields": {"key": "$n.n_nationkey"}},
        {"$lookup": {"from": "customer", "localField": "key", "foreignField": "c_nationkey", "as": "c"}},
        {"$unwind": "$c"},
        {"$group": {"_id": "$r_name", "n": {"$sum": 1}, "low": {"$min": "$c.c_acctbal"}}},
    ],
    "SELECT r_name AS _id, count(*) AS n, min(c_acctbal) AS low FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1",
)

# --- windows -----------------------------------------------------------------


def window(name: str, output: dict, sql: str, sort: dict | None = None, by: Any = "$o_custkey") -> None:
    spec = {"output": {"w": output}} | ({"partitionBy": by} if by else {}) | ({"sortBy": sort} if sort else {})
    pipe(name, "orders", [{"$setWindowFields": spec}, {"$project": {"o_orderkey": 1, "w": 1}}], f"SELECT o_orderkey, {sql} AS w FROM orders")


BY_DATE = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
ROWS = f"{BY_DATE} ROWS BETWEEN"
SORT = {"o_orderdate": 1}
window("win_docnum", {"$documentNumber": {}}, f"CAST(row_number() OVER ({BY_DATE}) AS INTEGER)", SORT)
window("win_rank", {"$rank": {}}, "CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS INTEGER)", {"o_orderpriority": 1})
window("win_rank_unsorted", {"$rank": {}}, "1")
window("win_sum_partition", {"$sum": "$o_orderkey"}, "CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey) AS BIGINT)")
window("win_count_partition", {"$sum": 1}, "count(*) OVER (PARTITION BY o_custkey)")
window("win_running", {"$sum": 1}, f"count(*) OVER ({ROWS} UNBOUNDED PRECEDING AND CURRENT ROW)", SORT)
window("win_avg", {"$avg": "$o_custkey", "window": {"documents": [-1, 1]}}, f"avg(o_custkey) OVER ({ROWS} 1 PRECEDING AND 1 FOLLOWING)", SORT)
window("win_min", {"$min": "$o_totalprice", "window": {"documents": ["unbounded", "current"]}}, f"min(o_totalprice) OVER ({ROWS} UNBOUNDED PRECEDING AND CURRENT ROW)", SORT)
window("win_max", {"$max": "$o_totalprice", "window": {"documents": [-2, "current"]}}, f"max(o_totalprice) OVER ({ROWS} 2 PRECEDING AND CURRENT ROW)", SORT)
window("win_first", {"$first": "$o_orderkey"}, f"first_value(o_orderkey) OVER ({ROWS} UNBOUNDED PRECEDING AND CURRENT ROW)", SORT)
window("win_last", {"$last": "$o_orderkey", "window": {"documents": ["current", "unbounded"]}}, f"last_value(o_orderkey) OVER ({ROWS} CURRENT ROW AND UNBOUNDED FOLLOWING)", SORT)
window("win_frame", {"$sum": "$o_custkey", "window": {"documents": [-3, -1]}}, f"CASE WHEN row_number() OVER ({BY_DATE}) = 1 THEN o_custkey ELSE CAST(sum(o_custkey) OVER ({ROWS} 3 PRECEDING AND 1 PRECEDING) AS BIGINT) END", SORT)
window(
    "win_clamp",
    {"$max": "$o_totalprice", "window": {"documents": [2, 3]}},
    f"CASE WHEN row_number() OVER ({BY_DATE}) + 2 > count(*) OVER (PARTITION BY o_custkey) THEN last_value(o_totalprice) OVER ({ROWS} UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) ELSE max(o_totalprice) OVER ({ROWS} 2 FOLLOWING AND 3 FOLLOWING) END",
    SORT,
)

WHOLE = "ORDER BY o_orderdate, o_orderkey"
window("win_whole_docnum", {"$documentNumber": {}}, f"CAST(row_number() OVER ({WHOLE}) AS INTEGER)", SORT, None)
window("win_whole_rank", {"$rank": {}}, "CAST(rank() OVER (ORDER BY o_orderpriority) AS INTEGER)", {"o_orderpriority": 1}, None)
window("win_whole_running", {"$sum": "$o_custkey"}, f"CAST(sum(o_custkey) OVER ({WHOLE} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT)", SORT, None)
window("win_whole_frame", {"$max": "$o_totalprice", "window": {"documents": [-3, 3]}}, f"max(o_totalprice) OVER ({WHOLE} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)", SORT, None)

# --- text search -------------------------------------------------------------

_COUNT = "list_sum(list_transform(list_filter(regexp_split_to_array(lower({c}), '[ \\t\\n\\r]+'), lambda t: t IN ({t})), lambda t: 1))"


def texts(name: str, keys: dict, stages: list[dict], sql: str, table: str = "documents") -> None:
    def run(db: Database) -> DataFrame:
        c = db[table]
        c.create_index(keys)
        return c.aggregate(stages)

    query(name, sql)(run)


texts("text_search", {"text": "text"}, [{"$match": {"$text": {"$search": "the idiot"}}}, {"$project": {"doc_id": 1}}], f"SELECT doc_id FROM documents WHERE {_COUNT.format(c='text', t="'the', 'idiot'")} > 0")
texts(
    "text_score",
    {"text": "text"},
    [{"$match": {"$text": {"$search": "LICENSE the the"}}}, {"$project": {"doc_id": 1, "score": {"$meta": "textScore"}}}],
    f"SELECT doc_id, CAST(2 * coalesce({_COUNT.format(c='text', t="'the'")}, 0) + coalesce({_COUNT.format(c='text', t="'license'")}, 0) AS INTEGER) AS score FROM documents WHERE {_COUNT.format(c='text', t="'the', 'license'")} > 0",
)
texts(
    "text_wildcard",
    {"$**": "text"},
    [{"$match": {"$text": {"$search": "economy"}}}, {"$project": {"p_partkey": 1}}],
    "SELECT p_partkey FROM part WHERE list_contains(string_split(lower(concat_ws(' ', p_name, p_brand, p_type)), ' '), 'economy')",
    "part",
)
texts(
    "text_and_filter",
    {"text": "text"},
    [{"$match": {"$text": {"$search": "the"}, "lang": "en"}}, {"$sort": {"score": {"$meta": "textScore"}}}, {"$limit": 20}, {"$project": {"doc_id": 1}}],
    f"SELECT doc_id FROM documents WHERE lang = 'en' AND {_COUNT.format(c='text', t="'the'")} > 0 ORDER BY {_COUNT.format(c='text', t="'the'")} DESC, doc_id LIMIT 20",
)

# --- writes ------------------------------------------------------------------


def update(name: str, change: dict, sql: str, filter: dict | None = None, many: bool = True, table: str = "customer") -> None:
    def run(db: Database) -> DataFrame:
        c = db[table]
        c.update(filter or {}, change, many=many)
        return c.df

    query(name, sql)(run)


_REST = "c_custkey, c_name, c_nationkey, c_mktsegment"
_RICH = {"c_acctbal": {"$gt": 5000}}
update("upd_set", {"$set": {"c_mktsegment": "RICH", "vip": True}}, "SELECT c_custkey, c_name, c_nationkey, c_acctbal, CASE WHEN c_acctbal > 5000 THEN 'RICH' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_acctbal > 5000 THEN true END AS vip FROM customer", _RICH)
update("upd_unset", {"$unset": {"c_name": ""}}, "SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN NULL ELSE c_name END AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer", _RICH)
update("upd_inc", {"$inc": {"c_nationkey": 100}}, "SELECT c_custkey, c_name, CASE WHEN c_acctbal > 5000 THEN c_nationkey + 100 ELSE c_nationkey END AS c_nationkey, c_acctbal, c_mktsegment FROM customer", _RICH)
update("upd_mul", {"$mul": {"c_acctbal": 2}}, f"SELECT {_REST}, CASE WHEN c_acctbal > 5000 THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal FROM customer", _RICH)
update("upd_minmax", {"$min": {"c_nationkey": 10}, "$max": {"c_acctbal": 0.0}}, "SELECT c_custkey, c_name, least(c_nationkey, 10) AS c_nationkey, greatest(c_acctbal, 0.0) AS c_acctbal, c_mktsegment FROM customer")
update("upd_rename", {"$rename": {"c_name": "title"}}, "SELECT c_custkey, CAST(NULL AS VARCHAR) AS c_name, c_nationkey, c_acctbal, c_mktsegment, c_name AS title FROM customer")
update("upd_one", {"$set": {"c_nationkey": -1}}, "SELECT c_custkey, c_name, CASE WHEN c_custkey = (SELECT min(c_custkey) FROM customer WHERE c_acctbal > 5000) THEN -1 ELSE c_nationkey END AS c_nationkey, c_acctbal, c_mktsegment FROM customer", _RICH, many=False)


def arrays(name: str, change: dict, sql: str) -> None:
    def run(db: Database) -> DataFrame:
        grouped = db["orders"].aggregate([{"$group": {"_id": "$o_custkey", "k": {"$push": "$o_orderkey"}}}])
        c = db.register("grouped", grouped)
        c.update({}, change, many=True)
        return c.df.select("_id", F.array_join(F.transform("k", lambda x: x.cast("string")), ",").alias("k"))

    query(name, f"SELECT _id, array_to_string({sql}, ',') AS k FROM (SELECT o_custkey AS _id, list(o_orderkey ORDER BY o_orderkey) AS k FROM orders GROUP BY 1)")(run)


arrays("upd_push", {"$push": {"k": -5}}, "list_append(k, -5)")
arrays("upd_push_modifiers", {"$push": {"k": {"$each": [7, 3], "$position": 0, "$sort": -1, "$slice": 4}}}, "list_reverse_sort(list_concat([7, 3], k))[1:4]")
arrays("upd_pull", {"$pull": {"k": 3}}, "list_filter(k, lambda x: x <> 3)")
arrays("upd_pullall", {"$pullAll": {"k": [3, 7, 11]}}, "list_filter(k, lambda x: x NOT IN (3, 7, 11))")
arrays("upd_pop", {"$pop": {"k": 1}}, "k[1:len(k) - 1]")
arrays("upd_addtoset", {"$addToSet": {"k": {"$each": [3, -1, -1]}}}, "CASE WHEN list_contains(k, 3) THEN list_append(k, -1) ELSE list_concat(k, [3, -1]) END")


@query("upsert", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 77, 'NEW'")
def _(db: Database) -> DataFrame:
    c = db["region"]
    c.update({"r_regionkey": 99}, {"$set": {"r_regionkey": 77, "r_name": "NEW"}}, upsert=True)
    return c.find({}, projection={"_id": 0, "r_regionkey": 1, "r_name": 1})


@query("delete", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F')")
def _(db: Database) -> DataFrame:
    c = db["orders"]
    c.delete({"o_orderstatus": "F"}, many=True)
    return c.find({}, projection=ORDER_KEY)


@query("replace", "SELECT r_regionkey, r_name FROM region WHERE r_regionkey <> 2 UNION ALL SELECT CAST(NULL AS INTEGER), 'OTHER'")
def _(db: Database) -> DataFrame:
    c = db["region"]
    c.update({"r_regionkey": 2}, {"r_name": "OTHER"})
    return c.df


@query("find_and_modify", "SELECT c_custkey, CASE WHEN c_custkey = (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 1) THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def _(db: Database) -> DataFrame:
    c = db["customer"]
    c.find_and_modify({}, {"$set": {"c_acctbal": 0.0}}, sort={"c_acctbal": -1})
    return c.find({}, projection={"c_custkey": 1, "c_acctbal": 1})


@query("insert", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 50, 'A' UNION ALL SELECT 51, 'B'")
def _(db: Database) -> DataFrame:
    c = db["region"]
    c.insert([{"r_regionkey": 50, "r_name": "A"}, {"r_regionkey": 51, "r_name": "B"}])
    return c.find({}, projection={"_id": 0, "r_regionkey": 1, "r_name": 1})


@query("unique_violations", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def _(db: Database) -> DataFrame:
    from .collection import Index

    return db["orders"].violations(Index("one", {"o_custkey": 1}, unique=True))


query(
    "stats",
    "SELECT count(*) AS count, CAST(sum(n) AS BIGINT) AS size, avg(n) AS avg_size FROM (SELECT strlen(CAST(to_json({'n_nationkey': n_nationkey, 'n_name': n_name, 'n_regionkey': n_regionkey}) AS VARCHAR)) AS n FROM nation)",
)(lambda db: db["nation"].stats())


@query("upd_current_date", "SELECT c_custkey, coalesce(c_acctbal > 5000, false) AS seen FROM customer")
def _(db: Database) -> DataFrame:
    c = db["customer"]
    c.update(_RICH, {"$currentDate": {"seen": True}}, many=True)
    return c.df.select("c_custkey", (F.col("seen").isNotNull() & (F.current_timestamp() >= F.col("seen"))).alias("seen"))


@query("upsert_set_on_insert", "SELECT r_regionkey, CASE WHEN r_regionkey = 1 THEN 'OLD' ELSE r_name END AS r_name FROM region UNION ALL SELECT 78, 'NEW'")
def _(db: Database) -> DataFrame:
    c = db["region"]
    c.update({"r_regionkey": 1}, {"$set": {"r_name": "OLD"}, "$setOnInsert": {"r_regionkey": 79}}, upsert=True)
    c.update({"r_regionkey": 99}, {"$set": {"r_regionkey": 78}, "$setOnInsert": {"r_name": "NEW"}}, upsert=True)
    return c.find({}, projection={"_id": 0, "r_regionkey": 1, "r_name": 1})


def _with_id(db: Database, name: str, key: str) -> Collection:
    return db.register(name + "_id", db[name].df.withColumnRenamed(key, "_id"), ["_id"])


@query("insert_duplicate_id", "SELECT r_regionkey AS _id, r_name FROM region UNION ALL SELECT 60, 'B'")
def _(db: Database) -> DataFrame:
    c = _with_id(db, "region", "r_regionkey")
    c.insert([{"_id": 1, "r_name": "A"}, {"_id": 60, "r_name": "B"}, {"_id": 60, "r_name": "C"}], ordered=False)
    return c.find({}, projection={"_id": 1, "r_name": 1})


@query("replace_many_orders", "SELECT o_orderkey AS _id, CASE WHEN o_orderkey = 7 THEN NULL ELSE o_custkey END AS o_custkey, CASE WHEN o_orderkey = 7 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def _(db: Database) -> DataFrame:
    c = _with_id(db, "orders", "o_orderkey")
    c.update({"_id": 7}, {"o_orderstatus": "Z"})
    return c.find({}, projection={"_id": 1, "o_custkey": 1, "o_orderstatus": 1})


@query("delete_one", "SELECT o_orderkey FROM orders WHERE o_orderkey > (SELECT min(o_orderkey) FROM orders WHERE o_orderstatus = 'F') OR NOT (o_orderstatus = 'F')")
def _(db: Database) -> DataFrame:
    c = db["orders"]
    c.delete({"o_orderstatus": "F"})
    return c.find({}, projection=ORDER_KEY)


@query("index_catalogue", "SELECT * FROM (VALUES ('_id_', true, false), ('o_custkey_1', false, true), ('one', true, false)) AS v(name, \"unique\", sparse)")
def _(db: Database) -> DataFrame:
    c = db["orders"]
    c.create_index({"o_custkey": 1}, sparse=True)
    c.create_index({"o_orderkey": 1}, name="one", unique=True)
    return c.index_table().select("name", "unique", "sparse")


@query("changed_collections", "SELECT 'region' AS name")
def _(db: Database) -> DataFrame:
    db["nation"].count().collect()
    db["region"].delete({"r_regionkey": 0})
    db["customer"].delete({"c_custkey": 1})
    db["customer"].restore()
    return db.spark.createDataFrame([(n,) for n in db.changed()], "name string")

# --- sources and change streams ----------------------------------------------

query("inline_documents", "SELECT 1 AS a, 'x' AS b UNION ALL SELECT 2, NULL")(lambda db: db.aggregate([{"$documents": [{"a": 1, "b": "x"}, {"a": 2}]}]))
query("missing_collection", "SELECT CAST(NULL AS VARCHAR) AS _id WHERE false")(lambda db: db["nowhere"].find({}))


def _events_as_log(db: Database) -> DataFrame:
    """The events table in the shape of a change log; its key is the sequence."""
    kind = F.when(F.col("event_id") % 3 == 0, "insert").when(F.col("event_id") % 3 == 1, "update").otherwise("delete")
    document = F.to_json(F.struct("user_id", "event_type", "value"))
    return db["events"].df.select(
        F.col("event_id").alias("seq"),
        kind.alias("operationType"),
        F.col("ts").cast("timestamp").alias("clusterTime"),
        F.col("ts").cast("timestamp").alias("wallTime"),
        F.struct(F.lit("app").alias("db"), F.col("event_type").alias("coll")).alias("ns"),
        F.lit(None).cast("struct<db:string,coll:string>").alias("to"),
        F.to_json(F.struct(F.col("event_id").alias("_id"))).alias("documentKey"),
        document.alias("fullDocument"),
        document.alias("fullDocumentBeforeChange"),
        F.lit(None).cast("struct<updatedFields:map<string,string>,removedFields:array<string>>").alias("updateDescription"),
    )


_KIND = "CASE event_id % 3 WHEN 0 THEN 'insert' WHEN 1 THEN 'update' ELSE 'delete' END"


@query("change_events", f"SELECT lpad(lower(to_hex(event_id)), 16, '0') AS token, {_KIND} AS kind, CASE WHEN event_id % 3 = 0 THEN user_id END AS user_id FROM events")
def _(db: Database) -> DataFrame:
    from ..streaming.changes import shaped

    return shaped(_events_as_log(db)).select(F.col("_id").alias("token"), F.col("operationType").alias("kind"), F.variant_get("fullDocument", "$.user_id", "bigint").alias("user_id"))


@query("change_filter", "SELECT event_id AS key FROM events WHERE event_type = 'click' AND event_id % 3 = 0 AND value > 10")
def _(db: Database) -> DataFrame:
    from ..streaming.changes import in_scope, per_event, shaped

    rows = shaped(_events_as_log(db).where(in_scope("app", "click")))
    return per_event(rows, [{"$match": {"operationType": "insert", "fullDocument.value": {"$gt": 10}}}, {"$project": {"key": "$documentKey._id"}}]).select(F.col("key").cast("bigint").alias("key"))


def _folder(spark: SparkSession) -> str:
    """A new folder that executors share; on a local master without a checkpoint folder, one of this process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not where:
        where = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
    return f"{where}/log-{uuid.uuid4().hex}"


def _log(db: Database):
    """A change log that the database's writes publish to."""
    from ..streaming.changes import ChangeLog

    db.log = ChangeLog(db.spark, _folder(db.spark), retention=1 << 40)
    return db.log


@query("change_resume", "SELECT lpad(lower(to_hex(event_id)), 16, '0') AS token FROM events WHERE event_id > 5000")
def _(db: Database) -> DataFrame:
    log = _log(db)
    log.append(_events_as_log(db))
    return log.watch(after="0000000000001388", streaming=False).select(F.col("_id").alias("token"))


@query("change_publish", "SELECT r_regionkey AS key, 'update' AS kind, '\"X\"' AS name FROM region WHERE r_regionkey > 1 UNION ALL SELECT r_regionkey, 'delete', NULL FROM region WHERE r_regionkey = 0 UNION ALL SELECT 70, 'insert', NULL")
def _(db: Database) -> DataFrame:
    _log(db)
    c = db["region"]
    c.update({"r_regionkey": {"$gt": 1}}, {"$set": {"r_name": "X"}}, many=True)
    c.delete({"r_regionkey": 0})
    c.insert([{"r_regionkey": 70, "r_name": "NEW"}])
    rows = db.watch({"resumeAfter": {"_data": "0" * 16}, "fullDocumentBeforeChange": "whenAvailable", "fullDocument": "updateLookup"}, "region", streaming=False)
    key = F.coalesce(F.try_variant_get("documentKey", "$.r_regionkey", "int"), F.try_variant_get("fullDocument", "$.r_regionkey", "int"), F.try_variant_get("fullDocumentBeforeChange", "$.r_regionkey", "int"))
    return rows.select(key.alias("key"), F.col("operationType").alias("kind"), F.try_element_at(F.col("updateDescription.updatedFields"), F.lit("r_name")).alias("name"))


@query("change_invalidate", "SELECT * FROM (VALUES ('update', 1), ('drop', 2), ('invalidate', 2)) AS v(kind, token)")
def _(db: Database) -> DataFrame:
    _log(db)
    db["region"].update({"r_regionkey": 3}, {"$set": {"r_name": "X"}})
    db.drop("region")
    db.create("region")
    return db.watch({"startAfter": "0" * 16}, "region", streaming=False).select(F.col("operationType").alias("kind"), F.conv("_id", 16, 10).cast("int").alias("token"))


# --- flagship ----------------------------------------------------------------

pipe(
    "flagship",
    "customer",
    [
        {"$match": {"c_mktsegment": "BUILDING"}},
        {"$lookup": TO_ORDERS},
        {"$unwind": "$o"},
        {"$addFields": {"key": "$o.o_orderkey", "date": "$o.o_orderdate"}},
        {"$lookup": {"from": "lineitem", "localField": "key", "foreignField": "l_orderkey", "as": "l"}},
        {"$unwind": "$l"},
        {"$addFields": {"revenue": {"$multiply": ["$l.l_extendedprice", {"$subtract": [1, "$l.l_discount"]}]}}},
        {"$group": {"_id": "$key", "revenue": {"$sum": "$revenue"}, "date": {"$first": "$date"}}},
        {"$sort": {"revenue": -1}},
        {"$limit": 10},
        {"$project": {"_id": 1, "date": 1, "revenue": 1}},
    ],
    "SELECT o_orderkey AS _id, o_orderdate AS date, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey "
    "WHERE c_mktsegment = 'BUILDING' GROUP BY 1, 2 ORDER BY sum(l_extendedprice * (1 - l_discount)) DESC LIMIT 10",
)

__all__ = ["Tables", "oracle_sql", "queries"]
