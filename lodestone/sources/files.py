"""Readers of JSON lines, JSON arrays, dumps and Parquet, and a loader of directory layouts.

Every reader returns a DataFrame with the hidden column of natural order.
Typed readers have native columns; variant readers one VARIANT column, ``v``,
which keeps null apart from missing and takes values of any type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.values import ORDER
from ..plans.collection import Catalog, Database
from .bson import read_bson


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines, ordered by file and by row number within the scan."""
    rows = spark.read.text(path)
    order = F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row"))
    filled = F.col("value").rlike(r"\S")
    # A predicate above may be evaluated together with this one, so blank lines are also made null.
    return rows.select(F.when(filled, F.col("value")).alias("value"), order.alias(ORDER)).where("value IS NOT NULL")


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One document per line; without a schema it is inferred from all lines."""
    if schema is None:
        schema = spark.read.json(path).schema
    lines = _lines(spark, path)
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("d"), ORDER).select("d.*", ORDER)


def read_json_variant(spark: SparkSession, path: str) -> DataFrame:
    """One document per line as a VARIANT."""
    return _lines(spark, path).select(F.parse_json("value").alias("v"), ORDER)


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    """Files that hold one array each; elements that are no documents become ``{"value": element}``."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.parse_json("value").alias("a"))
    each = whole.select("file", F.posexplode(F.variant_get("a", "$", "array<variant>")).alias("row", "x"))
    wrapped = F.parse_json(F.concat(F.lit('{"value":'), F.coalesce(F.to_json("x"), F.lit("null")), F.lit("}")))
    return each.select(F.when(F.schema_of_variant("x").startswith("OBJECT"), F.col("x")).otherwise(wrapped).alias("v"), F.struct("file", "row").alias(ORDER))


def is_array_file(spark: SparkSession, path: str) -> bool:
    """Whether the first text that is not blank begins with ``[``."""
    first = spark.read.text(path).where(F.trim("value") != "").limit(1).first()
    return bool(first) and first[0].lstrip().startswith("[")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Lines or an array, by what the file begins with, as VARIANT documents."""
    return read_json_array(spark, path) if is_array_file(spark, path) else read_json_variant(spark, path)


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    return read_bson(spark, path).select("v", F.struct("file", "n").alias(ORDER))


def read_table(spark: SparkSession, path: str, order: list[str]) -> DataFrame:
    """A Parquet table whose key columns give the natural order."""
    return spark.read.parquet(path).withColumn(ORDER, F.struct(*order))


def typed(df: DataFrame, schema: T.StructType | str) -> DataFrame:
    """VARIANT documents as native columns; values of other types become null."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return df.select(*[F.try_variant_get("v", f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in kind.fields], ORDER)


def _list(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """Names in a folder of any file system that Spark reads, and whether they are folders."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(where):
        return []
    return sorted((s.getPath().getName(), s.isDirectory()) for s in system.listStatus(where))


def load_directory(spark: SparkSession, root: str, dump: bool = False) -> Catalog:
    """A catalog from ``root/database/collection.json``; with ``dump`` from ``.bson`` files, and ``.json`` where there is none.

    ``*.metadata.json`` files are left out.
    """
    catalog = Catalog(spark)
    for name, folder in _list(spark, root):
        if folder:
            load_database(catalog.database(name), f"{root}/{name}", dump)
    return catalog


def load_database(database: Database, path: str, dump: bool = False) -> Database:
    files = [n for n, folder in _list(database.spark, path) if not folder]
    stems: dict[str, str] = {}
    for n in files:
        if n.endswith(".json") and not n.endswith(".metadata.json"):
            stems.setdefault(n.removesuffix(".json"), n)
    if dump:
        stems |= {n.removesuffix(".bson"): n for n in files if n.endswith(".bson")}
    for stem, n in stems.items():
        read = read_dump if n.endswith(".bson") else read_json
        database.register(stem, read(database.spark, f"{path}/{n}"))
    return database


def grid_files(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Files put together from their chunks: the columns of ``files`` and ``data``.

    Chunks of a file are joined in the order of ``n``; a file without chunks is empty.
    """
    parts = chunks.groupBy(F.col("files_id").alias("__file")).agg(F.array_sort(F.collect_list(F.struct("n", "data"))).alias("__parts"))
    whole = F.unhex(F.array_join(F.transform("__parts", lambda p: F.hex(p["data"])), ""))
    return files.join(parts, files["_id"] == F.col("__file"), "left").withColumn("data", F.coalesce(whole, F.lit(b""))).drop("__file", "__parts")
