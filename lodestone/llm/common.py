"""What all operators share: reading tables, a folder that every executor sees, batches of text as numpy arrays.

Text reaches Python as Arrow buffers and is handled as one ``uint8`` array
for many documents, so the cost of Python is paid per piece of about
``PIECE_BYTES``, not per row.  One document longer than that is a piece of
its own: memory is bounded by the longest document, never by a group of rows.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

PIECE_BYTES = 1_000_000
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_limits(spark: SparkSession) -> None:
    """Keep one Arrow batch small: long documents make row counts a poor measure of memory."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS)), ("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; on a local master without it, a folder of this process that goes with it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", where)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where


#: Spark deletes the shuffle files of a query when it ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries inside go as soon as each ends."""
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before) if before is not None else spark.conf.unset(_CLEAN)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts lineage and survives lost executors."""
    return Tables(df.sparkSession).stored(df, name)


class Tables:
    """Intermediate tables of one run, in a folder of their own that executors share.

    Shuffle files go with the query that wrote a table, as nothing else reads
    them; a table goes when ``drop`` names it.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_dir(spark)}/lodestone-{uuid.uuid4().hex}"

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        with cleaned(self.spark):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the ``len + 1`` offsets into them.  Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null(b"" if "binary" in str(column.type) else "")
    wide = "large" in str(column.type)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, at - at[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with at most ``most`` bytes of text (one longer row stands alone): (rows, bytes, offsets)."""
    for batch in batches:
        buf, at = text_bytes(batch.column(batch.schema.get_field_index(column)))
        lo, n = 0, batch.num_rows
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
            yield batch.slice(lo, hi - lo), buf[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
            lo = hi


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    arrow_limits(df.sparkSession)
    return df.mapInArrow(run, schema)


# --- bytes, words and hashes -------------------------------------------------

_B = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def _byte_values() -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Cache(dict):
    """A dictionary that travels empty: what a process keeps for itself is never shipped with a function."""

    def __reduce__(self):
        return Cache, ()


_state = Cache()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse; kept for pieces of the usual size."""
    kept = _state.get("pow")
    if kept is not None and len(kept) >= n:
        return _state["pow"], _state["inv"]
    size = max(n, PIECE_BYTES // 8)
    up, down = np.full(size, _B & _MASK, np.uint64), np.full(size, pow(_B, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    if size <= 2 * PIECE_BYTES:
        _state["pow"], _state["inv"] = up, down
    return up, down


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Running sums whose differences, brought to a common power, are hashes of byte ranges."""
    if "val" not in _state:
        _state["val"] = _byte_values()
    up, _ = powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_state["val"][buf] * up[: len(buf)], out=out[1:])
    return out


def range_hash(sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range ``[lo, hi)``."""
    _, down = powers(len(sums))
    return mix((sums[hi] - sums[lo]) * down[lo] + (hi - lo).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return np.where((buf >= 65) & (buf <= 90), buf + np.uint8(32), buf)


def byte_class(test: Callable[[int], bool]) -> np.ndarray:
    return np.array([test(b) for b in range(256)], bool)


#: Bytes of words `[^\x20\x09-\x0D]+`.
NOT_SPACE = byte_class(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`; every byte of a longer UTF-8 sequence is 0x80 or more.
WORD_BYTE = byte_class(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)


def runs(mask: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every maximal run of true bytes, cut at the documents' offsets ``at``."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[at[at <= n]] = True
    edge[0] = edge[n] = True
    first = mask.copy()
    first[1:] &= ~mask[:-1] | edge[1:n]
    last = mask.copy()
    last[:-1] &= ~mask[1:] | edge[1:n]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def owner(at: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Number of the document that holds each byte position."""
    return np.searchsorted(at, lo, "right") - 1


def per_doc(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Sums by document."""
    return np.bincount(doc, weights=values, minlength=n)[:n] if len(doc) else np.zeros(n)
