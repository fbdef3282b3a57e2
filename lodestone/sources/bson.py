"""A decoder for concatenated binary documents, and a reader of dump files."""

from __future__ import annotations

import base64
import datetime
import json
import struct
import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

# Element types of the format.
_DOUBLE, _STRING, _DOCUMENT, _ARRAY, _BINARY, _UNDEFINED, _ID, _BOOL, _DATE, _NULL, _REGEX = range(1, 12)
_POINTER, _CODE, _SYMBOL, _SCOPED, _INT32, _STAMP, _INT64, _DECIMAL = range(12, 20)
_MIN, _MAX = 0xFF, 0x7F
_EPOCH = datetime.datetime(1970, 1, 1)


def _cstring(data: bytes, at: int) -> tuple[str, int]:
    end = data.index(b"\x00", at)
    return data[at:end].decode(), end + 1


def _string(data: bytes, at: int) -> tuple[str, int]:
    (size,) = struct.unpack_from("<i", data, at)
    if size < 1 or at + 4 + size > len(data):
        raise ValueError("a string is cut off")
    return data[at + 4 : at + 3 + size].decode(), at + 4 + size


def _decimal(raw: bytes) -> str:
    low, high = struct.unpack("<QQ", raw)
    sign = "-" if high >> 63 else ""
    if (high >> 58) & 31 == 31:
        return "NaN"
    if (high >> 58) & 31 == 30:
        return sign + "Infinity"
    if (high >> 61) & 3 == 3:
        return sign + "0"
    exponent = ((high >> 49) & 0x3FFF) - 6176
    digits = str((high & ((1 << 49) - 1)) << 64 | low)
    if exponent == 0:
        return sign + digits
    if exponent > 0:
        return f"{sign}{digits}E+{exponent}"
    digits = digits.zfill(1 - exponent)
    return f"{sign}{digits[:exponent]}.{digits[exponent:]}"


def _value(kind: int, data: bytes, at: int) -> tuple[Any, int]:
    if kind == _DOUBLE:
        return struct.unpack_from("<d", data, at)[0], at + 8
    if kind in (_STRING, _CODE, _SYMBOL):
        return _string(data, at)
    if kind in (_DOCUMENT, _ARRAY):
        (size,) = struct.unpack_from("<i", data, at)
        got = decode(data[at : at + size])
        return (list(got.values()) if kind == _ARRAY else got), at + size
    if kind == _BINARY:
        size, subtype = struct.unpack_from("<iB", data, at)
        raw = data[at + 5 : at + 5 + size]
        return (str(uuid.UUID(bytes=raw)) if subtype == 4 and size == 16 else raw), at + 5 + size
    if kind == _ID:
        return data[at : at + 12].hex(), at + 12
    if kind == _BOOL:
        return data[at] == 1, at + 1
    if kind == _DATE:
        return _EPOCH + datetime.timedelta(milliseconds=struct.unpack_from("<q", data, at)[0]), at + 8
    if kind in (_NULL, _UNDEFINED, _MIN, _MAX):
        return None, at
    if kind == _REGEX:
        pattern, at = _cstring(data, at)
        options, at = _cstring(data, at)
        return f"/{pattern}/{options}", at
    if kind == _POINTER:
        name, at = _string(data, at)
        return f"{name}:{data[at : at + 12].hex()}", at + 12
    if kind == _SCOPED:
        (size,) = struct.unpack_from("<i", data, at)
        return _string(data, at + 4)[0], at + size
    if kind == _INT32:
        return struct.unpack_from("<i", data, at)[0], at + 4
    if kind == _STAMP:
        i, t = struct.unpack_from("<II", data, at)
        return {"t": t, "i": i}, at + 8
    if kind == _INT64:
        return struct.unpack_from("<q", data, at)[0], at + 8
    if kind == _DECIMAL:
        return _decimal(data[at : at + 16]), at + 16
    raise ValueError(f"unknown element type {kind}")


def decode(data: bytes) -> dict[str, Any]:
    """One document."""
    (size,) = struct.unpack_from("<i", data)
    if size != len(data) or size < 5 or data[-1]:
        raise ValueError("not a document")
    at, out = 4, {}
    while data[at]:
        kind = data[at]
        name, at = _cstring(data, at + 1)
        out[name], at = _value(kind, data, at)
    return out


def documents(data: bytes) -> Iterator[dict[str, Any]]:
    """Documents one after another; what is too short to be one ends them, a bad one raises an error."""
    at = 0
    while at + 4 <= len(data):
        (size,) = struct.unpack_from("<i", data, at)
        if size < 5 or at + size > len(data):
            return
        yield decode(data[at : at + size])
        at += size


def to_json(value: dict) -> str:
    def other(x: Any) -> str:
        return base64.b64encode(x).decode() if isinstance(x, bytes) else x.isoformat()

    return json.dumps(value, default=other, allow_nan=False, ensure_ascii=False)


def read_bson(spark: SparkSession, path: str) -> DataFrame:
    """Documents of dump files: file, n (place in it), and v, the document as a VARIANT.

    A file is one task, as its documents can only be walked from its begin.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, content in zip(frame["path"], frame["content"], strict=True):
                rows = []
                for n, document in enumerate(documents(bytes(content))):
                    rows.append((file, n, to_json(document)))
                    if len(rows) >= 5000:
                        yield pd.DataFrame(rows, columns=["file", "n", "json"])
                        rows = []
                yield pd.DataFrame(rows, columns=["file", "n", "json"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, n bigint, json string").select("file", "n", F.parse_json("json").alias("v"))
