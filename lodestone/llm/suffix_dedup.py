"""Removal of repeated byte strings by bucket-pointer refinement.

A byte goes if a string of ``SPAN`` bytes that covers it starts anywhere else.
The same refinement over words finds passages of ``PASSAGE`` words or more.

A bucket holds suffixes that agree on their first symbols, and its pointer is
an identifier that depends on these symbols alone, so tasks on all executors
name equal buckets alike.  Pointers are made by doubling: that of ``2 w``
symbols at a place is made of those of ``w`` symbols there and ``w`` symbols
later, and pointers once refined are used again for all longer strings.

1. Anchors.  Every string of ``SPAN`` bytes points at one q-gram in it: the
   leftmost whose pointer is least.  Equal strings point at equal q-grams at
   equal places, so the suffixes at anchors (one in about 170 bytes) are the
   only ones to sort, and their q-grams are the initial buckets.  The strings
   that point at an anchor lie in its hull, some bytes to its left and right.
2. Hulls with the same pointer that occur twice are settled, and so is a
   suffix alone in its bucket.
3. What is left are buckets with several hulls that differ somewhere.  Each is
   refined on the pointers of later and later offsets.  The strings of a hull
   are numbered by their distance to the anchor.  Those in one interval of
   distances have a common middle; suffixes stay together if the pointers of
   their middles are equal.  Alone in its bucket: nothing in the interval
   repeats.  All with the same outer string: all of it repeats.  Else the
   interval is cut into smaller ones, with longer middles, down to one string.

Each refinement groups pointers by an aggregation with partial results: no
task ever holds a bucket, however many suffixes are in it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import NOT_SPACE, Tables, arrow_map, owner, pieces, runs, table

SPAN = 400
#: Words of a passage that counts as repeated: over fifty.
PASSAGE = 51


@dataclass(frozen=True)
class Unit:
    """What strings are made of.  widths: of the intervals of distances, one for each refinement, the last 1.

    ``q`` is a power of two; the middle of the first intervals is as long as the largest power of two in ``span``, at least.
    """

    span: int
    q: int
    widths: tuple[int, ...]

    @property
    def top(self) -> int:
        return 1 << (self.span.bit_length() - 1)


#: By the last bit of a bucket: bytes, words.
UNITS = (Unit(SPAN, 64, (48, 6, 1)), Unit(PASSAGE, 8, (6, 1)))

_TEXTS = "uid bigint, doc_id bigint, z binary, n_bytes bigint, n_words bigint, sha binary, h array<bigint>, c array<bigint>, pos array<int>, l array<smallint>, r array<smallint>"
_HULLS = "uid bigint, pos int, l int, r int, h bigint, n bigint, hull binary"
_PARTS = "bucket bigint, outer bigint, uid bigint, pos int, h bigint, n bigint, a int, b int"

_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _pair(first: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Pointers of strings from those of two parts."""
    out = first * _C1
    out ^= out >> np.uint64(29)
    out += later
    out *= _C2
    out ^= out >> np.uint64(32)
    return out


def pointers(symbols: np.ndarray, widths: tuple[int, ...]) -> list[np.ndarray]:
    """Bucket pointers of the strings of each width (rising powers of two) at all places, by doubling."""
    out, now, w = [], symbols, 1
    for width in widths:
        while w < width:
            now = _pair(now[:-w], now[w:]) if len(now) > w else now[:0]
            w *= 2
        out.append(now)
    return out


def pointer(top: np.ndarray, w: int, lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Pointers of strings of ``size`` symbols, from ``w`` to ``4 w``, from those of ``w`` symbols."""
    end = lo + size
    twice = size >= 2 * w
    out = np.empty(len(lo), np.uint64)
    one, two = np.flatnonzero(~twice), np.flatnonzero(twice)
    out[one] = _pair(top[lo[one]], top[end[one] - w])
    out[two] = _pair(_pair(top[lo[two]], top[lo[two] + w]), _pair(top[end[two] - 2 * w], top[end[two] - w]))
    return _pair(out, size.astype(np.uint64))


def _byte_symbols() -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)


def byte_symbols(buf: np.ndarray) -> np.ndarray:
    return _byte_symbols()[buf]


def word_symbols(buf: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """One symbol for each word [lo, hi): equal words have equal symbols."""
    size = hi - lo
    if not len(lo):
        return np.zeros(0, np.uint64)
    now = byte_symbols(buf)
    out = np.empty(len(lo), np.uint64)
    w = 1
    left = np.arange(len(lo))
    while len(left):  # words of w to 2 w - 1 bytes
        fit = left[size[left] < 2 * w]
        out[fit] = _pair(now[lo[fit]], now[hi[fit] - w])
        left = left[size[left] >= 2 * w]
        now = _pair(now[:-w], now[w:]) if len(now) > w else now[:0]
        w *= 2
    return _pair(out, size.astype(np.uint64))


def anchors(symbols: np.ndarray, at: np.ndarray, unit: Unit) -> tuple[np.ndarray, ...]:
    """Anchors of all documents (``at``: their offsets): document, place, bucket of the q-gram, symbols of the hull left and right of it, pointer of the hull."""
    span, q = unit.span, unit.q
    n = len(symbols)
    width = span - q + 1  # grams in a string
    empty = np.zeros(0, np.int64)
    none = empty, empty, np.zeros(0, np.uint64), empty, empty, np.zeros(0, np.uint64)
    if n < span:
        return none
    gram, top = pointers(symbols, (q, unit.top))
    # Least pointer of each window of grams, from running minima within blocks of the window's size.
    rows = -(-len(gram) // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(gram)] = gram
    block = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - span + 1
    least = np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows])
    # Runs of windows of one document that have the same least gram.
    edge = np.zeros(windows, bool)
    edge[0] = True
    edge[1:] = least[1:] != least[:-1]
    edge[at[:-1][at[:-1] < windows]] = True
    ends = at[1:] - span + 1  # first window that leaves its document
    edge[ends[(ends >= 0) & (ends < windows)]] = True
    lo = np.flatnonzero(edge)
    hi = np.append(lo[1:], windows) - 1
    doc = owner(at, lo)
    inside = lo + span <= at[doc + 1]
    lo, hi, doc = lo[inside], hi[inside], doc[inside]
    if not len(lo):
        return none
    # Places of these least grams: a small table of bits drops nearly all others before the exact test.
    values, rank = np.unique(least[lo], return_inverse=True)
    bits = np.zeros(1 << 20, bool)
    bits[(values >> np.uint64(44)).astype(np.int64)] = True
    places = np.flatnonzero(bits[(gram >> np.uint64(44)).astype(np.int64)])
    which = np.minimum(np.searchsorted(values, gram[places]), len(values) - 1)
    good = values[which] == gram[places]
    keys = np.sort((which[good].astype(np.int64) << 32) | places[good])
    # A window points at the first place of its least gram in it, so a run is cut behind each such place.
    a = np.searchsorted(keys, (rank.astype(np.int64) << 32) | lo)
    b = np.searchsorted(keys, (rank.astype(np.int64) << 32) | (hi + width - 1), "right")
    count = b - a
    run = np.repeat(np.arange(len(lo)), count)
    index = np.repeat(a - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
    pos = keys[index] & 0xFFFFFFFF
    before = np.where(index > a[run], keys[np.maximum(index - 1, 0)] & 0xFFFFFFFF, -1)
    first, last = np.maximum(lo[run], before + 1), np.minimum(hi[run], pos)
    some = first <= last
    run, pos, first, last = run[some], pos[some], first[some], last[some]
    # Runs that only a document's end or another run's begin cut apart, but point at one place, are one hull.
    fresh = np.concatenate(([True], (pos[1:] != pos[:-1]) | (first[1:] != last[:-1] + 1) | (doc[run][1:] != doc[run][:-1])))
    head = np.flatnonzero(fresh)
    tail = np.append(head[1:], len(pos)) - 1
    run, pos, first, last = run[head], pos[head], first[head], last[tail]
    hull = pointer(top, unit.top, first, last + span - first)
    return doc[run], pos, gram[pos], pos - first, last + span - pos, _pair(hull, (pos - first).astype(np.uint64))


def _words(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of all words, and the documents' offsets into them."""
    lo, hi = runs(NOT_SPACE[buf], at)
    return lo, hi, np.searchsorted(lo, at)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compressed texts (doc_id, text) with their anchors and a number for each row."""
    task = TaskContext.get()
    number = (task.partitionId() if task else 0) << 33
    for rows, buf, at in pieces(batches):
        n = rows.num_rows
        lo, hi, word_at = _words(buf, at)
        found = []
        for bit, (symbols, cut) in enumerate(((byte_symbols(buf), at), (word_symbols(buf, lo, hi), word_at))):
            doc, pos, h, left, right, c = anchors(symbols, cut, UNITS[bit])
            found.append((doc, pos - cut[doc], (h & ~np.uint64(1)) | np.uint64(bit), left, right, c))
        doc, pos, h, left, right, c = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(doc, kind="stable")
        cut = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=n)[:n]))).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(v[order])) for v in (h.view(np.int64), c.view(np.int64), pos.astype(np.int32), left.astype(np.int16), right.astype(np.int16))]
        each = [buf[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        z = pa.array([pa.compress(x, "zstd", asbytes=True) for x in each], pa.binary())
        sha = pa.array([hashlib.sha256(x).digest() for x in each], pa.binary())
        uid = pa.array(np.arange(number, number + n))
        number += n
        yield pa.RecordBatch.from_arrays([uid, rows.column(0), z, pa.array(np.diff(at)), pa.array(np.diff(word_at)), sha, *lists], names=["uid", "doc_id", "z", "n_bytes", "n_words", "sha", "h", "c", "pos", "l", "r"])


def _hulls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the hulls asked for (uid, z, n_bytes, list of places)."""
    for batch in batches:
        out: list[tuple] = []
        size = 0
        for uid, z, n_bytes, wanted in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            text = pa.decompress(z, n_bytes, "zstd", asbytes=True)
            lo = hi = None
            for w in wanted:
                a, b = w["pos"] - w["l"], w["pos"] + w["r"]
                if w["h"] & 1:
                    if lo is None:
                        lo, hi, _ = _words(np.frombuffer(text, np.uint8), np.array([0, n_bytes]))
                    a, b = int(lo[a]), int(hi[b - 1])
                out.append((uid, w["pos"], w["l"], w["r"], w["h"], w["n"], text[a:b]))
                size += b - a
                if size > 1 << 20:
                    yield _hull_batch(out)
                    out, size = [], 0
        yield _hull_batch(out)


def _hull_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["uid", "pos", "l", "r", "h", "n", "hull"])


def parts(batch: pa.RecordBatch, level: int) -> Iterator[pa.RecordBatch]:
    """Intervals of a batch of hulls at one level of refinement, with the pointers of their middles (as buckets) and outer strings.

    Hulls have a list ``todo`` of the intervals (a, b) that the level before left open, or null at the first level.
    """
    column = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
    bits = column["h"].to_numpy() & 1
    for bit, unit in enumerate(UNITS):
        rows = np.flatnonzero(bits == bit)
        if not len(rows) or level >= len(unit.widths):
            continue
        uid, pos, left, right, h, n = (column[name].to_numpy()[rows].astype(np.int64) for name in ("uid", "pos", "l", "r", "h", "n"))
        hulls = [column["hull"][k].as_py() for k in rows.tolist()]
        buf = np.frombuffer(b"".join(hulls), np.uint8)
        symbols = byte_symbols(buf)
        if bit:
            at = np.concatenate(([0], np.cumsum([len(x) for x in hulls])))
            symbols = word_symbols(buf, *runs(NOT_SPACE[buf], at))
        (top,) = pointers(symbols, (unit.top,))
        anchor = np.cumsum(left + right) - right
        if level:
            todo = column["todo"].take(pa.array(rows))
            one = np.repeat(np.arange(len(rows)), todo.value_lengths().to_numpy(zero_copy_only=False))
            a, b = (todo.flatten().field(x).to_numpy().astype(np.int64) for x in ("a", "b"))
        else:
            one, a, b = np.arange(len(rows)), np.maximum(0, unit.span - right), left
        w = unit.widths[level]
        first = a // w
        count = b // w - first + 1
        k = np.repeat(np.arange(len(one)), count)
        j = first[k] + np.arange(len(k)) - np.repeat(np.cumsum(count) - count, count)
        one, a, b = one[k], np.maximum(a[k], j * w), np.minimum(b[k], j * w + w - 1)
        near, far = j * w, np.minimum(j * w + w - 1, unit.span - unit.q)  # of the whole interval, whatever part of it the hull has
        middle = pointer(top, unit.top, anchor[one] - near, unit.span - far + near)
        outer = pointer(top, unit.top, anchor[one] - b, unit.span + b - a)
        bucket = _pair(_pair(h[one].view(np.uint64), j.astype(np.uint64)), middle)
        outer = _pair(_pair(outer, a.astype(np.uint64)), b.astype(np.uint64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(bucket.view(np.int64)), pa.array(outer.view(np.int64)), pa.array(uid[one]), pa.array(pos[one], pa.int32()), pa.array(h[one]), pa.array(n[one]), pa.array(a, pa.int32()), pa.array(b, pa.int32())],
            names=["bucket", "outer", "uid", "pos", "h", "n", "a", "b"],
        )


def _ranges(found: list[dict], bit: int) -> list[list[int]]:
    """Maximal runs of the ranges of one unit."""
    merged: list[list[int]] = []
    for lo, hi in sorted((x["lo"], x["hi"]) for x in found if x["bit"] == bit):
        if merged and lo <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], hi)
        else:
            merged.append([lo, hi])
    return merged


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (doc_id, z, n_bytes, n_words, sha, runs) without their repeated runs."""
    for batch in batches:
        removed, spans, digests, words = [], [], [], []
        for z, size, sha, found in zip(*(batch.column(k).to_pylist() for k in (1, 2, 4, 5)), strict=True):
            merged = _ranges(found or [], 0)
            digest = sha
            if merged:
                text, at, rest = memoryview(pa.decompress(z, size, "zstd", asbytes=True)), 0, hashlib.sha256()
                for lo, hi in [*merged, [size, size]]:
                    rest.update(text[at:lo])
                    at = hi
                digest = rest.digest()
            removed.append(sum(hi - lo for lo, hi in merged))
            spans.append(len(merged))
            digests.append(digest.hex())
            words.append(sum(hi - lo for lo, hi in _ranges(found or [], 1)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string()), pa.array(words, pa.int64())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words"])


def repeated_runs(texts: DataFrame, tables: Tables) -> DataFrame:
    """(uid, bit, lo, hi) of runs of bytes (bit 0) or words (bit 1) that lie in a repeated string; runs may overlap."""
    each = texts.select("uid", F.explode(F.arrays_zip("h", "c", "pos", "l", "r")).alias("a")).select("uid", "a.*")
    kinds = tables.stored(each.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("uid", "pos", "l", "r")).alias("one")), "kinds")
    open_ = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).where("k > 1 AND least = 1").select(F.col("h").alias("h2"))
    asked = kinds.join(open_, F.col("h") == F.col("h2")).select("one.*", "h", "n")
    asked = tables.stored(asked.groupBy("uid").agg(F.collect_list(F.struct("pos", "l", "r", "h", "n")).alias("wanted")), "asked")
    twice = kinds.where("n > 1").select(F.col("h").alias("h2"), F.col("c").alias("c2"))
    settled = each.join(twice, (F.col("h") == F.col("h2")) & (F.col("c") == F.col("c2")))
    found = [tables.stored(settled.select("uid", F.col("h").bitwiseAND(1).cast("int").alias("bit"), (F.col("pos") - F.col("l")).alias("lo"), (F.col("pos") + F.col("r")).alias("hi")), "settled")]
    tables.drop("kinds")
    hulls = tables.stored(arrow_map(texts.select("uid", "z", "n_bytes").join(asked, "uid").select("uid", "z", "n_bytes", "wanted"), _hulls, _HULLS), "hulls")
    tables.drop("asked")
    span = F.when(F.col("bit") == 0, UNITS[0].span).otherwise(UNITS[1].span)
    todo = None
    for level in range(max(len(u.widths) for u in UNITS)):
        if todo is None:
            live = hulls.withColumn("todo", F.lit(None).cast("array<struct<a:int,b:int>>"))
        else:
            live = hulls.join(todo.groupBy("uid", "h", "pos").agg(F.collect_list(F.struct("a", "b")).alias("todo")), ["uid", "h", "pos"]).select(*hulls.columns, "todo")

        def refine(batches: Iterator[pa.RecordBatch], level: int = level) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from parts(batch, level)

        rows = tables.stored(arrow_map(live, refine, _PARTS), f"parts{level}")
        buckets = rows.groupBy("bucket").agg(F.sum("n").alias("total"), (F.min("outer") == F.max("outer")).alias("same")).where("total > 1").select(F.col("bucket").alias("bucket2"), "same")
        kept = tables.stored(rows.join(buckets, F.col("bucket") == F.col("bucket2")).select("uid", "pos", "h", "n", "a", "b", "same", F.col("h").bitwiseAND(1).cast("int").alias("bit")), f"kept{level}")
        found.append(kept.where("same AND n = 1").select("uid", "bit", (F.col("pos") - F.col("b")).alias("lo"), (F.col("pos") - F.col("a") + span).alias("hi")))
        todo = kept.where("NOT same")
        tables.drop(f"parts{level}")
    tables.drop("hulls")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """What is left of every document without its repeated strings.

    One row for each row of ``docs``: doc_id, n_bytes, n_removed, n_spans,
    kept_sha256, and n_passage_words, the number of words in passages of
    ``PASSAGE`` words or more that also start anywhere else, whatever the
    white space between words (removal goes by bytes alone).  Null counts as
    empty; texts under ``SPAN`` bytes stay whole; repeated rows are copies of
    each other and go; an empty table gives an empty result; only the two
    named columns are read.
    """
    tables = Tables(docs.sparkSession)
    whole = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    texts = tables.stored(arrow_map(whole, _texts, _TEXTS), "texts")
    found = repeated_runs(texts, tables).groupBy("uid").agg(F.collect_list(F.struct("bit", "lo", "hi")).alias("found"))
    joined = texts.select("uid", "doc_id", "z", "n_bytes", "n_words", "sha").join(found, "uid", "left").select("doc_id", "z", "n_bytes", "n_words", "sha", "found")
    left = tables.stored(arrow_map(joined, _cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_passage_words bigint"), "cut")
    tables.drop("texts", "settled", *(f"kept{k}" for k in range(max(len(u.widths) for u in UNITS))))
    return left


def query(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, p, md5(substring(h, 2 * p + 1, {2 * SPAN})) AS k FROM (SELECT r, h, unnest(range(0, len(h) // 2 - {SPAN - 1})) AS p FROM d)),
t AS (SELECT r, p, count(*) OVER (PARTITION BY k) AS n FROM w),
s AS (SELECT r, p, CASE WHEN p - lag(p) OVER (PARTITION BY r ORDER BY p) <= {SPAN} THEN 0 ELSE 1 END AS fresh FROM t WHERE n > 1),
i AS (SELECT r, p, sum(fresh) OVER (PARTITION BY r ORDER BY p) AS run FROM s),
x AS (SELECT r, run, min(p) AS lo, max(p) + {SPAN} AS hi FROM i GROUP BY r, run),
y AS (SELECT r, lo, hi, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS after FROM x),
c AS (SELECT y.r, count(*) AS n_spans, sum(hi - lo) AS n_removed, max(hi) AS last, string_agg(substring(h, CAST(2 * after + 1 AS BIGINT), CAST(2 * (lo - after) AS BIGINT)), '' ORDER BY lo) AS head
  FROM y JOIN d USING (r) GROUP BY y.r),
v AS (SELECT r, list_filter(string_split_regex(text, '[\\x09-\\x0D\\x20]+'), lambda x: x <> '') AS w FROM d),
q AS (SELECT r, p, md5(array_to_string(w[p + 1 : p + {PASSAGE}], ' ')) AS k FROM (SELECT r, w, unnest(range(0, len(w) - {PASSAGE - 1})) AS p FROM v)),
b AS (SELECT r, p, count(*) OVER (PARTITION BY k) AS n FROM q),
e AS (SELECT r, least({PASSAGE}, coalesce(lead(p) OVER (PARTITION BY r ORDER BY p) - p, {PASSAGE})) AS covered FROM b WHERE n > 1),
g AS (SELECT r, CAST(sum(covered) AS BIGINT) AS n_passage_words FROM e GROUP BY r)
SELECT doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN last IS NULL THEN h ELSE head || substring(h, CAST(2 * last + 1 AS BIGINT)) END)) AS kept_sha256, coalesce(n_passage_words, 0) AS n_passage_words
FROM d LEFT JOIN c USING (r) LEFT JOIN g USING (r)
"""
