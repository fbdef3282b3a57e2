"""Benchmark decontamination with a distributed positional inverted index.

The index is partitioned by documents: each row of the stored table is one
block of about 1.5 megabytes of text and holds the block's own vocabulary
and, for every term, the sorted positions of its occurrences (postings).
Building it needs no shuffle, and a frequent term or a hot source is spread
over all blocks.  Positions run through a block with a gap between documents,
so that no phrase crosses from one to the next.

A phrase is looked up by intersecting the postings of its terms, each shifted
by the term's offset in the phrase, from the block's rarest term to its most
frequent one.  Terms are found by 64-bit hash and confirmed by their bytes.

The phrases come in blocks of bounded size (``ITEM_BYTES`` of item text);
each block is sent to the executors once.  With more than one block, the hits
of a document are merged by a shuffle of contaminated documents alone.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import WORD_BYTE, arrow_map, lower_ascii, owner, pieces, prefix_hash, range_hash, runs, stored, table

N_GRAM = 10
ITEM_BYTES = 4_000_000
#: Candidates that one intersection holds at a time.
CHUNK = 1_000_000

#: Text of one block of the index.
BLOCK_BYTES = 1_500_000

INDEX = "bid string, doc_ids array<KEY>, n_words binary, term_text binary, term_size binary, post_count binary, postings binary"
HITS = "bid string, doc int, doc_id KEY, n_words bigint, items array<string>, spans array<int>"
RESULT = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, items array<string>"


def tokens(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and begin, end, document and hash of every word."""
    low = lower_ascii(buf)
    lo, hi = runs(WORD_BYTE[low], at)
    return low, lo, hi, owner(at, lo), range_hash(prefix_hash(low), lo, hi)


def ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Concatenated ``arange(begin, begin + count)``."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(begin - np.concatenate(([0], np.cumsum(count)[:-1])), count)
    return shift + np.arange(total)


def _packed(values: np.ndarray) -> bytes:
    raw = values.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True), kind)


def _index_piece(buf: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Words of each document, and the terms in the order of their hashes: texts, lengths, numbers and steps between postings."""
    low, lo, hi, doc, h = tokens(buf, at)
    order = np.argsort(h, kind="stable")
    hs = h[order]
    first = np.flatnonzero(np.concatenate(([True], hs[1:] != hs[:-1]))) if len(hs) else np.zeros(0, np.int64)
    one = order[first]
    size = hi[one] - lo[one]
    place = (np.arange(len(lo)) + doc)[order]  # one place is left free after each document
    arrays = (np.bincount(doc, minlength=len(at) - 1), low[ranges(lo[one], size)], size, np.diff(np.append(first, len(hs))), np.diff(place, prepend=0))
    return [_packed(a if a.dtype == np.uint8 else a.astype(np.int32)) for a in arrays]


def build_index(docs: DataFrame, text: str = "text", key: str = "doc_id", kind: str = "bigint") -> DataFrame:
    """The stored positional index of ``docs``; one row for each block of documents.

    kind: SQL type of the key, bigint or string.  Null and empty texts are documents without words; a null key stays null.
    Only the two named columns are read, so others may have any name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, at in pieces(batches, "text", BLOCK_BYTES):
            ids = rows.column(0)
            yield pa.RecordBatch.from_arrays(
                [pa.array([uuid.uuid4().hex]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(pa.array([a], pa.binary()) for a in _index_piece(buf, at))],
                names=["bid", "doc_ids", "n_words", "term_text", "term_size", "post_count", "postings"],
            )

    return stored(arrow_map(docs.select(F.col(key).cast(kind).alias("doc_id"), F.col(text).cast("string").alias("text")), run, INDEX.replace("KEY", kind)), "index")


class Block:
    """One row of the index, ready for look-ups."""

    def __init__(self, row: dict):
        self.bid, self.ids = row["bid"], row["doc_ids"]
        self.n_words = _unpacked(row["n_words"], np.int32)
        self.doc_at = np.concatenate(([0], np.cumsum(self.n_words.astype(np.int64) + 1)))
        letters = _unpacked(row["term_text"], np.uint8)
        self.text, self.text_at = letters.tobytes(), np.concatenate(([0], np.cumsum(_unpacked(row["term_size"], np.int32).astype(np.int64))))
        self.hash = range_hash(prefix_hash(letters), self.text_at[:-1], self.text_at[1:])  # rising, as the terms were laid down
        self.count = _unpacked(row["post_count"], np.int32).astype(np.int64)
        self.post_at = np.concatenate(([0], np.cumsum(self.count)))
        self.postings = np.cumsum(_unpacked(row["postings"], np.int32).astype(np.int64))
        self.keys = (np.repeat(np.arange(len(self.hash)), self.count) << 32) | self.postings  # rising

    def find(self, hashes: np.ndarray, words: list[bytes]) -> np.ndarray:
        """Number of each term in this block's vocabulary, or -1."""
        if not len(self.hash):
            return np.full(len(hashes), -1)
        j = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
        out = np.where(self.hash[j] == hashes, j, -1)
        for k in np.flatnonzero(out >= 0):
            if self.text[self.text_at[out[k]] : self.text_at[out[k] + 1]] != words[k]:
                out[k] = -1
        return out

    def doc_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.doc_at, places, "right") - 1


@dataclass
class Phrases:
    """Windows of items: distinct terms, and for each length a matrix of term numbers with the items of its rows."""

    hashes: np.ndarray
    words: list[bytes]
    groups: list[tuple[int, np.ndarray, np.ndarray]]
    items: list[str]


def phrases(items: list[tuple[str, str]], n: int = N_GRAM) -> Phrases:
    """All windows of ``n`` words of (id, text) pairs; a shorter item with a word is one window."""
    raw = [t.encode() for _, t in items]
    at = np.concatenate(([0], np.cumsum([len(t) for t in raw]))).astype(np.int64)
    low, lo, hi, doc, h = tokens(np.frombuffer(b"".join(raw), np.uint8), at)
    hashes, one, number = np.unique(h, return_index=True, return_inverse=True)
    words = [low[lo[i] : hi[i]].tobytes() for i in one]
    ends = np.searchsorted(doc, np.arange(len(items) + 1))
    by: dict[int, list] = {}
    for k in range(len(items)):
        own = number[ends[k] : ends[k + 1]]
        if len(own):
            size = min(n, len(own))
            by.setdefault(size, []).append((np.lib.stride_tricks.sliding_window_view(own, size), k))
    groups = []
    for size, parts in by.items():
        rows = np.concatenate([m for m, _ in parts])
        whose = np.concatenate([np.full(len(m), k) for m, k in parts])
        both = np.unique(np.column_stack((rows, whose)), axis=0)
        groups.append((size, np.ascontiguousarray(both[:, :-1]), both[:, -1]))
    return Phrases(hashes, words, groups, [i for i, _ in items])


def occurrences(block: Block, q: Phrases) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each window length: (length, places where a window begins, the windows' items)."""
    number = block.find(q.hashes, q.words)
    count = np.where(number >= 0, block.count[number] if len(block.count) else 0, 0)
    begin = block.post_at[np.maximum(number, 0)] if len(block.hash) else np.zeros(len(number), np.int64)
    for size, terms, item in q.groups:
        live = np.flatnonzero(count[terms].min(axis=1) > 0)
        if not len(live):
            continue
        order = np.argsort(count[terms[live]], axis=1, kind="stable")  # from the rarest term on
        rare = terms[live, order[:, 0]]
        upto = np.cumsum(count[rare])
        lo = 0
        while lo < len(live):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + CHUNK, "right")))
            w = np.repeat(np.arange(lo, hi), count[rare[lo:hi]])
            start = block.postings[ranges(begin[rare[lo:hi]], count[rare[lo:hi]])] - order[w, 0]
            for k in range(1, size):
                if not len(w):
                    break
                off = order[w, k]
                key = (number[terms[live[w], off]] << 32) + start + off
                key[start < 0] = -1
                j = np.minimum(np.searchsorted(block.keys, key), len(block.keys) - 1)
                good = block.keys[j] == key
                w, start = w[good], start[good]
            if len(w):
                yield size, start, item[live[w]]
            lo = hi


def _hits(block: Block, q: Phrases, everyone: bool) -> Iterator[tuple]:
    """(document, item ids, flat [begin, end) word ranges) of documents with a hit, or of all."""
    found = list(occurrences(block, q))
    docs = [block.doc_of(s) for _, s, _ in found]
    doc = np.concatenate(docs) if docs else np.zeros(0, np.int64)
    start = np.concatenate([s for _, s, _ in found]) if docs else doc
    end = np.concatenate([s + size for size, s, _ in found]) if docs else doc
    item = np.concatenate([i for _, _, i in found]) if docs else doc
    order = np.lexsort((start, doc))
    doc, start, end, item = doc[order], start[order], end[order], item[order]
    at = np.searchsorted(doc, np.arange(len(block.n_words) + 1))
    for d in range(len(block.n_words)) if everyone else np.unique(doc):
        a, b = at[d], at[d + 1]
        spans: list[int] = []
        for s, e in sorted(set(zip((start[a:b] - block.doc_at[d]).tolist(), (end[a:b] - block.doc_at[d]).tolist(), strict=True))):
            if spans and s <= spans[-1]:
                spans[-1] = max(spans[-1], e)
            else:
                spans += [s, e]
        yield int(d), sorted({q.items[i] for i in item[a:b]}), spans


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield Block({name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)})


def phrase_matches(index: DataFrame, q: Phrases, everyone: bool = False) -> DataFrame:
    """Exact matches of ``q`` by document: the items found and the merged ranges of words hit."""
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()
    to = pa.string() if kind == "string" else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks_of(batches):
            rows = list(_hits(block, q, everyone))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block.bid] * len(rows), pa.string()),
                    pa.array([d for d, _, _ in rows], pa.int32()),
                    pa.array([block.ids[d] for d, _, _ in rows], to),
                    pa.array([int(block.n_words[d]) for d, _, _ in rows], pa.int64()),
                    pa.array([i for _, i, _ in rows], pa.list_(pa.string())),
                    pa.array([s for _, _, s in rows], pa.list_(pa.int32())),
                ],
                names=["bid", "doc", "doc_id", "n_words", "items", "spans"],
            )

    # A row is a whole block already: a few rows make an Arrow batch large enough.
    return arrow_map(index, run, HITS.replace("KEY", kind))


def proximity_matches(index: DataFrame, queries: list[tuple[str, str]], slop: int) -> DataFrame:
    """Documents in which all distinct words of a query stand within a range of ``slop`` words, in any order.

    One row for each document and query: doc_id, query, begin and end of the
    first such range (words, end exclusive).  A query without words matches nothing.
    """
    qs = [(name, phrases([(name, text)], n=1)) for name, text in queries]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks_of(batches):
            rows = []
            for name, q in qs:
                number = block.find(q.hashes, q.words)
                if not len(number) or (number < 0).any():
                    continue
                place = np.concatenate([block.postings[block.post_at[t] : block.post_at[t + 1]] for t in number])
                which = np.repeat(np.arange(len(number)), block.count[number])
                order = np.argsort(place, kind="stable")
                place, which = place[order], which[order]
                doc = block.doc_of(place)
                last, lastdoc = np.full(len(number), -1), -1
                done = set()
                for p, t, d in zip(place.tolist(), which.tolist(), doc.tolist(), strict=True):
                    if d != lastdoc:
                        last[:], lastdoc = -1, d
                    last[t] = p
                    begin = int(last.min())
                    if begin >= 0 and p - begin < slop and d not in done:
                        done.add(d)
                        rows.append((block.ids[d], name, begin - int(block.doc_at[d]), p + 1 - int(block.doc_at[d])))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "query", "begin", "end"])

    return arrow_map(index, run, "doc_id bigint, query string, begin bigint, end bigint")


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        items = [sorted(set(x)) for x in b.column("items").to_pylist()]
        hit = []
        for flat in b.column("spans").to_pylist():
            total, upto = 0, 0
            for s, e in sorted(zip(flat[::2], flat[1::2], strict=True)):
                total += max(0, e - max(s, upto))
                upto = max(upto, e)
            hit.append(total)
        yield pa.RecordBatch.from_arrays(
            [
                b.column("doc_id"),
                b.column("n_words"),
                pa.array(hit, pa.int64()),
                pa.array([len(x) for x in items], pa.int64()),
                pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()),
                pa.array([h > 0 for h in hit], pa.bool_()),
                pa.array(items, pa.list_(pa.string())),
            ],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"],
        )


def item_blocks(benchmark: DataFrame, text: str = "text", key: str = "item_id", most: int = ITEM_BYTES) -> Iterator[list[tuple[str, str]]]:
    """Items in blocks of bounded size; the driver holds one partition and one block at a time."""
    block, size = [], 0
    rows = benchmark.select(F.col(key).cast("string"), F.col(text).cast("string")).where(F.col(key).isNotNull() & F.col(text).isNotNull())
    for k, t in rows.toLocalIterator():
        if block and size + len(t) > most:
            yield block
            block, size = [], 0
        block.append((k, t))
        size += len(t)
    if block:
        yield block


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = N_GRAM, block_bytes: int = ITEM_BYTES) -> DataFrame:
    """Words of ``docs`` (doc_id, text) that lie in an occurrence of a window of ``n`` words of ``benchmark`` (item_id, text).

    One row for each row of ``docs``: doc_id, n_words, n_hit, n_items,
    items_sha256, contaminated and the item ids.  Null or empty texts have no
    words and are clean; items with a null id or text, or without words, are
    never found; rows that repeat an item id count as one item; repeated
    documents are judged each; empty tables give an empty result or clean
    documents.  Other columns of the inputs are not read.
    """
    index = build_index(docs)
    parts = [phrase_matches(index, phrases(block, n), everyone=not k) for k, block in enumerate(item_blocks(benchmark, most=block_bytes))]
    if not parts:
        parts = [phrase_matches(index, phrases([], n), everyone=True)]
    hits = parts[0]
    if len(parts) > 1:
        for part in parts[1:]:
            hits = hits.unionByName(part)
        hits = hits.groupBy("bid", "doc").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))
    return arrow_map(hits.select("doc_id", "n_words", "items", "spans"), _finish, RESULT)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = N_GRAM, block_bytes: int = ITEM_BYTES) -> DataFrame:
    """Rows of ``docs`` without a hit; all columns stay as they are.

    The verdict on a text belongs to all its copies, so hits are named by the
    text's digest; ids may be null or repeat.
    """
    name = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    index = build_index(docs.select(name.alias("digest"), "text"), key="digest", kind="string")
    hits = None
    for block in item_blocks(benchmark, most=block_bytes):
        part = phrase_matches(index, phrases(block, n)).select(F.col("doc_id").alias("__digest"))
        hits = part if hits is None else hits.unionByName(part)
    if hits is None:
        return docs
    return docs.join(stored(hits.distinct(), "hits"), name == F.col("__digest"), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS s
  FROM (SELECT item_id, w, least(len(w), {N_GRAM}) AS n, unnest(generate_series(1, len(w) - least(len(w), {N_GRAM}) + 1)) AS p FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT r, n, p, array_to_string(w[p:p + n - 1], ' ') AS s
  FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT r, n, p, item_id FROM dw JOIN iw USING (n, s)),
hw AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(generate_series(p, p + n - 1)) AS k FROM h) GROUP BY r),
hi AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM h) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN hi USING (r)
"""
