"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are laid into tiles by the population counts of their
four 16-bit lanes.  Two fingerprints within the radius have lane counts whose
differences add up to at most the radius, so only tile pairs that close are
compared; inside a pair, numpy compares every fingerprint with every other by
exclusive-or and bit count.  A lane-count cell with many fingerprints is cut
into several tiles of at most about ``TILE`` by a hash, so that one comparison
is bounded whatever the data.  The table of cells has at most 17**4 rows.

Copies of a text share a fingerprint and are one row before any comparison.
Each tile pair returns a spanning forest of its links, never all its pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import NOT_SPACE, arrow_map, lower_ascii, owner, pieces, runs, stored, table
from .components import components

SHINGLE = 3
RADIUS = 3
SEED = 42
LANES = 4
TILE = 2048


def _spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    total = int(count.sum())
    return np.repeat(begin - np.cumsum(count) + count, count) + np.arange(total)


def _fingerprints(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One unsigned fingerprint for each document."""
    n = len(at) - 1
    out = np.zeros(n, np.uint64)
    low = lower_ascii(buf)
    lo, hi = runs(NOT_SPACE[low], at)
    if not len(lo):
        return out
    words = np.bincount(owner(at, lo), minlength=n)
    size = hi - lo + 1
    index = np.minimum(_spread(lo, size), len(low) - 1)
    ends = np.cumsum(size)
    flat = low[index]
    flat[ends - 1] = 32
    line = flat.tobytes()  # all words, a space after each
    per = np.where(words >= SHINGLE, words - SHINGLE + 1, np.minimum(words, 1))
    first = _spread(np.cumsum(words) - words, per)
    last = first + np.repeat(np.minimum(words, SHINGLE), per) - 1
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[a:b], SEED) for a, b in zip((ends - size)[first].tolist(), (ends[last] - 1).tolist(), strict=True)], np.uint64)
    # Bits are counted in byte lanes: 255 shingles at most for each partial sum.
    doc_lo = np.cumsum(per) - per
    steps = (per + 254) // 255
    own = np.repeat(np.arange(n), steps)
    cut = np.repeat(doc_lo, steps) + 255 * (np.arange(len(own)) - np.repeat(np.cumsum(steps) - steps, steps))
    ones = np.uint64(0x0101010101010101)
    for j in range(8):
        part = np.add.reduceat((h >> np.uint64(j)) & ones, cut).view(np.uint8).reshape(-1, 8)
        for byte in range(8):
            total = np.bincount(own, weights=part[:, byte], minlength=n)
            out |= (2 * total > per).astype(np.uint64) << np.uint64(8 * byte + j)
    return out


def with_fingerprint(docs: DataFrame, text: str = "text", to: str = "fp") -> DataFrame:
    """``docs`` with one more column: the 64-bit fingerprint as a signed long.  Zero for null texts and texts without words."""
    fields = [f for f in docs.schema.fields if f.name != to]
    at_text = [f.name for f in fields].index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbered = pa.RecordBatch.from_arrays([batch.column(at_text)], names=["text"])
            fp = [_fingerprints(buf, at) for _, buf, at in pieces(iter([numbered]))]
            values = np.concatenate(fp).view(np.int64) if fp else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values)], names=[*batch.schema.names, to])

    schema = T.StructType([*fields, T.StructField(to, T.LongType())])
    return arrow_map(docs.select(*[docs[f"`{f.name}`"] for f in fields]), run, schema)


def _forest(u: np.ndarray, v: np.ndarray, labels: np.ndarray) -> None:
    """Merge the edges into ``labels`` (each node's smallest known node), in place."""
    while True:
        a, b = labels[u], labels[v]
        differ = a != b
        if not differ.any():
            return
        u, v = u[differ], v[differ]
        np.minimum.at(labels, np.maximum(a, b)[differ], np.minimum(a, b)[differ])
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up


def _links(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two tiles: (fingerprint, fingerprint)."""
    nodes = a if same else np.concatenate((a, b))
    shift = 0 if same else len(a)
    labels = np.arange(len(nodes))
    left, right = a.view(np.uint64), b.view(np.uint64)
    step = max(1, 1_000_000 // max(1, len(b)))
    for lo in range(0, len(a), step):
        u, v = np.nonzero(np.bitwise_count(left[lo : lo + step, None] ^ right[None, :]) <= radius)
        if len(u):
            _forest(u + lo, v + shift, labels)
    linked = np.flatnonzero(labels != np.arange(len(nodes)))
    return nodes[linked], nodes[labels[linked]]


def _cell(fp: Column) -> Column:
    out = F.lit(0)
    for lane in range(LANES):
        out = out * 17 + F.bit_count(F.shiftrightunsigned(fp, 16 * lane).bitwiseAND(F.lit(0xFFFF)))
    return out


def _near_cells(radius: int) -> list[tuple[int, ...]]:
    """Offsets to cells within the radius, one of each opposite pair, and to the cell itself."""
    return [d for d in itertools.product(range(-radius, radius + 1), repeat=LANES) if sum(map(abs, d)) <= radius and d >= (0,) * LANES]


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Spanning links (u, v) between distinct fingerprints (column fp) at most ``radius`` bits apart."""
    cells = fps.select("fp", _cell(F.col("fp")).alias("cell"))
    sizes = stored(cells.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles")), "cells")  # 17**4 rows at most
    split = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    tiles = stored(cells.join(F.broadcast(sizes), "cell").select("cell", split.alias("part"), "fp").groupBy("cell", "part").agg(F.collect_list("fp").alias("fps")), "tiles")
    lane = [F.pmod(F.floor(F.col("cell") / 17 ** (LANES - 1 - k)), F.lit(17)).cast("int") for k in range(LANES)]
    moves = F.array(*[F.array(*[F.lit(x) for x in d]) for d in _near_cells(radius)])
    near = sizes.select("cell", "tiles", *[x.alias(f"l{k}") for k, x in enumerate(lane)], F.explode(moves).alias("d"))
    to = [F.col(f"l{k}") + F.col("d")[k] for k in range(LANES)]
    inside = to[0].between(0, 16)
    other = to[0]
    for x in to[1:]:
        inside, other = inside & x.between(0, 16), other * 17 + x
    pairs = (
        near.where(inside)
        .select("cell", "tiles", other.alias("cell2"))
        .join(F.broadcast(sizes.select(F.col("cell").alias("cell2"), F.col("tiles").alias("tiles2"))), "cell2")
        .select("cell", "cell2", "tiles2", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("part"))
        .select("cell", "part", "cell2", F.explode(F.sequence(F.lit(0), F.col("tiles2") - 1)).alias("part2"))
        .where("cell <> cell2 OR part <= part2")
    )
    met = pairs.join(tiles, ["cell", "part"]).join(tiles.select(F.col("cell").alias("cell2"), F.col("part").alias("part2"), F.col("fps").alias("fps2")), ["cell2", "part2"])
    met = met.where("cell <> cell2 OR part <> part2 OR size(fps) > 1").select("fps", "fps2", ((F.col("cell") == F.col("cell2")) & (F.col("part") == F.col("part2"))).alias("same"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [], []
            for a, b, same in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist(), strict=True):
                u, v = _links(np.asarray(a.values, np.int64), np.asarray(b.values, np.int64), same, radius)
                us.append(u)
                vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us) if us else [], pa.int64()), pa.array(np.concatenate(vs) if vs else [], pa.int64())], names=["u", "v"])

    return arrow_map(met, run, "u bigint, v bigint")


def groups_of(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(node, root) of every linked fingerprint among the distinct ones in column fp; none for an empty table."""
    return stored(components(links(stored(fps, "distinct"), radius)), "roots")


def classes(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, component_id) of every fingerprint in ``docs`` (doc_id, fp); component_id is the smallest doc_id reachable.

    An empty table gives an empty result; a null doc_id counts only where no other is reachable.
    """
    least = stored(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "least")
    roots = groups_of(least.select("fp"), radius)
    linked = least.join(roots, least.fp == roots.node).select("fp", "root", "least")
    ids = stored(linked.groupBy("root").agg(F.min("least").alias("component_id")), "ids")
    named = roots.join(ids, "root").select("node", "component_id")
    return stored(least.join(named, least.fp == named.node, "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "classes")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Fingerprint and group of every document: doc_id, fingerprint (16 hex digits), component_id.

    Null texts and texts without words have fingerprint zero and are linked
    like any other.  Repeated rows are returned each.  A null doc_id counts
    for a group only if the group has no other.  An empty table gives an
    empty result; only the two named columns are read.
    """
    own = stored(with_fingerprint(docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))).select("doc_id", "fp"), "fingerprints")
    groups = classes(own, radius)
    return own.join(groups, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` without near-duplicates: of each group the row with the smallest doc_id stays, and of equal ids one row.

    Rows with a null doc_id stay only if their group has no other row.  Rows
    with the same id and text are one document.
    All columns stay as they are, whatever their names.
    """
    name = F.md5(F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary"))
    marked = with_fingerprint(docs.select(F.col("doc_id").alias("id"), name.alias("digest"), F.col("text").cast("string").alias("text")))
    ids = stored(marked.select("id", "digest", "fp"), "fingerprints")
    first = ids.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull(), "id", "digest")).alias("first"))
    groups = groups_of(first.select("fp"), radius)
    # Fingerprints that are not linked are groups of their own.
    winners = first.join(groups, first.fp == groups.node, "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    winners = stored(winners.select(F.col("first.id").alias("__id"), F.col("first.digest").alias("__digest")), "kept")
    own = "__own"
    while own in docs.columns:
        own += "_"
    # One key for the join and for repeated rows, so that rows are dealt out once.
    key = lambda digest, one: F.md5(F.concat(digest, F.coalesce(F.concat(F.lit("="), one.cast("string")), F.lit(""))).cast("binary"))
    kept = docs.withColumn(own, key(name, docs["doc_id"])).join(winners.select(key(F.col("__digest"), F.col("__id")).alias(own)), own, "left_semi")
    return kept.dropDuplicates([own]).select(*[F.col(f"`{c}`") for c in docs.columns])
