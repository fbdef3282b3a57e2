"""Toxicity by a convolutional text classifier, trained in numpy.

A word's vector is the sum of two rows of a hashed table: that of the word
and that of its first bytes, which words of one stem share.  Filters of
several widths run over the words, each keeps its largest value in the text,
and a logistic layer weighs these.  Only the words where a filter has its
maximum pass gradients back, so training touches few rows of the table.

Every labelled row that is not held out is used.  A quarter of them, by a hash
of the id, is kept apart to set the threshold of each language; the network
learns from all others, both classes weighing the same.  They are dealt into
shards of about ``SHARD_ROWS`` rows by a hash of the id.  In each epoch every
shard is gone through by a task that starts from the common network; what the
shards changed is then averaged, a row of the table over the shards that
touched it.  Sums are taken in whole numbers, so no order of tasks matters.

The language of a text is read off the text, by a model of all rows that are
not held out.  Scores are shifted so that every threshold is 0.5.  They are
computed exactly, so that a text's score never depends on its neighbours.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import langid
from .common import WORD_BYTE, Tables, arrow_map, cleaned, lower_ascii, mix, owner, pieces, prefix_hash, range_hash, runs, table
from .langid import Model, _words, held_out
from .training import adam, sigmoid

#: Rows that a task learns from between two averages, as expected; a measure of the shards' size, all rows are used.
SHARD_ROWS = 5000
BITS = 17
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
#: Bytes at the begin of a word that make its stem.
STEM = 4
EPOCHS = 14
#: Share of words left out at random while training, so that no single word carries a text.
DROPPED = 0.4
BATCH = 64
#: Rows of one language needed for a threshold of its own.
LEAST_ROWS = 60
#: Thresholds are told apart to one part in so many of a margin's unit.
GRID = 1024
#: Words that a task holds for training (8 bytes each), unless one document has more.
MOST_WORDS = 1 << 22
#: Most bits, as a power of two, that tell which texts may have a label; beyond, more of the others pass and go later.
MOST_BITS = 27
#: Words whose windows are evaluated at a time.
BLOCK = 1 << 16
#: Fixed point of sums over shards, and of the finished network.
SCALE, FINE = 1 << 34, 1 << 16

_RESULT = "doc_id bigint, held_out boolean, score double, predicted int"
_MOVES = ["slot", "weight", "seen", *(f"d{k}" for k in range(DIM))]


def word_slots(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, 2) table rows, and the words' documents."""
    low = lower_ascii(buf)
    lo, hi = runs(WORD_BYTE[low], at)
    sums = prefix_hash(low)
    shift = np.uint64(64 - BITS)
    word = range_hash(sums, lo, hi) >> shift
    stem = mix(range_hash(sums, lo, np.minimum(hi, lo + STEM)) + np.uint64(77)) >> shift
    return np.column_stack((word, stem)).astype(np.int32), owner(at, lo)


class Network:
    """Table of word vectors, filters of each width, and the logistic layer."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.words = rng.normal(0, 0.05, (1 << BITS, DIM)).astype(np.float32)
        self.filters = {w: rng.normal(0, (2 / (w * DIM)) ** 0.5, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.shifts = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.bias = np.zeros(1, np.float32)
        self.seen = np.full(len(self.words), 1e-4, np.float32)  # squared gradients of table rows
        self.state = {name: (np.zeros_like(value), np.zeros_like(value)) for name, value in self._layers().items()}
        self.step = 0

    def _layers(self) -> dict[str, np.ndarray]:
        return {f"f{w}": self.filters[w] for w in WIDTHS} | {f"s{w}": self.shifts[w] for w in WIDTHS} | {"o": self.out, "b": self.bias}

    def pooled(self, slots: np.ndarray, doc: np.ndarray, n: int, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """(n, filters) largest activations, zero where no window fits, and their places if asked for."""
        kind = np.float32 if places else np.float64
        top = np.zeros((n, len(WIDTHS) * FILTERS), kind)
        where = np.full(top.shape, -1, np.int64) if places else None
        if not len(slots):
            return top, where
        x = self.words[slots[:, 0]].astype(kind, copy=False) + self.words[slots[:, 1]]
        count = np.bincount(doc, minlength=n)[:n]
        begin = np.cumsum(count) - count
        for k, w in enumerate(WIDTHS):
            views = len(x) - w + 1
            if views < 1:
                continue
            z = self.shifts[w] + sum(x[j : j + views] @ self.filters[w][j * DIM : (j + 1) * DIM] for j in range(w))
            z[doc[:views] != doc[w - 1 :]] = 0
            np.maximum(z, 0, out=z)
            has = np.flatnonzero(count >= w)
            if not len(has):
                continue
            best = np.maximum.reduceat(z, begin[has], axis=0) if len(has) == n or has[-1] == n - 1 else np.maximum.reduceat(z, np.minimum(begin[has], views - 1), axis=0)
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            top[has, cols] = best
            if places:
                full = np.full((n, FILTERS), np.inf, np.float32)
                full[has] = best
                for f in range(FILTERS):
                    hit = np.flatnonzero((z[:, f] == full[doc[:views], f]) & (z[:, f] > 0))
                    where[doc[hit][::-1], k * FILTERS + f] = hit[::-1]
        return top, where

    def margin(self, slots: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """Margin of each of ``n`` documents; after ``settle`` the same whatever stands beside it."""
        top = np.zeros((n, len(WIDTHS) * FILTERS))
        for at in range(0, len(slots), BLOCK):
            part = slice(at, at + BLOCK + max(WIDTHS) - 1)  # a window in two blocks does no harm to a maximum
            first, last = int(doc[part][0]), int(doc[part][-1]) + 1
            np.maximum(top[first:last], self.pooled(slots[part], doc[part] - first, last - first)[0], out=top[first:last])
        margin = np.full(n, float(self.bias[0]))
        for k, own in enumerate(self.out):
            margin += top[:, k] * float(own)
        return margin

    def settle(self) -> None:
        """End training.  Values become multiples of 1 / FINE within 64, whose sums of products are exact in any order."""
        for value in (self.words, *self._layers().values()):
            np.clip(np.rint(value * FINE) / FINE, -64, 64, out=value)
        self.seen, self.state = np.zeros(0, np.float32), {}

    def epoch(self, texts: list[np.ndarray], y: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> int:
        """Learn once from each text; the number of steps."""
        begin = self.step
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), BATCH):
            own = order[lo : lo + BATCH]
            self.step += 1
            slots = np.concatenate([texts[k] for k in own])
            doc = np.repeat(np.arange(len(own)), [len(texts[k]) for k in own])
            left = rng.random(len(slots)) >= DROPPED
            slots, doc = slots[left], doc[left]
            top, where = self.pooled(slots, doc, len(own), places=True)
            rest = ((sigmoid(top @ self.out + self.bias[0]) - y[own]) * weight[own]).astype(np.float32) / len(own)
            back = rest[:, None] * self.out[None, :]
            rows, grads = [], []
            moves = {}
            for k, w in enumerate(WIDTHS):
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                d, f = np.nonzero(where[:, cols] >= 0)
                place, g = where[:, cols][d, f], back[:, cols][d, f]
                moves["f", w], moves["s", w] = np.zeros_like(self.filters[w]), np.bincount(f, weights=g, minlength=FILTERS).astype(np.float32)
                for j in range(w):
                    pair = slots[place + j] if len(place) else np.zeros((0, 2), np.int32)
                    x = self.words[pair[:, 0]] + self.words[pair[:, 1]]
                    np.add.at(moves["f", w].reshape(w, DIM, FILTERS)[j].T, f, g[:, None] * x)
                    into = g[:, None] * self.filters[w][j * DIM : (j + 1) * DIM].T[f]
                    rows += [pair[:, 0], pair[:, 1]]
                    grads += [into, into]
            row, inverse = np.unique(np.concatenate(rows), return_inverse=True)
            total = np.zeros((len(row), DIM), np.float32)
            np.add.at(total, inverse, np.concatenate(grads))
            self.seen[row] += (total * total).mean(axis=1)
            self.words[row] -= 0.15 * total / np.sqrt(self.seen[row])[:, None]
            for w in WIDTHS:
                adam(self.state, f"f{w}", self.filters[w], moves["f", w], 0.004, self.step)
                adam(self.state, f"s{w}", self.shifts[w], moves["s", w], 0.004, self.step)
            adam(self.state, "o", self.out, top.T @ rest + 1e-4 * self.out, 0.01, self.step)
            adam(self.state, "b", self.bias, np.array([rest.sum()], np.float32), 0.01, self.step)
        return self.step - begin

    def _dense(self) -> np.ndarray:
        """Layers and the moments of their gradients, in rows of DIM."""
        flat = np.concatenate([x.ravel() for name, value in self._layers().items() for x in (value, self.state[name][0], np.sqrt(self.state[name][1]))]).astype(np.float64)
        return np.pad(flat, (0, -len(flat) % DIM)).reshape(-1, DIM)

    def moves(self, since: Network, steps: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows that changed since, and what each adds to the columns of ``_MOVES`` after the first; negative rows are those of ``_dense``."""
        row = np.flatnonzero((self.words != since.words).any(axis=1) | (self.seen != since.seen))
        dense = self._dense() - since._dense()
        change = np.concatenate((np.column_stack((self.seen[row].astype(np.float64) - since.seen[row], self.words[row].astype(np.float64) - since.words[row])), np.column_stack((np.full(len(dense), 1 / steps), dense))))
        return np.concatenate((row, -1 - np.arange(len(dense)))), np.column_stack((np.full(len(change), steps), np.rint(change * (steps * SCALE)).astype(np.int64)))

    def merge(self, moves: pa.Table) -> None:
        """Add the averages of what the shards changed."""
        slot = moves["slot"].to_numpy()
        sums = np.column_stack([moves[c].to_numpy() for c in _MOVES[1:]])
        mean = sums[:, 1:] / (sums[:, :1] * float(SCALE))
        mine = slot >= 0
        self.seen[slot[mine]] += mean[mine, 0].astype(np.float32)
        self.words[slot[mine]] += mean[mine, 1:].astype(np.float32)
        dense = self._dense()
        dense[-1 - slot[~mine]] += mean[~mine, 1:]
        flat, at = dense.ravel(), 0
        for name, value in self._layers().items():
            for k, x in enumerate((value, *self.state[name])):
                part = flat[at : at + x.size].reshape(x.shape)
                x[...] = part if k < 2 else np.square(part)
                at += x.size
        self.step += round(1 / float(mean[~mine, 0][0]))  # steps of a shard


def threshold(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Margin from which on the weighted F1 of class 1 is highest, in the middle of its gap."""
    order = np.argsort(-margin)
    m, w = margin[order], weight[order]
    good = np.cumsum(w * (y[order] == 1))
    f1 = 2 * good / (np.cumsum(w) + max(good[-1], 1e-9))
    f1[:-1][m[:-1] == m[1:]] = -1
    k = int(f1.argmax())
    return float(m[k] if k + 1 == len(m) else (m[k] + m[k + 1]) / 2)


class Detector:
    """Network, language model and thresholds; ``None`` network: no labels of both classes."""

    def __init__(self, network: Network | None, languages: Model, limits: dict[int, float], common: float):
        self.network, self.languages, self.limits, self.common = network, languages, limits, common

    def scores(self, rows: pa.RecordBatch, index: int) -> np.ndarray:
        """Score of every row of a batch, from its text alone."""
        out = []
        if self.network is None:
            return np.zeros(rows.num_rows)
        limits = np.array([self.limits.get(k, self.common) for k in range(len(self.languages.languages))] + [self.common])
        for part, gram, lo, hi, doc, _ in _words(rows, index):
            n = part.num_rows
            best = self.languages.best(gram, lo, hi, doc, n)
            for _, buf, at in pieces(iter([pa.RecordBatch.from_arrays([part.column(index)], names=["text"])]), most=1 << 40):
                slots, own = word_slots(buf, at)
                out.append(sigmoid(self.network.margin(slots, own, n) - limits[best]))
        return np.concatenate(out) if out else np.zeros(0)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[np.ndarray], np.ndarray]]:
    """(shard and part, texts, labels) from rows (shard, y, slots) in order of their shards."""
    key, texts, y, words = [-1, 0], [], [], 0
    for batch in batches:
        for shard, label, slots in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if texts and (shard != key[0] or words + len(slots) // 8 > MOST_WORDS):
                yield key, texts, np.array(y, np.float32)
                key, texts, y, words = [key[0], key[1] + 1], [], [], 0
            if shard != key[0]:
                key = [shard, 0]
            texts.append(np.frombuffer(slots, np.int32).reshape(-1, 2))
            y.append(label)
            words += len(slots) // 8
    if texts:
        yield key, texts, np.array(y, np.float32)


def _epoch(rows: DataFrame, net: Network, number: int, share: dict[int, float], seed: int = 5) -> pa.Table:
    """What an epoch over all shards of ``rows`` (shard, y, slots) changes, summed; ``share``: weight of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for key, texts, y in _shards(batches):
            own = copy.deepcopy(net)
            steps = own.epoch(texts, y, np.where(y == 1, share[1], share[0]), np.random.default_rng([seed, number, *key]))
            row, change = own.moves(net, steps)
            if total is None:
                dense = int(-row.min())
                total = np.zeros((dense + len(net.words), change.shape[1]), np.int64)
            total[row + dense] += change
        if total is not None:
            some = np.flatnonzero(total[:, 0])
            for lo in range(0, len(some), 1 << 14):
                part = some[lo : lo + (1 << 14)]
                yield pa.RecordBatch.from_arrays([pa.array((part - dense).astype(np.int32)), *(pa.array(total[part, k]) for k in range(total.shape[1]))], names=_MOVES)

    moves = arrow_map(rows, run, ", ".join(f"{c} {'int' if c == 'slot' else 'bigint'}" for c in _MOVES))
    with cleaned(rows.sparkSession):
        return moves.groupBy("slot").agg(*[F.sum(c).alias(c) for c in _MOVES[1:]]).toArrow()


def _limits(rows: DataFrame, net: Network, languages: int) -> tuple[dict[int, float], float]:
    """Threshold of each language with enough rows (lang, y, slots), and that of all together, from counts of all margins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [np.frombuffer(x, np.int32).reshape(-1, 2) for x in batch.column(2).to_pylist()]
            if texts:
                margin = net.margin(np.concatenate(texts), np.repeat(np.arange(len(texts)), [len(t) for t in texts]), len(texts))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.rint(np.clip(margin, -30, 30) * GRID).astype(np.int32))], names=["lang", "y", "place"])

    with cleaned(rows.sparkSession):
        got = arrow_map(rows, run, "lang int, y int, place int").groupBy("lang", "y", "place").count().orderBy("lang", "y", "place").toArrow()
    lang, y, place, count = (got[c].to_numpy() for c in ("lang", "y", "place", "count"))
    limits = {}
    for k in range(languages):
        mine = lang == k
        if count[mine].sum() >= LEAST_ROWS and len(set(y[mine].tolist())) == 2:
            limits[k] = threshold(place[mine] / GRID, y[mine], count[mine])
    return limits, threshold(place / GRID, y, count)


def _maybe_labelled(known: DataFrame) -> np.ndarray:
    """Bitmap of the hashed ids of ``known``, by a size that is a power of two: texts without a bit need not be dealt out."""
    bits = 1 << min(MOST_BITS, max(10, (16 * known.count()).bit_length()))
    place = known.select(_place(bits).alias("place")).selectExpr("cast(place >> 6 AS int) AS word", "shiftleft(1L, cast(place & 63 AS int)) AS bit")
    with cleaned(known.sparkSession):
        got = place.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits >> 6, np.int64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy()
    return out


def _place(bits: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("label"), "doc_id"), F.lit(bits))


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents (doc_id, y, ...) with the label of the row without a document before them; those of unlabelled ids and the labels' own rows go."""
    last_id, last_y = -1, -1
    for batch in batches:
        if not batch.num_rows:
            continue
        doc, y = batch.column(0).to_numpy(), batch.column(1).fill_null(-1).to_numpy()
        at = np.maximum.accumulate(np.where(y >= 0, np.arange(len(y)), -1))
        whose, label = np.where(at >= 0, doc[at], last_id), np.where(at >= 0, y[at], last_y)
        last_id, last_y = int(whose[-1]), int(label[-1])
        keep = (y < 0) & (label >= 0) & (whose == doc)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(label.astype(np.int32)), *batch.columns[2:]], names=batch.schema.names).filter(pa.array(keep))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SHARD_ROWS) -> Detector:
    """Detector learned from all labelled documents that are not held out, in shards of about ``rows``."""
    seen = ~held_out(modulus=5, rest=0)
    model = langid.fit(docs.where(seen & F.col("doc_id").isNotNull()), rows=None) if "lang" in docs.columns else Model([], np.zeros((0, 1 << langid.BITS)))
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)").where(seen)
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"))
    some = _maybe_labelled(known)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column(2).to_numpy()
            for part, gram, lo, hi, doc, _ in _words(batch.filter(pa.array(some[place >> 6] >> (place & 63) & 1 == 1)), 1):
                n = part.num_rows
                best = model.best(gram, lo, hi, doc, n)
                for _, buf, at in pieces(iter([pa.RecordBatch.from_arrays([part.column(1)], names=["text"])]), most=1 << 40):
                    slots, own = word_slots(buf, at)
                    cut = np.searchsorted(own, np.arange(n + 1))
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.nulls(n, pa.int32()), pa.array(best.astype(np.int32)), pa.array([slots[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["doc_id", "y", "lang", "slots"])

    # Labels meet their texts in the shards: only what may be labelled is shuffled, once, and as slots.
    schema = "doc_id bigint, y int, lang int, slots binary"
    shards = max(1, round(ids.join(known, "doc_id").count() * 3 / 4 / rows))
    made = arrow_map(texts.withColumn("place", _place(64 * len(some))), run, schema).union(known.select("doc_id", "y", F.lit(None).cast("int"), F.lit(None).cast("binary")))
    made = made.withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "doc_id"), F.lit(shards)).cast("int"))
    made = made.repartitionById(shards, "shard").sortWithinPartitions("shard", "doc_id", F.col("y").isNull(), "slots")
    made = arrow_map(made, _labelled, f"{schema}, shard int").withColumn("apart", F.pmod(F.xxhash64(F.lit("apart"), "doc_id"), F.lit(4)) == 3)
    tables = Tables(docs.sparkSession)
    made = tables.stored(made, "toxic")
    sizes = {(r["apart"], r["y"]): r["count"] for r in made.groupBy("apart", "y").count().collect()}
    if len({y for _, y in sizes}) < 2:
        tables.drop("toxic")
        return Detector(None, model, {}, 0.0)
    split = len(sizes) == 4  # both parts have both classes
    learn, judge = (made.where("NOT apart"), made.where("apart")) if split else (made, made)
    n = {c: sum(k for (apart, y), k in sizes.items() if y == c and not (split and apart)) for c in (0, 1)}
    net = Network()
    for k in range(EPOCHS):
        net.merge(_epoch(learn.select("shard", "y", "slots"), net, k, {c: sum(n.values()) / 2 / n[c] for c in n}))
    net.settle()
    limits = _limits(judge.select("lang", "y", "slots"), net, len(model.languages))
    tables.drop("toxic")
    return Detector(net, model, *limits)


def detect(docs: DataFrame, labels: DataFrame, rows: int = SHARD_ROWS) -> DataFrame:
    """Toxicity of every document: doc_id, held_out, score (0 to 1) and predicted (score of 0.5 or more).

    ``docs`` has doc_id, text and lang, ``labels`` doc_id and toxic; only rows
    not held out teach, and all of them do, ``rows`` in a shard.  Null and empty texts get the score of a text without
    words.  Without labels of both classes every score is 0.  Repeated rows
    are scored each; an empty table gives an empty result.
    """
    detector = fit(docs, labels, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = detector.scores(batch, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return arrow_map(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(modulus=5, rest=0).alias("held_out"), F.col("text").cast("string").alias("text")), run, _RESULT)


def query(spark, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
