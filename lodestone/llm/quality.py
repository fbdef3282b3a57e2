"""Quality rules and a logistic regression over hashed word and character n-grams.

One pass over Arrow batches computes the counts of the fixed rules and the
score of the classifier.  The classifier is fitted on the driver on at most
about ``SAMPLE_ROWS`` labelled rows, whose hashed features the executors
compute; a fifth of them is kept apart to calibrate its probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import NOT_SPACE, arrow_map, byte_class, mix, owner, pieces, prefix_hash, range_hash, runs, table
from .training import adam, labelled_sample, platt, sigmoid

SAMPLE_ROWS = 2000
#: Hashed features: the first half for characters, the second for words.
BITS = 17
STEPS = 120
#: Fixed thresholds.
LEAST_WORDS = 20
MOST_REPEATED = 30
LEAST_QUALITY = 0.5
WINDOW = 8

_SYMBOL = byte_class(lambda b: chr(b) in "#*$%&|<>")
_RESULT = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, quality double"


def _sum_by_doc(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[at[1:]] - total[at[:-1]]


def _duplicates(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs more than once."""
    order = np.argsort(keys)
    s = keys[order]
    same = s[1:] == s[:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def rule_counts(buf: np.ndarray, at: np.ndarray, lo: np.ndarray, doc: np.ndarray, h: np.ndarray, sums: np.ndarray) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each document."""
    n = len(at) - 1
    solid = NOT_SPACE[buf]
    n_words = np.bincount(doc, minlength=n)[:n]
    word_chars = _sum_by_doc(solid & ((buf & 0xC0) != 0x80), at)
    n_symbols = _sum_by_doc(_SYMBOL[buf], at)
    salt = mix(np.arange(n, dtype=np.uint64) + np.uint64(7))
    breaks = np.flatnonzero(buf == 10)
    a, b = np.sort(np.concatenate((at[:-1], breaks + 1))), np.sort(np.concatenate((breaks, at[1:])))
    filled = np.concatenate(([0], np.cumsum(solid, dtype=np.int64)))
    some = filled[b] > filled[a]
    a, b = a[some], b[some]
    whose = owner(at, a)
    lines = range_hash(sums, a, b) ^ salt[whose] if len(a) else np.zeros(0, np.uint64)
    _, first = np.unique(lines, return_index=True)
    n_dup_lines = np.bincount(whose, minlength=n)[:n] - np.bincount(whose[first], minlength=n)[:n]
    n_repeat = np.zeros(n, np.int64)
    if len(lo) >= WINDOW:
        views = len(lo) - WINDOW + 1
        key = np.zeros(views, np.uint64)
        for j in range(WINDOW):
            key = key * np.uint64(0x100000001B3) + h[j : j + views]
        inside = np.flatnonzero(doc[:views] == doc[WINDOW - 1 :])
        twice = inside[_duplicates(mix(key[inside]) ^ salt[doc[inside]])]
        mark = np.zeros(len(lo) + 1, np.int32)
        mark[twice] += 1
        mark[twice + WINDOW] -= 1
        n_repeat = np.bincount(doc[np.cumsum(mark[:-1]) > 0], minlength=n)[:n]
    return [n_words, word_chars, n_symbols, n_dup_lines, n_repeat]


def char_features(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 2- and 4-grams of bytes and their documents; n-grams don't cross documents."""
    n = len(buf)
    wide = buf.astype(np.uint32)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    out, own = [], []
    for size, salt in ((2, 1), (4, 2)):
        if n >= size:
            gram = wide[: n - size + 1].copy()
            for j in range(1, size):
                gram |= wide[j : n - size + 1 + j] << np.uint32(8 * j)
            same = doc[: n - size + 1] == doc[size - 1 :]
            gram = ((gram + np.uint32(salt)) * np.uint32(2654435761)) >> np.uint32(32 - BITS)
            out.append(gram[same])
            own.append(doc[: n - size + 1][same])
    return (np.concatenate(out), np.concatenate(own)) if out else (np.zeros(0, np.uint32), np.zeros(0, np.int64))


def word_features(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words and pairs of words, numbered from 2**BITS on."""
    pair = mix(h[:-1] * np.uint64(31) + h[1:])
    same = doc[:-1] == doc[1:]
    both = np.concatenate((h, pair[same]))
    return ((both >> np.uint64(64 - BITS)) + np.uint64(1 << BITS)).astype(np.int64), np.concatenate((doc, doc[:-1][same]))


def _parts(buf: np.ndarray, at: np.ndarray):
    lo, hi = runs(NOT_SPACE[buf], at)
    sums = prefix_hash(buf)
    doc = owner(at, lo)
    return lo, doc, range_hash(sums, lo, hi), sums


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse features of labelled rows (doc_id, text, y): relative frequencies within characters and within words."""
    for rows, buf, at in pieces(batches):
        lo, doc, h, _ = _parts(buf, at)
        n = rows.num_rows
        ids, values = [[] for _ in range(n)], [[] for _ in range(n)]
        for feature, own in (char_features(buf, at), word_features(h, doc)):
            key, count = np.unique(own.astype(np.int64) << 32 | feature.astype(np.int64), return_counts=True)
            edge = np.searchsorted(key, np.arange(n + 1) << 32)
            for k in range(n):
                part = slice(edge[k], edge[k + 1])
                ids[k].append((key[part] & 0xFFFFFFFF).astype(np.int32))
                values[k].append((count[part] / max(1, count[part].sum())).astype(np.float32))
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array([np.concatenate(x).tobytes() for x in ids], pa.binary()), pa.array([np.concatenate(x).tobytes() for x in values], pa.binary())], names=["doc_id", "y", "ids", "vals"])


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, float, float]:
    """Weights, and slope and offset of the calibrated probability; all zero if one class has no rows."""
    weights = np.zeros(2 << BITS, np.float32)
    sample = labelled_sample(docs, labels, "quality", rows).select("doc_id", "text", "y")
    got = sorted(arrow_map(sample, _vectors, "doc_id bigint, y int, ids binary, vals binary").collect(), key=lambda r: (r["doc_id"], r["y"], r["ids"]))
    y = np.array([r["y"] for r in got], float)
    if not len(got) or y.min() == y.max():
        return weights, 0.0, 8.0 if not len(got) or y.min() == 1 else -8.0
    ids = [np.frombuffer(r["ids"], np.int32) for r in got]
    values = [np.frombuffer(r["vals"], np.float32) for r in got]
    apart = np.arange(len(got)) % 5 == 4
    own = np.repeat(np.arange(len(got)), [len(x) for x in ids])
    flat, value = np.concatenate(ids), np.concatenate(values)
    share = np.where(y == 1, 0.5 / max(1, (y[~apart] == 1).sum()), 0.5 / max(1, (y[~apart] == 0).sum())) * ~apart
    state: dict = {}
    bias = np.zeros(1, np.float32)
    for step in range(1, STEPS + 1):
        rest = (sigmoid(np.bincount(own, weights=value * weights[flat], minlength=len(got)) + bias) - y) * share
        grad = np.bincount(flat, weights=value * rest[own], minlength=len(weights)).astype(np.float32) + 1e-7 * weights
        adam(state, "w", weights, grad, 0.3, step)
        adam(state, "b", bias, np.array([rest.sum()], np.float32), 0.05, step)
    margin = np.bincount(own, weights=value * weights[flat], minlength=len(got)) + bias
    use = apart if len(np.unique(y[apart])) == 2 else np.ones(len(got), bool)
    slope, offset = platt(margin[use], y[use])
    return weights, slope, offset + slope * float(bias[0])


def judge(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, least: float = LEAST_QUALITY) -> DataFrame:
    """Rule counts, the classifier's calibrated probability and the verdict for every document.

    ``docs`` has doc_id and text, ``labels`` doc_id and quality.  A null or
    empty text has no words and fails the rules.  Without labels of both
    classes the classifier gives every document the known class.  Repeated
    rows are judged each; an empty table gives an empty result.
    """
    weights, slope, offset = fit(docs, labels, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, at in pieces(batches):
            n = rows.num_rows
            lo, doc, h, sums = _parts(buf, at)
            counts = rule_counts(buf, at, lo, doc, h, sums)
            n_words, n_repeat = counts[0], counts[4]
            failed = (n_words < LEAST_WORDS) | (100 * n_repeat > MOST_REPEATED * n_words)
            margin = np.zeros(n)
            for feature, own in (char_features(buf, at), word_features(h, doc)):
                margin += np.bincount(own, weights=weights[feature], minlength=n)[:n] / np.maximum(1, np.bincount(own, minlength=n)[:n])
            quality = sigmoid(slope * margin + offset)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), *(pa.array(c.astype(np.int64)) for c in counts), pa.array(failed), pa.array(~failed & (quality >= least)), pa.array(quality)],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"],
            )

    return arrow_map(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), run, _RESULT)


def query(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("quality")
