"""Language identification by mixture inference.

Every word of a document is drawn from one of its languages; a language gives
a word the likelihood of its hashed character n-grams.  Expectation-
maximisation estimates the document's language proportions, starting from all
learned languages, and languages are dropped from the set as long as the
penalised likelihood (Bayesian information criterion) does not fall.

The n-gram counts are gathered by Spark from a bounded sample of labelled
rows: at most about ``SAMPLE_ROWS`` rows of each language, taken by a hash of
the document's id.  Every language is learned, ``BLOCK`` of them at a time;
more than ``MOST_LANGUAGES`` are an error, none is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import arrow_map, byte_class, owner, pieces, runs, stored, table

#: Expected bound on the labelled rows of one language that the model is fitted on.
SAMPLE_ROWS = 1500
#: Most languages whose table (256 kB each) is held at once; more are refused.
MOST_LANGUAGES = 1024
#: Languages whose counts are brought to the driver at a time.
BLOCK = 64
#: Likelihoods (words times languages) held at a time, unless one document has more.
CELLS = 1 << 24
BITS = 16
#: Weight of a uniform prior, in counts.
ALPHA = 0.1
STEPS = 6
TRIAL_STEPS = 2
#: Likelihood of one word is tempered, as its n-grams overlap.
TEMPER = 0.5
UNKNOWN = "und"
#: Score below which the filter rejects a document.
LEAST_SCORE = 0.35

_LETTER = byte_class(lambda b: b >= 0x80 or 0x61 <= b <= 0x7A)
_RESULT = "doc_id bigint, held_out boolean, lang_pred string, score double, languages array<string>, shares array<double>"


def _words(batch: pa.RecordBatch, index: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, n-gram numbers, begin and end of every word, its document, documents with a letter)."""
    text = batch.column(index)
    low = pc.utf8_lower(text)
    letters = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    done = 0
    for rows, buf, at in pieces(iter([pa.RecordBatch.from_arrays([low], names=["text"])])):
        n = rows.num_rows
        # Blanks after every document keep n-grams from reaching into the next.
        place = np.arange(1, len(buf) + 1) + 4 * np.repeat(np.arange(n), np.diff(at))
        at = at + 4 * np.arange(n + 1)
        kind = np.zeros(int(at[-1]) + 5, bool)
        kind[place] = _LETTER[buf]
        flat = np.full(len(kind), 32, np.uint32)
        flat[place] = np.where(_LETTER[buf], buf, 32)
        lo, hi = runs(kind[1 : int(at[-1]) + 1], at)
        gram = flat[:-3] | flat[1:-2] << np.uint32(8) | flat[2:-1] << np.uint32(16) | flat[3:] << np.uint32(24)
        gram = (gram * np.uint32(2654435761)) >> np.uint32(32 - BITS)
        # flat is shifted by one: a word's n-grams begin from one byte before it to its last byte but one
        yield batch.slice(done, n), gram, lo, hi, owner(at, lo), letters[done : done + n]
        done += n


def _by_word(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Sums of per-position values over each word."""
    edges = np.empty(2 * len(lo), np.int64)
    edges[::2], edges[1::2] = lo, hi
    return np.add.reduceat(values, edges)[::2] if len(lo) else np.zeros(0, values.dtype)


class Model:
    """Log-likelihoods of hashed n-grams by language: ``table`` is (languages, 2**BITS)."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        total = counts.sum(axis=1, keepdims=True)
        self.table = np.log((counts + ALPHA) / (total + ALPHA * counts.shape[1])).astype(np.float32)

    def proportions(self, gram: np.ndarray, lo: np.ndarray, hi: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """(n, languages): each document's language proportions, zero outside its selected set."""
        size = len(self.languages)
        if len(lo) * size > CELLS and n > 1:
            k, half = int(np.searchsorted(doc, n // 2)), n // 2
            parts = ((lo[:k], hi[:k], doc[:k], half), (lo[k:], hi[k:], doc[k:] - half, n - half))
            return np.concatenate([self.proportions(gram[a[0] : b[-1] + 1], a - a[0], b - a[0], d, m) if len(a) else np.zeros((m, size)) for a, b, d, m in parts])
        count = np.bincount(doc, minlength=n)
        has = np.flatnonzero(count)
        out = np.zeros((n, size))
        if not len(has) or not size:
            return out
        log = np.stack([_by_word(row[gram], lo, hi) for row in self.table], axis=1) * np.float32(TEMPER)
        top = log.max(axis=1, keepdims=True)
        like = np.exp(log - top)
        number = np.zeros(n, np.int64)
        number[has] = np.arange(len(has))
        own, begin, words = number[doc], np.cumsum(count[has]) - count[has], count[has][:, None]

        def steps(pi: np.ndarray, times: int, rows: np.ndarray, own: np.ndarray, like: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            for _ in range(times):
                part = pi[own] * like
                whole = part.sum(axis=1, keepdims=True)
                part /= np.maximum(whole, 1e-30)
                pi = np.add.reduceat(part, begin, axis=0) / words[rows]
            whole = np.maximum((pi[own] * like).sum(axis=1), 1e-30)
            return pi, np.add.reduceat(np.log(whole), begin)

        every = np.arange(len(has))
        pi, best = steps(np.full((len(has), size), 1 / size, np.float32), STEPS, every, own, like, begin)
        cost = 0.5 * np.log(words[:, 0] + 1)
        live = every
        for _ in range(size - 1):  # drop the smallest share while the penalised likelihood does not fall
            live = live[(pi[live] > 0).sum(axis=1) > 1]
            if not len(live):
                break
            share = np.where(pi[live] > 0, pi[live], np.inf)
            trial = pi[live].copy()
            trial[np.arange(len(live)), size - 1 - share[:, ::-1].argmin(axis=1)] = 0  # the last of equal ones
            trial /= trial.sum(axis=1, keepdims=True)
            mine = np.zeros(len(has), bool)
            mine[live] = True
            pick = mine[own]
            place = np.cumsum(mine) - 1
            w = words[live, 0]
            trial, ll = steps(trial, TRIAL_STEPS, live, place[own[pick]], like[pick], np.cumsum(w) - w)
            good = ll + cost[live] >= best[live]
            pi[live[good]], best[live[good]] = trial[good], ll[good]
            live = live[good]
        out[has] = pi
        return out

    def best(self, gram: np.ndarray, lo: np.ndarray, hi: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """Number of the single most likely language of each document; -1 without words."""
        if not self.languages:
            return np.full(n, -1)
        total = np.stack([np.bincount(doc, weights=_by_word(row[gram], lo, hi), minlength=n)[:n] for row in self.table], axis=1)
        return np.where(np.bincount(doc, minlength=n)[:n] > 0, total.argmax(axis=1), -1)


def held_out(key: str = "doc_id", modulus: int = 4, rest: int = 2) -> Column:
    """Whether crc32 of the id's text leaves ``rest``; false for a null id."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % modulus == rest, F.lit(False))


def fit(labelled: DataFrame, rows: int | None = SAMPLE_ROWS, most: int = MOST_LANGUAGES) -> Model:
    """Model of all languages of (doc_id, text, lang); rows with a null text or lang teach nothing.

    ``rows``: expected bound on the rows of one language; ``None`` takes all.
    More than ``most`` languages are a ValueError.
    """
    known = labelled.where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = known.groupBy("lang").count().limit(most + 1).collect()
    if len(sizes) > most:
        raise ValueError(f"more than {most} languages: their tables would not fit in memory, and none is left out")
    languages = sorted(r["lang"] for r in sizes)
    if not languages:
        return Model([], np.zeros((0, 1 << BITS)))
    sample = known.select("text", "lang", "doc_id")
    if rows is not None:
        rate = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, rows / r["count"]))])
        sample = sample.where(F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1_000_000)) < rate[F.col("lang")] * 1_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def counted() -> Iterator[pa.RecordBatch]:
            for name, count in held.items():
                seen = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(seen), pa.string()), pa.array(seen, pa.int32()), pa.array(count[seen], pa.int64())], names=["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            for rows, gram, lo, hi, doc, _ in _words(batch, 0):
                names, number = np.unique(np.array(rows.column(1).to_pylist(), object), return_inverse=True)
                lang = number[doc]
                for k, name in enumerate(names):
                    mine = lang == k
                    a, size = lo[mine], hi[mine] - lo[mine]
                    index = np.repeat(a - np.cumsum(size) + size, size) + np.arange(size.sum())
                    if name not in held and len(held) == BLOCK:
                        yield from counted()
                    held[name] = held.get(name, 0) + np.bincount(gram[index], minlength=1 << BITS)
        yield from counted()

    counts = arrow_map(sample, run, "lang string, gram int, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    blocks = [languages[k : k + BLOCK] for k in range(0, len(languages), BLOCK)]
    if len(blocks) > 1:
        counts = stored(counts, "langid")
    model = Model(languages, np.zeros((0, 1 << BITS)))
    tables = []
    for block in blocks:
        seen = (counts.where(F.col("lang").isin(block)) if len(blocks) > 1 else counts).toPandas()
        number = {name: k for k, name in enumerate(block)}
        matrix = np.zeros((len(block), 1 << BITS))
        matrix[seen["lang"].map(number).to_numpy(int), seen["gram"].to_numpy(int)] = seen["n"].to_numpy(float)
        tables.append(Model(block, matrix).table)
    model.table = np.concatenate(tables)
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Language of every row of ``docs`` (doc_id, held_out, text): lang_pred, score (its share), and the selected set with shares.

    ``und`` with score 0 for null texts, texts without a letter, and if nothing was learned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, gram, lo, hi, doc, letters in _words(batch, 2):
                names, scores, sets, shares = _verdicts(model, model.proportions(gram, lo, hi, doc, rows.num_rows), letters)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))], names=["doc_id", "held_out", "lang_pred", "score", "languages", "shares"])

    return arrow_map(docs, run, _RESULT)


def _verdicts(model: Model, pi: np.ndarray, letters: np.ndarray) -> tuple[list, list, list, list]:
    if not model.languages:
        n = len(pi)
        return [UNKNOWN] * n, [0.0] * n, [[]] * n, [[]] * n
    ok = letters & (pi.sum(axis=1) > 0)
    order = np.argsort(-pi, axis=1, kind="stable")
    names = [model.languages[o[0]] if g else UNKNOWN for o, g in zip(order, ok, strict=True)]
    scores = np.where(ok, np.minimum(pi.max(axis=1), 1), 0.0)
    sets = [[model.languages[j] for j in o if p[j] > 0] if g else [] for o, p, g in zip(order, pi, ok, strict=True)]
    shares = [[float(p[j]) for j in o if p[j] > 0] if g else [] for o, p, g in zip(order, pi, ok, strict=True)]
    return names, scores.tolist(), sets, shares


def identify(docs: DataFrame) -> DataFrame:
    """Language of every document of ``docs`` (doc_id, text, lang), learned from rows that are not held out.

    Returns doc_id, held_out, lang_pred, score, languages and shares, one row
    for each row of ``docs``.  ``lang`` is read for the rows learned from only.
    Null texts and texts without a letter are ``und``; texts of any length are
    read whole; of languages with equal shares the first by name is predicted.
    Repeated rows are judged each; an empty table gives an empty result; other
    columns, whatever their names, are not read.
    """
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = fit(base.where("NOT held_out AND doc_id IS NOT NULL"))
    return predict(base.select("doc_id", "held_out", "text"), model)


def keep_identified(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """Rows of ``docs`` whose language is found with a share of ``least`` or more; all columns stay as they are, and an empty table stays empty."""
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = fit(base.where("NOT held_out AND doc_id IS NOT NULL"))
    at, schema = docs.columns.index("text"), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, gram, lo, hi, doc, letters in _words(batch, at):
                pi = model.proportions(gram, lo, hi, doc, rows.num_rows)
                names, scores, _, _ = _verdicts(model, pi, letters)
                yield rows.filter(pa.array([n != UNKNOWN and s >= least for n, s in zip(names, scores, strict=True)], pa.bool_()))

    return arrow_map(docs, run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")
