"""Quality, language and toxicity: counts against brute force, verdicts on held-out rows, hard inputs."""

import collections
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import langid, quality, toxicity

SF = "/root/testdata/sf0.01"
ODD = [(9001, None, None), (9002, "", "en"), (9003, " \n\t\n ", "en"), (9004, "!!! 123 ###", "en"), (9005, "the " * 9000, None), (None, "the cat", "en"), (9006, "x", "en"), (9006, "x", "en")]


@pytest.fixture(scope="module")
def docs(spark):
    odd = spark.createDataFrame(ODD, "doc_id long, text string, lang string")
    real = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    return real.unionByName(odd).withColumn("y", F.lit("clash")).withColumn("held_out", F.lit(3))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def brute_counts(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    times = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if times[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [s for s in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def test_quality(spark, docs, labels):
    got = quality.judge(docs, labels).collect()
    texts = collections.defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        texts[r["doc_id"]].append(brute_counts(r["text"]))
    assert len(got) == sum(map(len, texts.values()))
    for r in got:
        n = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert n in texts[r["doc_id"]]
        assert r["base_failed"] == (n[0] < 20 or 100 * n[4] > 30 * n[0])
        assert not (r["kept"] and r["base_failed"]) and 0 <= r["quality"] <= 1
    y = {r["doc_id"]: r["quality"] for r in labels.collect()}
    judged = [(y[r["doc_id"]], r["kept"], r["base_failed"]) for r in got if r["doc_id"] in y]
    good = [k for v, k, b in judged if v == 1 and not b]
    bad = [k for v, k, _ in judged if v == 0]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.1


def test_quality_without_rows_or_labels(spark, docs, labels):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert quality.judge(none, labels).count() == 0
    alone = quality.judge(docs.limit(20), spark.createDataFrame([], "doc_id long, quality int"))
    assert alone.count() == 20


def test_language(spark, docs):
    got = langid.identify(docs).collect()
    assert len(got) == docs.count()
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    told = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 9000]
    assert len(told) > 150 and sum(r["lang_pred"] == lang[r["doc_id"]] for r in told) / len(told) > 0.98
    by = {r["doc_id"]: r for r in got}
    assert all(by[d]["lang_pred"] == "und" and by[d]["score"] == 0 for d in (9001, 9002, 9003, 9004))
    assert by[9005]["lang_pred"] == "en" and by[None]["held_out"] is False
    assert all(0 <= r["score"] <= 1 for r in got)
    want = {r["doc_id"]: r["h"] for r in docs.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("h")).collect() if r["doc_id"] is not None}
    assert all(r["held_out"] == want[r["doc_id"]] for r in got if r["doc_id"] is not None)


def brute_proportions(model, text):
    """One document's language shares, word by word, in plain Python."""
    flat = re.sub(rb"[^a-z\x80-\xff]", b" ", text.lower().encode())
    like = []
    for w in re.finditer(rb"[^ ]+", flat):
        numbers = [(int.from_bytes((b" " + flat + b"    ")[i : i + 4], "little") * 2654435761 % (1 << 32)) >> (32 - langid.BITS) for i in range(w.start(), w.end())]
        log = [sum(float(row[k]) for k in numbers) * langid.TEMPER for row in model.table]
        like.append([np.exp(x - max(log)) for x in log])
    size = len(model.languages)

    def steps(pi, times):
        for _ in range(times):
            new = [0.0] * size
            for x in like:
                whole = sum(p * y for p, y in zip(pi, x, strict=True))
                for j in range(size):
                    new[j] += pi[j] * x[j] / whole / len(like)
            pi = new
        return pi, sum(np.log(sum(p * y for p, y in zip(pi, x, strict=True))) for x in like)

    pi, best = steps([1 / size] * size, langid.STEPS)
    while sum(p > 0 for p in pi) > 1:
        least = -min((p, -j) for j, p in enumerate(pi) if p > 0)[1]
        trial = [0.0 if j == least else p for j, p in enumerate(pi)]
        trial, ll = steps([p / sum(trial) for p in trial], langid.TRIAL_STEPS)
        if ll + 0.5 * np.log(len(like) + 1) < best:
            break
        pi, best = trial, ll
    return pi


def test_language_against_brute_force(spark, docs):
    model = langid.fit(docs.where("lang IS NOT NULL AND doc_id IS NOT NULL"))
    texts = [r["text"] for r in docs.where("length(text) BETWEEN 100 AND 700 AND doc_id < 9000").orderBy("doc_id").limit(25).collect()]
    texts += [texts[0][:300] + " " + texts[3][:300], "über straße", "the"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    (_, gram, lo, hi, doc, _), *_ = langid._words(batch, 0)
    got = model.proportions(gram, lo, hi, doc, len(texts))
    for t, row in zip(texts, got, strict=True):
        assert np.allclose(row, brute_proportions(model, t), atol=2e-3), t


def test_language_of_ties_and_long_texts(spark):
    rows = [(1, "zug zug zug", "b"), (2, "zug zug zug", "a"), (3, "mond " * 300_000, "c")]
    got = {r["doc_id"]: r for r in langid.predict(spark.createDataFrame([(d, False, t) for d, t, _ in rows], "doc_id long, held_out boolean, text string"), langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))).collect()}
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == "a" and got[3]["lang_pred"] == "c"


def test_language_mixture(spark, docs):
    model = langid.fit(docs.where("lang IS NOT NULL"))
    by = {r["lang"]: r["text"] for r in docs.where("length(text) BETWEEN 1500 AND 4000 AND doc_id < 9000").orderBy("doc_id").collect()}
    both = spark.createDataFrame([(1, False, by["en"][:1500] + " " + by["de"][:1500])], "doc_id long, held_out boolean, text string")
    row = langid.predict(both, model).first()
    assert set(row["languages"][:2]) == {"en", "de"} and min(row["shares"][:2]) > 0.25


def test_every_language_is_learned(spark, monkeypatch):
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = lambda i: " ".join((letters[i % 26] + letters[(i // 26 + 3 * j) % 26] + letters[i % 26]) * 2 for j in range(3)) + " "
    rows = [(i, words(i) * (5 if i < 64 else 3), f"l{i:02}") for i in range(70)] + [(100 + i, words(i) * 5, f"l{i:02}") for i in range(64)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == sorted(f"l{i:02}" for i in range(70)) and model.table.shape == (70, 1 << langid.BITS)
    batch = pa.RecordBatch.from_arrays([pa.array([words(i) * 4 for i in range(70)] + ["", "!"])], names=["text"])
    (_, gram, lo, hi, doc, _), *_ = langid._words(batch, 0)
    whole = model.proportions(gram, lo, hi, doc, 72)
    assert whole[:70].argmax(axis=1).tolist() == list(range(70)) and not whole[70:].any()
    monkeypatch.setattr(langid, "CELLS", 1000)
    assert np.allclose(model.proportions(gram, lo, hi, doc, 72), whole)
    with pytest.raises(ValueError, match="more than 3 languages"):
        langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most=3)


def test_language_without_training_rows(spark):
    got = langid.identify(spark.createDataFrame([(1, "words", None)], "doc_id long, text string, lang string")).first()
    assert (got["lang_pred"], got["score"]) == ("und", 0.0)
    assert langid.identify(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_language_filter_keeps_columns_and_clean_rows(spark, docs):
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns
    gone = {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in kept.collect()}
    assert gone == {9001, 9002, 9003, 9004}


def test_toxicity(spark, docs, labels):
    words = "stupid idiot moron".split()
    clean = [r["text"] for r in docs.where("length(text) BETWEEN 200 AND 800 AND lang = 'en' AND doc_id < 9000").orderBy("doc_id").limit(400).collect()]
    made, marks = [], []
    for i, t in enumerate(clean):
        w = t.split()
        if i % 4 == 0:
            for k, bad in enumerate(words):
                w.insert((k * 7) % len(w), bad)
        made.append((i, " ".join(w), "en"))
        marks.append((i, int(i % 4 == 0)))
    odd = [(9001, None, None), (9002, "", "en")]
    df = spark.createDataFrame(made + odd, "doc_id long, text string, lang string").withColumn("y", F.lit("clash"))
    got = toxicity.detect(df, spark.createDataFrame(marks, "doc_id long, toxic int"), rows=400).collect()
    assert len(got) == len(made) + 2 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    told = [r for r in got if r["held_out"] and r["doc_id"] < 9000]
    assert sum(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in told) / len(told) > 0.95
    assert all(r["predicted"] == 0 for r in got if r["doc_id"] > 9000)


def test_network_against_brute_force():
    """Largest activation of each filter, window by window; texts shorter than a filter, empty texts, and ties."""
    net = toxicity.Network(seed=3)
    texts = ["you are a stupid idiot indeed", "", "one", "two words", "same same same same", "été " * 40]
    raw = [t.encode() for t in texts]
    buf, at = np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    slots, doc = toxicity.word_slots(buf, at)
    margin = net.margin(slots, doc, len(texts))
    for k in range(len(texts)):
        x = [net.words[a] + net.words[b] for a, b in slots[doc == k]]
        top = []
        for w in toxicity.WIDTHS:
            for f in range(toxicity.FILTERS):
                views = [net.shifts[w][f] + sum(float(x[i + j] @ net.filters[w][j * toxicity.DIM : (j + 1) * toxicity.DIM, f]) for j in range(w)) for i in range(len(x) - w + 1)]
                top.append(max([0.0, *views]))
        assert abs(float(np.dot(top, net.out)) + net.bias[0] - margin[k]) < 1e-4, texts[k]


def test_threshold_against_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(50):
        margin, y, weight = rng.integers(-5, 5, 30).astype(float), (rng.random(30) < 0.4).astype(float), rng.random(30) + 0.1
        if y.sum() == 0:
            continue
        f1 = lambda cut: 2 * weight[(margin >= cut) & (y == 1)].sum() / (weight[margin >= cut].sum() + weight[y == 1].sum())
        assert f1(toxicity.threshold(margin, y, weight)) >= max(f1(c) for c in margin) - 1e-9


def test_toxicity_of_repeated_rows_and_long_texts(spark):
    rows = [(i, ("vile " if i % 2 else "kind ") + "words here %d" % i, "en") for i in range(200)]
    marks = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    odd = [(1001, "kind words " * 120_000, "en"), (1002, "kind words " * 120_000 + "vile", "en"), (1003, "vile words here", "en"), (1003, "vile words here", "en"), (None, None, None)]
    got = toxicity.detect(spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").repartition(3), marks).collect()
    assert len(got) == 205
    by = {r["doc_id"]: r for r in got}
    assert by[1001]["predicted"] == 0 and by[1002]["score"] > by[1001]["score"] and [r["score"] for r in got if r["doc_id"] == 1003] == [by[1003]["score"]] * 2


def test_toxicity_learns_from_every_labelled_row(spark):
    """Forty words mark toxic texts, each in a few rows; shards of 100 rows see only some of them."""
    letters = "bcdfghklmnprstvwz"
    bad = [letters[k % 17] + "a" + letters[k // 3] + "o" + letters[(5 * k) % 17] + "u" for k in range(40)]
    rng = np.random.default_rng(8)
    plain = [a + "e" + b + "i" + c for a in letters[:6] for b in letters[:6] for c in "xyq"]
    rows = []
    for i in range(1200):
        w = rng.choice(plain, 30).tolist()
        if i % 3 == 0:
            w[int(rng.integers(30))] = bad[i // 3 % 40]
        rows.append((i, " ".join(w), "en"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(1200)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.detect(df, marks, rows=100).collect()}
    told = [r for r in got.values() if r["held_out"]]
    caught = [r["predicted"] for r in told if r["doc_id"] % 3 == 0]
    false = [r["predicted"] for r in told if r["doc_id"] % 3]
    assert sum(caught) / len(caught) > 0.9 and sum(false) / len(false) < 0.05
    again = toxicity.detect(df.repartition(5, "text"), marks.repartition(3), rows=100).collect()
    assert all(r == got[r["doc_id"]] for r in again)


def test_toxicity_thresholds_and_languages_come_from_every_row(spark, monkeypatch):
    rows = [(i, ("vile " if i % 2 else "kind ") + "words", "en" if i % 4 < 2 else "de") for i in range(400)]
    marks = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = df.where((F.crc32(F.col("doc_id").cast("string")) % 5 != 0)).count()
    judged, learned, epoch, limits = [], [], toxicity._epoch, toxicity._limits
    monkeypatch.setattr(toxicity, "_epoch", lambda rows, *a: learned.append(rows.count()) or epoch(rows, *a))
    monkeypatch.setattr(toxicity, "_limits", lambda rows, *a: judged.append(rows.count()) or limits(rows, *a))
    monkeypatch.setattr(toxicity, "EPOCHS", 2)
    toxicity.fit(df, marks, rows=40)
    assert [n + judged[0] for n in learned] == [seen] * 2 and judged[0] > 0
    few, every = langid.fit(df, rows=1), langid.fit(df, rows=None)
    assert np.allclose(every.table, langid.fit(df, rows=400).table) and not np.allclose(every.table, few.table)


def test_score_of_a_text_does_not_depend_on_its_neighbours(monkeypatch):
    net = toxicity.Network(seed=3)
    net.words *= 20
    net.settle()
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 500, rng.integers(0, 60))).encode() for _ in range(300)]

    def margins(raw):
        at = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
        return net.margin(*toxicity.word_slots(np.frombuffer(b"".join(raw), np.uint8), at), len(raw)).tolist()

    whole = margins(texts)
    assert whole == [margins([t])[0] for t in texts] == margins(texts[::-1])[::-1]
    monkeypatch.setattr(toxicity, "BLOCK", 7)
    assert margins(texts) == whole


def test_toxicity_without_rows_or_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.detect(spark.createDataFrame([], "doc_id long, text string, lang string"), none).count() == 0
    assert toxicity.detect(spark.createDataFrame([(1, "a", "en")], "doc_id long, text string, lang string"), none).first()["score"] == 0
