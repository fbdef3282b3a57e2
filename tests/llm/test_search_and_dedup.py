"""Decontamination, repeated strings, near-duplicates: against brute force, and on hard inputs."""

import collections
import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import common, components, decontaminate, simhash, suffix_dedup

EMPTY = "doc_id long, text string"
LOWER = {i: i + 32 for i in range(65, 91)}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SOLID = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df, key=str):
    return sorted((tuple(r) for r in df.collect()), key=key)


# --- decontamination ---------------------------------------------------------


def brute_hits(docs, items, n=10):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = WORD.findall((t or "").translate(LOWER))
        size = min(n, len(w))
        if i is not None and w:
            for k in range(len(w) - size + 1):
                windows[tuple(w[k : k + size])].add(str(i))
    out = []
    for d, t in docs:
        w = WORD.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if got := windows.get(tuple(w[k : k + size])):
                    hit.update(range(k, k + size))
                    found |= got
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    voc = ["the", "of", "to"] + ["w%d" % i for i in range(60)] + ["Ünï", "É", "x-y"]
    words = lambda n: " ".join(rng.choice(voc) for _ in range(n))
    items = [(i, words(rng.choice([1, 3, 9, 10, 11, 25]))) for i in range(25)] + [(7, words(12)), (90, None), (91, ""), (None, words(12)), (92, "the of to the of to the of to the of")]
    docs = []
    for i in range(120):
        text = words(rng.randint(0, 80))
        pick = rng.choice(items)[1]
        if i % 3 == 0 and pick:
            text += ", " + pick.upper() + "! " + words(5)
        docs.append((i, text))
    return [*docs, (500, None), (501, ""), (501, docs[0][1]), (None, docs[3][1]), (502, "the of to " * 40)], items


@pytest.mark.parametrize("block", [4_000_000, 60])
def test_decontamination(spark, corpus, block):
    docs, items = corpus
    df = spark.createDataFrame(docs, EMPTY).withColumn("items", F.lit(1)).repartition(3)
    got = decontaminate.decontaminate(df, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block).drop("items")
    assert rows(got) == brute_hits(docs, items)


def test_decontamination_of_empty_tables(spark, corpus):
    none = spark.createDataFrame([], EMPTY)
    bench = spark.createDataFrame(corpus[1], "item_id long, text string")
    assert decontaminate.decontaminate(none, bench).count() == 0
    clean = decontaminate.decontaminate(spark.createDataFrame(corpus[0][:5], EMPTY), spark.createDataFrame([], "item_id long, text string"))
    assert clean.count() == 5 and not any(r["contaminated"] for r in clean.collect())


def test_decontamination_of_texts_longer_than_a_piece(spark):
    rng = random.Random(7)
    long = " ".join("v%d" % rng.randint(0, 9999) for _ in range(260_000))
    item = "q w e r t y u i o p a s d f"
    docs = [(1, long + " " + item + " " + long[:2000]), (2, item), (3, long), (3, long), (4, "x" * 1_300_000)]
    assert len(long) > common.PIECE_BYTES
    got = decontaminate.decontaminate(spark.createDataFrame(docs, EMPTY).repartition(2), spark.createDataFrame([(5, item)], "item_id long, text string"))
    assert rows(got.drop("items")) == brute_hits(docs, [(5, item)])


def test_phrases_and_proximity(spark):
    index = decontaminate.build_index(spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "gamma x x x alpha"), (3, "alpha"), (4, "gamma")], EMPTY))
    hits = decontaminate.phrase_matches(index, decontaminate.phrases([("q", "beta gamma")])).collect()
    assert [(r["doc_id"], r["items"], r["spans"]) for r in hits] == [(1, ["q"], [1, 3])]
    near = lambda slop: sorted((r["doc_id"], r["begin"], r["end"]) for r in decontaminate.proximity_matches(index, [("q", "gamma alpha"), ("none", "zzz")], slop).collect())
    assert near(3) == [(1, 0, 3)] and near(5) == [(1, 0, 3), (2, 0, 5)]


def test_drop_contaminated_keeps_clean_rows_whole(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k", "x"), (1, "clean", "y"), (None, None, "z"), (2, "a b c d e f g h i j k", None)], "doc_id long, text string, digest string")
    kept = decontaminate.drop_contaminated(docs, spark.createDataFrame([(1, "b c d e f g h i j k")], "item_id long, text string"))
    assert kept.columns == docs.columns and rows(kept) == rows(docs.where("text = 'clean' OR text IS NULL"))


# --- repeated strings --------------------------------------------------------


def brute_cut(docs, span=400):
    count, passages = collections.Counter(), brute_passages(docs)
    for _, t in docs:
        b = (t or "").encode()
        count.update(b[i : i + span] for i in range(len(b) - span + 1))
    out = []
    for d, t in docs:
        b = (t or "").encode()
        mask = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if count[b[i : i + span]] > 1:
                mask[i : i + span] = b"\x01" * span
        runs = sum(1 for i, m in enumerate(mask) if m and not (i and mask[i - 1]))
        out.append((d, len(b), sum(mask), runs, hashlib.sha256(bytes(x for x, m in zip(b, mask, strict=True) if not m)).hexdigest(), passages[len(out)]))
    return sorted(out, key=str)


def brute_passages(docs, span=51):
    """Words in passages of ``span`` words or more that also start anywhere else, by document."""
    texts = [SOLID.findall(t or "") for _, t in docs]
    count = collections.Counter(tuple(w[i : i + span]) for w in texts for i in range(len(w) - span + 1))
    hit = [{k for i in range(len(w) - span + 1) if count[tuple(w[i : i + span])] > 1 for k in range(i, i + span)} for w in texts]
    return [len(x) for x in hit]


def repeated_texts():
    rng = random.Random(5)
    voc = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    words = lambda n: " ".join(rng.choice(voc) for _ in range(n))
    passages = [words(150) for _ in range(5)]
    docs = []
    for i in range(70):
        k = i % 6
        if k < 2:
            t = words(60) + rng.choice(passages) + words(50)
        elif k == 2:
            t = list(rng.choice(passages) + rng.choice(passages))
            for _ in range(3):
                t[rng.randrange(len(t))] = "#"
            t = "".join(t)
        elif k == 3:
            t = "ab" * rng.randint(100, 400)
        elif k == 4:
            t = "é" * rng.randint(150, 300) + rng.choice(passages)[: rng.randint(300, 500)]
        else:
            t = rng.choice(passages)[rng.randint(0, 300) :][: rng.randint(380, 700)]
        docs.append((i, t))
    return [*docs, (900, None), (901, ""), (902, docs[0][1]), (903, "x" * 399), (904, "x" * 400), (905, "y" * 401), (None, "z" * 500)]


def test_repeated_strings(spark):
    docs = repeated_texts()
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, uid int").repartition(4)
    assert rows(suffix_dedup.dedup(df)) == brute_cut(docs)


def test_one_bucket_holds_most_rows(spark):
    """One anchor in all texts, with strings that part at every distance from it."""
    rng = random.Random(8)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    middle, ends = noise(360), [noise(60) for _ in range(4)]
    docs = [(i, noise(30) + rng.choice(ends)[rng.randint(0, 59) :] + middle + rng.choice(ends)[: rng.randint(1, 60)] + noise(30)) for i in range(200)]
    assert rows(suffix_dedup.dedup(spark.createDataFrame(docs, EMPTY).repartition(5))) == brute_cut(docs)


def test_texts_longer_than_a_piece(spark):
    """Texts of over a megabyte, one of a single word, share a passage with short ones; white space differs."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9)))
    passage, tail = " ".join(word() for _ in range(120)), " ".join(word() for _ in range(60))
    long = " ".join(word() for _ in range(230_000))
    assert len(long) > common.PIECE_BYTES
    docs = [(1, long + " " + passage + " x"), (2, "y " + passage), (3, "z" * 1_200_000), (4, tail), (5, "so " + tail.replace(" ", "  "))]
    got = {r["doc_id"]: r for r in suffix_dedup.dedup(spark.createDataFrame(docs, EMPTY).repartition(2)).collect()}
    assert got[1]["n_removed"] == got[2]["n_removed"] == len(passage) + 1 and got[1]["n_passage_words"] == got[2]["n_passage_words"] == 120
    assert (got[3]["n_removed"], got[3]["n_passage_words"]) == (1_200_000, 0)
    assert [(got[k]["n_removed"], got[k]["n_passage_words"]) for k in (4, 5)] == [(0, 60), (0, 60)]


def test_no_repeats_and_no_rows(spark):
    assert suffix_dedup.dedup(spark.createDataFrame([], EMPTY)).count() == 0
    assert rows(suffix_dedup.dedup(spark.createDataFrame([(1, "short"), (2, None)], EMPTY))) == brute_cut([(1, "short"), (2, None)])


def test_pointers_name_equal_strings_alike():
    import numpy as np

    m = np.random.default_rng(1).integers(97, 99, 400, dtype=np.uint8)
    raw = m.tobytes()
    for w, ids in zip((4, 8), suffix_dedup.pointers(suffix_dedup.byte_symbols(m), (4, 8)), strict=True):
        assert len({(raw[i : i + w], int(x)) for i, x in enumerate(ids)}) == len({raw[i : i + w] for i in range(len(ids))}) == len(set(ids.tolist()))
    for size in (4, 7, 8, 16):
        at = np.arange(len(m) - size)
        ids = suffix_dedup.pointer(suffix_dedup.pointers(suffix_dedup.byte_symbols(m), (4,))[0], 4, at, np.full(len(at), size))
        assert len({(raw[i : i + size], int(x)) for i, x in enumerate(ids)}) == len({raw[i : i + size] for i in at.tolist()}) == len(set(ids.tolist()))


# --- near-duplicates ---------------------------------------------------------


def fingerprint(text):
    w = SOLID.findall((text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(docs):
    prints = sorted({fingerprint(t) for _, t in docs})
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                parent[find(b)] = find(a)
    least = {}
    for d, t in docs:
        r = find(fingerprint(t))
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return sorted(((d, f"{fingerprint(t):016x}", least.get(find(fingerprint(t)))) for d, t in docs), key=str)


def near_texts():
    rng = random.Random(9)
    base = [" ".join("w%d" % rng.randint(0, 500) for _ in range(rng.choice([1, 2, 3, 40, 200, 400]))) for _ in range(40)]
    docs = [(i, t) for i, t in enumerate(base)]
    for i in range(100, 180):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = "changed"
        docs.append((i, " ".join(w)))
    return [*docs, (300, None), (301, ""), (302, " \n"), (303, base[0].upper()), (303, base[1]), (None, base[2]), (None, "lonely text here")]


@pytest.mark.parametrize("tile", [simhash.TILE, 2])
def test_near_duplicates(spark, tile, monkeypatch):
    monkeypatch.setattr(simhash.links, "__defaults__", (simhash.RADIUS, tile))
    docs = near_texts()
    df = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, fp int").repartition(3)
    assert rows(simhash.near_duplicates(df)) == brute_groups(docs)


def test_near_duplicates_of_texts_longer_than_a_piece(spark):
    rng = random.Random(12)
    long = " ".join("v%d" % rng.randint(0, 9999) for _ in range(230_000))
    docs = [(5, long), (6, long + " one more"), (7, "short text here"), (8, long.replace("v1 ", "v2 ")), (9, "y" * 1_200_000)]
    assert rows(simhash.near_duplicates(spark.createDataFrame(docs, EMPTY))) == brute_groups(docs)


def test_near_duplicates_of_no_rows(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], EMPTY)).count() == 0


def test_keep_one(spark):
    docs = near_texts()
    df = spark.createDataFrame([(d, t, "s") for d, t in docs], "doc_id long, text string, __own string")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    groups = collections.defaultdict(list)
    for d, f, c in brute_groups(docs):
        groups[c if c is not None else f].append(d)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(min((d for d in g if d is not None), default=None)) for g in groups.values())


def test_components_of_a_chain_a_star_and_a_ring(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(1000, 1000 + i) for i in range(1, 60)]
    ring = [(2000 + i, 2000 + (i + 7) % 30) for i in range(30)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(chain + star + ring + [(5, 5)], "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {1000 + i: 1000 for i in range(60)} | {2000 + i: 2000 for i in range(30)}
