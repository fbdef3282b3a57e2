"""Personal data, licences, web pages, pieces and the pipeline."""

import collections
import hashlib
import random
import re
import struct
import time

import numpy as np
import pytest

from lodestone.llm import licenses, pii, wrappers
from lodestone.llm import sentencepiece_codec as codec

EMPTY = "doc_id long, text string"


# --- personal data -----------------------------------------------------------


def luhn(d):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute_base(t):
    out, digits = [], lambda m: re.sub("[^0-9]", "", m)
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append(("email", m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0])):
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 8 <= len(digits(m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


PARTS = ["a", "@", ".", "_", "%", "+1", " ", "-", "12", "4111 1111 1111 1111", "é", "1.2.3.4", "300.1.1.1", "(5)", "b@c.d", "+49 30 1234567", "\n", "𝒳"]


def test_personal_data(spark):
    rng = random.Random(1)
    texts = [(i, "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60)))) for i in range(400)]
    texts += [(9001, None), (9002, ""), (9003, "1" * 30000), (9004, "a" * 60000), (9005, "1 " * 20000), (9006, "a.b@c." * 500), (9006, "x@y.z")]
    got = sorted(((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in pii.detect(spark.createDataFrame([(*t, 1) for t in texts], EMPTY + ", pii_email int")).collect()), key=str)
    want = []
    for d, t in texts:
        base = brute_base(t or "")
        n = [sum(x[0] == k for x in base) for k in pii.BASE]
        want.append((d, *n, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_many_matches_in_one_text(spark):
    """More matches than a block holds, multi-byte text between them."""
    text = "é4111 1111 1111 1111, " * 700 + "12," * 5000 + "ssn 123-45-6789 𝒳 " * 1100
    df = spark.createDataFrame([(1, text)], EMPTY)
    found = pii.detect(df).first()
    spans = [x.split(":") for x in found["spans"].split(",")]
    assert (found["n_card"], found["n_found"], len(spans)) == (700, 1800, 1800)
    assert [text[int(a) : int(b)] for kind, a, b in spans if kind == "ssn"] == ["123-45-6789"] * 1100
    assert found["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in brute_base(text)).encode()).hexdigest()
    assert pii.redact(df).first()["text"] == "é<CARD>, " * 700 + "12," * 5000 + "ssn <SSN> 𝒳 " * 1100


def test_checksums_context_and_redaction(spark):
    text = "IBAN DE89370400440532013000, GB82 WEST 1234 5698 7654 32, DE89370400440532013001. card 378282246310005 but 378282246310005, alone far away from any such word at all: 378282246310005. ssn 123-45-6789, é a@b.co 1.2.3.4"
    df = spark.createDataFrame([(1, text), (2, None), (3, "clean")], EMPTY)
    spans = {r["doc_id"]: r["spans"] for r in pii.detect(df).collect()}
    kinds = [s.split(":")[0] for s in spans[1].split(",")]
    assert kinds.count("iban") == 2 and kinds.count("short_card") == 2 and kinds.count("ssn") == 1 and spans[2] == spans[3] == ""
    at = [s.split(":") for s in spans[1].split(",")]
    assert text[int(at[0][1]) : int(at[0][2])] == "a@b.co"
    clean = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert "<EMAIL>" in clean[1] and "<IP>" in clean[1] and "6789" not in clean[1] and "013001" in clean[1]
    assert clean[2] is None and clean[3] == "clean"


def test_account_numbers_before_words_and_context_after(spark):
    texts = ["DE89370400440532013000 Please pay", "GB82WEST12345698765432 The", "DE89 3704 0044 0532 0130 00 BIC: COBADEFF", "NO9386011117947 12 NOK", "see 123-45-6789 (SSN", "378282246310005 is my card", "DE89370400440532013000X", "DE89370400440532013001 Please", "123-45-6789 alone", "GB82WEST12345698765432 DE89370400440532013000", "MT84MALT011000012345MTLCAST001S OK"]
    want = ["iban:0:22", "iban:0:22", "iban:0:27", "iban:0:15", "ssn:4:15", "short_card:0:15", "", "", "", "iban:0:22,iban:23:45", "iban:0:31"]
    got = {r["doc_id"]: r["spans"] for r in pii.detect(spark.createDataFrame(list(enumerate(texts)), EMPTY)).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert pii.redact(spark.createDataFrame([(1, texts[2])], EMPTY)).first()["text"] == "<IBAN> BIC: COBADEFF"


def test_personal_data_of_no_rows_runs_no_python(spark):
    assert pii.detect(spark.createDataFrame([], EMPTY)).count() == 0
    plan = pii.redact(spark.range(3).selectExpr("id doc_id", "'a@b.c' text"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- licences ----------------------------------------------------------------


def brute_licenses(text):
    """Every template at every place of the text that one of its key bigrams puts it."""
    low = re.sub("[^a-z0-9]+", " ", (text or "").translate({i: i + 32 for i in range(65, 91)})).split()
    pairs = lambda w: {tuple(w[i : i + 2]) for i in range(len(w) - 1)}
    hits = set()
    for name, template in licenses.TEMPLATES:
        words = re.findall("[a-z0-9]+", template.lower())
        all_pairs = [tuple(words[i : i + 2]) for i in range(len(words) - 1)]
        keys = {p: k for k, p in enumerate(all_pairs) if all_pairs.count(p) == 1 and any(w.startswith(s) for w in p for s in licenses.STEMS)}
        for i in range(len(low) - 1):
            if (k := keys.get(tuple(low[i : i + 2]))) is not None:
                lo, hi = max(0, i - k), min(len(low), i - k + len(words))
                a, b = pairs(low[lo:hi]), set(all_pairs)
                if 20 * len(a & b) >= 8 * (len(a) + len(b)):
                    hits.add((lo, hi, (len(a & b), 2 * len(a & b) / (len(a) + len(b))), name))
    notices = []
    for hit in sorted(hits):
        if notices and hit[0] < max(h[1] for h in notices[-1]):
            notices[-1].append(hit)
        else:
            notices.append([hit])
    best = [(-h[2][1], h[3]) for part in notices for h in part if h[2] == max(x[2] for x in part)]
    return len(notices), ",".join(sorted({x for _, x in best})), min(best)[1] if best else None, -min(best)[0] if best else None


def test_licenses(spark):
    named = dict(reversed(licenses.TEMPLATES))
    apache, mit = licenses.TEMPLATES[0][1], licenses.TEMPLATES[6][1]
    wrapped = "#!/bin/sh\n# " + licenses.TEMPLATES[2][1].replace(", ", ",\n#  ").replace(" of ", "\n#  of ") + "\nset -e"
    texts = [None, "", "nothing here", apache, "x\n" + apache.upper() + "\ny", "Released under the   MIT license", "Licensed under the Apache License, Version 9.", "a " * 5000, "licensed " * 5000]
    texts += [apache + " and much more text that follows it on the same line of the file", "See below. Released under the MIT License. See the file LICENSE", "Copyright 2020 Jane Doe. Licensed under the MIT License.", wrapped, "/* Copyright (c) A. Body\n *\n * " + mit.replace(". ", ".\n * ").replace("the Software is", "it is") + " */ int x;"]
    texts += ["Licensed under CC BY-NC 4.0.\nReleased under the MIT License.", "license", "the mit", " ".join(t for _, t in licenses.TEMPLATES), (apache + " x y z ") * 700, "warranty " + named["isc"][:-300]]
    texts += [t for _, t in licenses.TEMPLATES]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)] + [(3, apache, "z")], EMPTY + ", found string").repartition(4)
    got = sorted(((r["doc_id"], r["n_notices"], r["licenses"], r["best_license"], r["best_dice"]) for r in licenses.scan(df).collect()), key=str)
    assert got == sorted([(i, *brute_licenses(t)) for i, t in enumerate(texts)] + [(3, *brute_licenses(apache))], key=str)
    of = {r[0]: r for r in got}
    assert [of[i][2] for i in range(9, 14)] == ["apache-2.0", "mit", "mit", "apache-2.0", "mit"] and of[14][1:3] == (2, "cc-by-nc-4.0,mit") and of[18][1] == 700
    first = len(texts) - len(licenses.TEMPLATES)
    assert [of[first + i][2] for i, _ in enumerate(licenses.TEMPLATES)] == [name for name, _ in licenses.TEMPLATES]
    assert licenses.scan(spark.createDataFrame([], EMPTY)).count() == 0
    plan = licenses.scan(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- web pages ---------------------------------------------------------------

PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='</p>';</script></head><body><nav><ul><li><a href=/>Home</a></li><li><a href=/x>More</a></li></ul></nav>"
    "<div id='cookie-notice'>We use cookies</div>{}<div class=\"sidebar\">Side</div><footer>&copy; me</footer></body></html>"
)


def test_main_text():
    article = "<article><h1>Tom &amp; Jerry</h1><p>One<b>two</b>  three\n<p>Four<br>five &lt;six&gt;<aside>side</aside><ul><li>x<li>y</ul><table><tr><td>c<td>d</table><section class='comments'><article><p>nice!</p></article></section><form>Name <input></form><!-- no --></article>"
    assert wrappers.main_text(PAGE.format(article)) == "Tom & Jerry\nOnetwo three\nFour five <six>\nx\ny\nc\nd"
    assert wrappers.main_text(PAGE.format("<div><p>Plain page</p><p><a href=/>only link</a></p></div>")) == "Plain page"
    for page in ("", "   ", "<", "<p", "<!-- never closed", "<script>never closed", "</p></b>", "<div class=ad>x", "a < b & c", "<a b='c>d</a>", "<![CDATA[x", "<!x", "<p title='>'>q</p>"):
        assert isinstance(wrappers.main_text(page), str)
    assert wrappers.main_text("a < b & c") == "a < b & c" and wrappers.main_text("<p title='>'>q</p>") == "q" and wrappers.main_text("<p title='>q</p>") == "q"
    assert len(wrappers.main_text("<p>" + "word " * 100_000)) == 499_999


def test_hard_pages_take_linear_time():
    def seconds(page):
        begin = time.process_time()
        wrappers.infer([page, page])
        wrappers.main_text(page)
        return time.process_time() - begin

    for page in ("<div class=\"x>", "<p a='", "<div>", "<b>", "</b>", "<p>", "<li>", "<td>x", "<!--", "<", "<!", "<i class=x>a</i><u>b</u>", "<div><p>a</p>"):
        small, large = seconds(page * 4000), seconds(page * 16_000)
        assert large < 8 * small + 1, page
    assert wrappers.main_text("<div>" * 3000 + "x" + "</div><p>y</p>" * 3000).count("y") == 3000


def test_white_space_between_inline_elements():
    assert wrappers.main_text("<article><p>see <b>one</b> <i>two</i>\n<a href=/>three</a>&#32;<b>four</b></p> <p> five</p> </article>") == "see one two three four\nfive"
    assert wrappers.main_text("<div> <p><b>a</b>\n\t<b>b</b><b>c</b></p> </div>") == "a bc"
    assert wrappers.expression(wrappers.infer(["<p> <b>x</b> </p>"])) == "<p> 'x' </p>"


def test_wrapper_inference():
    pages = [PAGE.format(f"<article><h1>T{i}</h1>" + "<p>text %d</p>" * (i + 1) % tuple(range(i + 1)) + ("<blockquote>q</blockquote>" if i == 1 else "") + "</article>") for i in range(3)]
    wrapper = wrappers.infer(pages)
    regex = wrappers.expression(wrapper)
    assert regex == (
        "<html> <body> <nav> <ul> ( <li> # </li> )+ </ul> </nav> <div> 'We use cookies' </div> <article> <h1> # </h1> ( <p> # </p> )+ ( <blockquote> 'q' </blockquote> )? </article> "
        "<div.sidebar> 'Side' </div> <footer> '© me' </footer> </body> </html>"
    )
    assert wrappers.expression(wrappers.infer([])) == wrappers.expression(wrappers.infer([""])) == ""
    assert wrappers.expression(wrappers.infer(["<dl>" + "<dt>a%d<dd>b<dd>c" % i + "<dt>d<dd>e</dl>" for i in range(3)])) == "<dl> ( <dt> # </dt> )+ ( <dd> # </dd> )+ </dl>"
    # In whatever order and groups wrappers are aligned, they match all pages.
    for order in ([0, 1, 2], [2, 1, 0], [1, 0, 2]):
        trees = [wrappers.page_tree(wrappers.blocks(pages[i])) for i in order]
        merged = wrappers.merge(trees[0], wrappers.merge(trees[1], trees[2]))
        assert wrappers.expression(merged) == regex and merged[wrappers.PAGES] == 3


def test_wrapper_finds_the_region_without_articles(spark):
    """Texts that differ on every page: only the wrapper of the host tells the main region from what stands beside it."""
    rng = random.Random(2)
    words = lambda n: " ".join(rng.choice("abcdefgh") * rng.randint(1, 6) for _ in range(n))
    body = [(words(4), "\n".join(words(40) for _ in range(rng.randint(1, 5))), words(3)) for _ in range(40)]
    pages = ["<body><h1>%s</h1><div class=q%d><span>%s</span></div><div class='k'>%s</div><div class=z>%s</div></body>" % (h, i, words(2), "".join(f"<p>{x}</p>" for x in t.split("\n")), s) for i, (h, t, s) in enumerate(body)]
    pages += ["<body><table><tr><td>other page %d</table></body>" % i for i in range(3)]
    want = [h + "\n" + t for h, t, _ in body] + ["other page %d" % i for i in range(3)]
    assert extracted(spark, pages) == want
    assert [wrappers.main_text(p) for p in pages[:40]] != want[:40]
    wrapper = {r["host"]: (r["n_pages"], r["wrapper"]) for r in wrappers.infer_wrappers(spark.createDataFrame([(i, f"http://a.example/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string").repartition(40)).collect()}
    n, regex = wrapper["a.example"]
    other = "( <table> <tr> <td> # </td> </tr> </table> )?"  # shares nothing with the rest: before or after it
    assert n == 43 and other in regex
    assert " ".join(regex.replace(other, "").split()) == "<body> ( <h1> # </h1> )? ( <div.q0> # </div> )? ( <div.k> ( <p> # </p> )+ </div> )? ( <div.z> # </div> )? </body>"


def test_very_many_classes_become_a_slot():
    wrapper = wrappers.infer(["<div><section class='%s'><p>text %d</p></section></div>" % ("abcdefghijklmnopqrstuvwxyz"[i % 26] * (i // 26 + 1), i) for i in range(200)])
    assert wrappers.expression(wrapper) == "<div> ( <section.*> <p> # </p> </section> )+ </div>"


def brute_main(htmls):
    """Main text by the contract, for simple pages of one host: what is in articles, or all, without lists of marked elements and recurring texts."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.open, self.out, self.fresh = [], [], True

        def handle_starttag(self, tag, attrs):
            self.open.append((tag, dict(attrs).get("class", "")))
            self.fresh |= tag not in wrappers.INLINE

        def handle_endtag(self, tag):
            while self.open.pop()[0] != tag:
                pass
            self.fresh |= tag not in wrappers.INLINE

        def handle_data(self, data):
            gone = any(t in wrappers.DROPPED or set(c.split()) & wrappers.MARKS for t, c in self.open)
            path = tuple(x for x in self.open if x[0] not in wrappers.INLINE)
            if self.fresh:
                self.out.append([path, "", gone, any(t in wrappers.ARTICLE for t, _ in self.open)])
                self.fresh = False
            self.out[-1][1] += data

    pages = []
    for h in htmls:
        reader = Reader()
        reader.feed(h)
        found = [(p, " ".join(t.split()), a) for p, t, gone, a in reader.out if t.split() and not gone]
        pages.append([x for x in found if x[2]] or found)
    different = {h: p for h, p in zip(htmls, pages, strict=True)}.values()
    of, n = collections.Counter(), collections.Counter()
    for page in different:
        of.update({(p, a) for p, _, a in page})
        n.update(set(page))
    often = {x for x in n if (n[x] >= 3 and 2 * n[x] >= of[x[0], x[2]] if x[2] else n[x] >= 2 and 5 * n[x] >= of[x[0], x[2]])}
    out = []
    for page in pages:
        kept = [t for p, t, a in page if (p, t, a) not in often]
        whole = page and page[0][2] and 2 * sum(map(len, kept)) < sum(len(t) for _, t, _ in page)
        out.append("\n".join(t for _, t, _ in page) if whole else "\n".join(kept))
    return out


def test_extraction_against_brute_force(spark):
    rng = random.Random(11)
    text = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "&amp;", "<b>bold</b>", "x <i>y</i>", "é"]) for _ in range(rng.randint(5, 30)))
    pages = []
    for i in range(60):
        inside = "".join(rng.choice(["<p>%s</p>", "<ul><li>%s</li></ul>", "<h2>%s</h2>", "<blockquote><p>%s</p></blockquote>"]) % text() for _ in range(rng.randint(1, 6)))
        inside += "<p>Read more of our stories</p>" * (i % 4 > 0) + "<div class='share'>Share %d</div>" % i
        pages.append("<html><body><nav>%s</nav><div class='ad'>%s</div><article><h1>%s</h1>%s</article><aside>%s</aside><footer>f</footer></body></html>" % (text(), text(), text(), inside, text()))
    pages += pages[:3] + ["", "<html><body></body></html>"]
    assert extracted(spark, pages) == brute_main(pages)


def extracted(spark, htmls):
    df = spark.createDataFrame([(i, f"http://a.example/{i}", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")
    return [r["text"] for r in wrappers.extract(df).orderBy("page_id").collect()]


def test_templates_come_from_all_pages_of_a_host(spark):
    pages = ["<div><p>Same line</p><p>own %d</p></div>" % i for i in range(10)]
    pages += ["<section class='t%d'><span>Notice <b>of</b> %d</span><p>text %d, %d</p></section>" % (k, k, k, i) for k in range(30) for i in range(2)]
    pages += ["<ul><li>twice</li></ul><i>%d</i>" % i if i < 2 else "<ul><li>item %d</li></ul><i>%d</i>" % (i, i) for i in range(20)] + ["<h2>copy</h2>"] * 5
    got = extracted(spark, pages)
    assert got[9] == "own 9" and got[:10] == ["own %d" % i for i in range(10)]
    assert got[10:70] == ["text %d, %d" % (k, i) for k in range(30) for i in range(2)]
    assert got[70] == "twice\n0" and got[75] == "item 5\n5" and got[-1] == "copy"


def test_templates_inside_articles(spark):
    body = "<article><h1>Title %d</h1><div class=x1>Read all our <b>stories</b> here</div><p>own text %d, <a href=/>too</a></p><p>%s</p></article>"
    got = extracted(spark, [body % (i, i, "rare" if i < 3 else f"so {i}") for i in range(9)])
    assert got[8] == "Title 8\nown text 8, too\nso 8" and got[0] == "Title 0\nown text 0, too\nrare"
    copies = ["<article><h1>One story</h1><p>in many copies</p></article><i>%d</i>" % i for i in range(6)]
    assert extracted(spark, copies) == ["One story\nin many copies"] * 6


def test_extract(spark):
    rows = [(i, f"http://a.example/{i}", PAGE.format(f"<article><p>body {i}</p></article>")) for i in range(30)]
    rows += [(100, None, None), (101, "nonsense", ""), (102, "https://b.example:8080/x?y#z", "<p>b</p>"), (102, "https://b.example:8080/x?y#z", "<p>b</p>")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, host int")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in wrappers.extract(df).collect())
    assert len(got) == len(rows) and got[:2] == [(0, "body 0", 6), (1, "body 1", 6)] and (100, "", 0) in got and (101, "", 0) in got
    assert {r["host"]: r["n_pages"] for r in wrappers.infer_wrappers(df).collect()} == {"a.example": 30, "": 2, "b.example": 2}
    assert wrappers.infer_wrappers(df.limit(0)).count() == 0
    assert wrappers.extract(df.limit(0)).count() == 0


# --- pieces ------------------------------------------------------------------


def pack(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)


def hard_texts():
    rng = random.Random(3)
    parts = ["a", "the", " ", "  ", "    ", "\n", "é", "𝒳", "中文", "<s>", "▁", "1", "20", "ing", "\t", "ZZ", "own"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(600)] + ["", "a" * 3000, "abcdefghijklmnop" * 200, " " * 300, "中" * 400, "x" * 60 + "the" * 40, "\x00\x01"]


def test_same_ids_as_the_library():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=codec.MODEL)
    texts = hard_texts()
    buf, at = pack(texts)
    ids, count = codec.load().encode(buf, at)
    edge = np.concatenate(([0], np.cumsum(count)))
    assert [ids[a:b].tolist() for a, b in zip(edge[:-1], edge[1:], strict=True)] == library.encode(texts)


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def message(number, body):
    return varint(number << 3 | 2) + varint(len(body)) + body


def unigram_model():
    """A model file of a few pieces, made by hand."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), ("▁", -3.0, 1), ("▁a", -2.5, 1), ("ab", -2.0, 1), ("b", -4.0, 1), ("a", -3.5, 1), ("abc", -5.5, 1), ("c", -1.5, 1), ("bc", -2.2, 1), ("▁ab", -4.2, 1)]
    body = b"".join(message(1, message(1, p.encode()) + varint(2 << 3 | 5) + struct.pack("<f", s) + varint(3 << 3) + varint(k)) for p, s, k in pieces)
    trainer = varint(3 << 3) + varint(1)
    normalizer = message(1, b"identity") + varint(3 << 3) + varint(1) + varint(4 << 3) + varint(0) + varint(5 << 3) + varint(1)
    return body + message(2, trainer) + message(3, normalizer)


def test_unigram_paths_are_the_best():
    import sentencepiece

    data = unigram_model()
    library = sentencepiece.SentencePieceProcessor(model_proto=data)
    rng = random.Random(4)
    texts = ["".join(rng.choice("abc ") for _ in range(rng.randint(1, 120))) for _ in range(300)]
    own = codec.Codec(data)
    ids, count = own.encode(*pack(texts))
    edge = np.concatenate(([0], np.cumsum(count)))
    for t, a, b in zip(texts, edge[:-1], edge[1:], strict=True):
        assert abs(own.score[ids[a:b]].sum() - own.score[library.encode(t)].sum()) < 1e-4


def prose(words=4000):
    rng = random.Random(6)
    syllables = ["the", "ing", "an", "er", "tion", "o", "st", "qu", "re", "Zu", "é"]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 6))) + rng.choice(["", "", ",", "."]) for _ in range(words))


@pytest.mark.parametrize("text", [prose(), "thequickbrownfoxjumpsoverthelazydog" * 300, "a" * 3000], ids=["prose", "one word", "one letter"])
def test_one_stream_commits_in_a_bounded_window(text):
    """The whole text as one lane: the library's ids, from a window that does not grow with the text."""
    import sentencepiece

    own = codec.load()
    points = np.array([codec.SPACE] + [codec.SPACE if c == " " else ord(c) for c in text])
    held: list[int] = []
    ids, count = own._stream(own.char[points], np.array([0]), np.array([len(points)]), held)
    assert ids.tolist() == sentencepiece.SentencePieceProcessor(model_file=codec.MODEL).encode(text) and count.tolist() == [len(ids)]
    assert len(held) == (len(points) - 1) // own.longest
    if text[0] != "a":
        assert max(held) <= 4 * own.longest


def test_unigram_stream_is_one_path():
    own = codec.Codec(unigram_model())
    rng = random.Random(5)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 200))) for _ in range(50)]
    size = np.array([len(t) for t in texts])
    chars = own.char[[ord(c) for c in "".join(texts)]]
    ids, count = own._stream(chars, np.cumsum(size) - size, size)
    edge = np.concatenate(([0], np.cumsum(count)))
    for k, t in enumerate(texts):
        best = [0.0] + [-np.inf] * len(t)
        for i in range(len(t)):
            for piece, score in (("ab", -2.0), ("b", -4.0), ("a", -3.5), ("abc", -5.5), ("c", -1.5), ("bc", -2.2)):
                if t.startswith(piece, i):
                    best[i + len(piece)] = max(best[i + len(piece)], best[i] + score)
        assert abs(own.score[ids[edge[k] : edge[k + 1]]].sum() - best[-1]) < 1e-4


def test_encode_and_decode_tables(spark):
    texts = [(i, t) for i, t in enumerate(hard_texts())] + [(9001, None)]
    df = spark.createDataFrame([(*t, "x") for t in texts], EMPTY + ", exact string")
    encoded = codec.encode(df)
    assert encoded.columns == ["doc_id", "text", "ids", "exact"]
    for r in codec.decode(encoded.withColumnRenamed("text", "was"), text="now").collect():
        assert r["exact"] == ("▁" not in (r["was"] or "")) and (not r["exact"] or r["now"] == (r["was"] or ""))
    assert codec.digest(spark.createDataFrame([], EMPTY)).count() == 0


def test_unknown_models_are_refused():
    with pytest.raises(NotImplementedError):
        codec.Codec(unigram_model() + message(3, varint(4 << 3) + varint(1)))


def test_digest_of_repeated_rows_and_long_texts(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=codec.MODEL)
    texts = [(1, prose(200)), (1, prose(200)), (2, prose(1000) * 130), (None, None), (3, "中文" * 3000)]
    assert len(texts[2][1]) > 1_000_000
    got = sorted(((r["doc_id"], r["n_ids"], r["ids_sha256"], r["exact"]) for r in codec.digest(spark.createDataFrame(texts, EMPTY).repartition(2)).collect()), key=str)
    want = [(d, len(ids := library.encode(t or "")), hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest(), True) for d, t in texts]
    assert got == sorted(want, key=str)


# --- pipeline ----------------------------------------------------------------


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage's rows from the plain rules of its operator, on a small table with all kinds of cases."""
    import sentencepiece
    from test_search_and_dedup import brute_groups, brute_hits

    import corpus_pipeline
    from lodestone.llm import langid

    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    item = bench.where("size(split(text, ' ')) > 12").first()["text"]
    base = real.where("length(text) > 300").orderBy("doc_id").first()["text"]
    odd = [(9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, "123 !!", "en", "s", 1), (9004, base + " more words", "en", "s", 1), (9005, base, "en", "s", 1), (9005, base, "en", "s", 1), (9006, "the house " + item + " of the cat", "en", "s", 1), (9007, "the card 4111 1111 1111 1111 of the house, and mail me at a@b.co or +49 30 1234567 from 1.2.3.4 in the house", "en", "s", 1)]
    docs = real.unionByName(spark.createDataFrame(odd, real.schema))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted((r["doc_id"], r["n_ids"], tuple(r["ids"]), r["exact"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    good = {r["doc_id"] for r in langid.identify(docs).collect() if r["lang_pred"] != "und" and r["score"] >= langid.LEAST_SCORE}
    now = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in good]
    groups = collections.defaultdict(list)
    for d, _, component in brute_groups(now):
        groups[component].append(d)
    now = [(d, t) for d, t in dict(now).items() if d in {min(g) for g in groups.values()}]
    hit = {d for d, *_, bad in brute_hits(now, [(r["item_id"], r["text"]) for r in bench.collect()]) if bad}
    assert 9006 in hit and 9003 not in good
    now = [(d, t) for d, t in now if d not in hit]
    library = sentencepiece.SentencePieceProcessor(model_file=codec.MODEL)
    found = {r["doc_id"]: r["spans"] for r in pii.detect(docs).collect()}
    want = []
    for d, t in now:
        parts, at = [], 0
        assert {f"{k}:{a}:{b}" for k, a, b in brute_base(t)} <= set(found[d].split(","))
        for a, b, k in sorted((int(a), -int(b), k) for k, a, b in (x.split(":") for x in found[d].split(",") if x)):
            if a >= at:
                parts += [t[at:a], f"<{k.upper()}>"]
            at = max(at, -b)
        clean = "".join(parts) + t[at:]
        ids = library.encode(clean)
        want.append((d, len(ids), tuple(ids), "▁" not in clean))
    assert got == sorted(want)


def test_pipeline_of_no_rows(spark, sf):
    import corpus_pipeline
    from lodestone.llm import common

    now = common.table(spark, sf, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        now = common.stored(stage(spark, now, sf), name)
        assert now.count() == 0


def test_pipeline(spark, sf):
    import corpus_pipeline
    from lodestone.llm import common

    docs = common.table(spark, sf, "documents")
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, "mail me at a@b.co please, the house of the cat", "en", "s", 1), (9003, "mail me at a@b.co please, the house of the cat", "en", "s", 1)], docs.schema)
    now = docs.unionByName(odd)
    for name, stage in corpus_pipeline.STAGES:
        before = now
        now = common.stored(stage(spark, now, sf), name)
        if name != "sentencepiece":
            assert now.columns == docs.columns and now.count() <= before.count()
        if name == "simhash_dedup":
            assert now.where("doc_id = 9003").count() == 1
        if name == "pii":
            assert "<EMAIL>" in now.where("doc_id = 9003").first()["text"]
    assert now.count() > 100 and now.where("NOT exact").count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_dedup", "decontamination", "pii", "sentencepiece"]
