"""Main text of web pages by union-free regular-expression inference.

Pages of one host come from few templates.  A wrapper is a sequence of nodes:
an element with its own sequence, a text constant, a text slot, an optional
group ``( ... )?`` or a repeated group ``( ... )+``; it has no alternation.
It is inferred by iterative alignment.  A page is a sequence of blocks of text
inside elements; neighbouring copies of a group of elements are folded into a
repeated group.  Two wrappers are aligned along the elements that both have
once and in the same order, and so on between those.  Texts that differ become
slots, repeated groups absorb further copies, elements that only one side has
become optional, and where many elements differ in their classes alone, the
class becomes a slot too.

Every page of a host takes part: each task aligns the pages it reads, and the
wrappers of tasks are aligned in groups of ``GROUP`` until a host has one.  No
task holds more than a group of wrappers, and a wrapper grows with the
templates of a host, not with its pages.

The wrapper decides what is main text.  A page is matched with the wrapper of
its host, and a block counts by the slot that it falls into:

* slots in elements for menus, adverts, forms and the like never count;
* if articles hold the text of the wrapper, slots inside them count;
* else the main region is sought: from the root down, as long as one element
  holds most of the text.  Slots in the region count, and outside of it main
  headings and elements with a fair share of text that is not links;
* a text that fills its place on a share of the host's different pages is a
  constant of the template.  Shares are counted over all pages by an
  aggregation, as copies of a page must not count.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import json
import re
from collections import Counter
from collections.abc import Iterator, Set

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import Tables, arrow_map, table

#: Wrappers that are aligned at once.
GROUP = 16
#: Wrappers that a task holds before it hands them on.
HELD = 500
#: Elements of one name with different classes in one sequence; more are told apart no longer.
CLASSES = 32
#: Elements inside each other that a wrapper tells apart; deeper ones belong to the last of these.
DEPTH = 60
#: Pages on which a text outside an article must recur to count as part of the template.
RECURRING = 2
#: Share of the host's pages with a place outside an article on which a block must fill it to count as part of the template.
SHARE = 0.2
#: The same inside an article, where the tags speak for main text; and pages at least.
ARTICLE_SHARE = 0.5
ARTICLE_RECURRING = 3
#: Share of an element's text that one element in it must hold to be gone into, and that of the region which an element outside it needs to count.
REGION_SHARE = 0.6
BESIDE_SHARE = 0.1

# Elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math")
DROPPED = frozenset("head nav header footer aside form button select dialog menu noscript script style template iframe svg math title textarea".split())
ARTICLE = frozenset("article main".split())
INLINE = frozenset("a abbr b bdi bdo br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
MARKS = frozenset(
    "ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer header login menu modal nav navbar navigation newsletter notice "
    "pager pagination popup promo promotion related reply respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())

_BEGIN = re.compile(r"<(?:(!--)|(!\[CDATA\[)|([!?])|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
_NUMBER = re.compile("[0-9]+")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|itemprop)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}


_LIKE = {name: (name,) for name in ("li", "tr", "option")} | {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}
_LISTS = frozenset("ul ol dl table tbody tr select menu".split())


class Element:
    """An open element; dropped, main, link: whether it or one around it is.  own: its name and classes, which ``sign`` has without numbers.  block: the nearest element that is not inline."""

    __slots__ = ("block", "depth", "dropped", "link", "main", "name", "own", "parent", "sign", "top")

    def __init__(self, name: str, own: str, dropped: bool, main: bool, parent: Element | None):
        self.name, self.own, self.sign, self.parent = name, own, name + _NUMBER.sub("0", own[len(name) :]), parent
        self.dropped = dropped or (parent is not None and parent.dropped)
        self.main = main or (parent is not None and parent.main)
        self.link = name == "a" or (parent is not None and parent.link)
        around = parent.block if parent is not None else None
        self.block = around if name in INLINE and around is not None else self
        self.depth = (around.depth + 1 if self.block is self else around.depth) if around is not None else 0
        self.top = self.block if self.depth <= DEPTH else around.top


def _signature(name: str, attributes: str) -> tuple[str, bool, bool]:
    """(name with its classes, dropped, article) of an element."""
    found = {k.lower(): a or b or c or "" for k, a, b, c in _ATTRIBUTE.findall(attributes)}
    words = re.findall(r"[a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{found.get('class', '')} {found.get('id', '')}").lower())
    main = name in ARTICLE or found.get("role", "").lower() in ("main", "article") or found.get("itemprop", "").lower() == "articlebody"
    dropped = name in DROPPED or found.get("role", "").lower() in ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true"
    dropped = dropped or (not MARKS.isdisjoint(words) and name not in ("html", "body", "main"))
    return ".".join([name, *found.get("class", "").split()]), dropped, main and not dropped


def _tag_end(page: str, at: int, none: set[str]) -> int:
    """Place of the ``>`` that ends a tag, outside quotes unless one never closes; ``none`` gets quotes that have no further copy."""
    first = -1
    look = at
    while True:
        m = _STOP.search(page, look)
        if not m:
            return first if first >= 0 else page.find(">", at)
        if m[0] == ">":
            return m.start()
        close = -1 if m[0] in none else page.find(m[0], m.end())
        if close < 0:
            none.add(m[0])
            return page.find(">", at)
        look = close + 1


def events(page: str) -> Iterator[tuple[str, str, Element]]:
    """("text", text, element around it) for texts outside raw elements, ("break", name, element) for tags that are no inline elements; in time linear in the page."""
    root = Element("", "", False, False, None)
    stack = [root]
    open_: Counter[str] = Counter()
    none: set[str] = set()
    last = page.rfind(">")
    at = 0

    def cut(k: int) -> None:
        for e in stack[k:]:
            open_[e.name] -= 1
        del stack[k:]

    while at < len(page):
        m = _BEGIN.search(page, at)
        if not m or (m.start() > last and not (m[1] or m[2])):
            yield "text", html_lib.unescape(page[at:]), stack[-1]
            return
        if m.start() > at:
            yield "text", html_lib.unescape(page[at : m.start()]), stack[-1]
        if m[1] or m[2]:
            end = page.find("-->" if m[1] else "]]>", m.end())
            end = len(page) if end < 0 else end
            if m[2]:
                yield "text", page[m.end() : end], stack[-1]
            at = end + 3
            continue
        if m[3]:
            at = page.find(">", m.end()) + 1
            continue
        end = _tag_end(page, m.end(), none)
        name, attributes, at = m[5].lower(), page[m.end() : end], end + 1
        if m[4]:
            if open_[name]:
                k = len(stack) - 1
                while stack[k].name != name:
                    k -= 1
                cut(k)
            if name not in INLINE:
                yield "break", name, stack[-1]
            continue
        if name in CLOSES_P and open_["p"]:
            k = len(stack) - 1
            while stack[k].name in INLINE:
                k -= 1
            if stack[k].name == "p":
                cut(k)
        elif name in _LIKE and any(open_[x] for x in _LIKE[name]):
            k = len(stack) - 1
            while k > 0 and stack[k].name not in _LIKE[name] and stack[k].name not in _LISTS:
                k -= 1
            if stack[k].name in _LIKE[name]:
                cut(k)
        if name not in INLINE or name == "br":
            yield "break", name, stack[-1]
        if name in VOID:
            continue
        if name in RAW:  # nothing inside is markup
            m = _RAW_END[name].search(page, at)
            at = m.end() if m else len(page)
            continue
        stack.append(Element(name, *_signature(name, attributes), stack[-1]))
        open_[name] += 1


class Block:
    """A block of text: its element, text, characters within links, and all."""

    __slots__ = ("dropped", "element", "linked", "main", "size", "text")

    def __init__(self, element: Element, parts: list[str], linked: int, size: int, first: Element):
        self.element, self.text, self.linked, self.size = element, " ".join("".join(parts).split()), linked, size
        self.dropped, self.main = first.dropped, first.main


def blocks(page: str) -> list[Block]:
    """All blocks of a page that hold more than white space, those of dropped elements included."""
    out: list[Block] = []
    held: list | None = None  # element, parts, linked, size, element of the first text
    for kind, value, e in events(page):
        if kind == "break":
            if value == "br" and held:
                held[1].append(" ")
            elif value != "br":
                if held:
                    out.append(Block(*held))
                held = None
            continue
        if value.isspace() or not value:
            if held:
                held[1].append(" ")
            continue
        if held and (held[0] is not e.block or held[4].dropped != e.dropped or held[4].main != e.main):
            out.append(Block(*held))
            held = None
        if held is None:
            held = [e.block, [], 0, 0, e]
        held[1].append(value)
        held[2] += len(value) if e.link else 0
        held[3] += len(value)
    if held:
        out.append(Block(*held))
    return [b for b in out if b.text]


def _path(e: Element) -> list[Element]:
    """Blocks around a block, itself last, the outermost ``DEPTH`` of them."""
    e = e.top
    out = []
    while e.parent is not None:
        out.append(e)
        e = e.parent.block
    return out[::-1]


def place(b: Block) -> str:
    """Where a block stands: the elements around it with their classes, numbers included."""
    return "/".join(e.own for e in _path(b.element))


# --- wrappers ----------------------------------------------------------------

#: [sign, or # for a text; pages; dropped; article; repeated; nodes inside; constant text or None; characters; characters in links]
Node = list
SIGN, PAGES, GONE, MAIN, MANY, INSIDE, TEXT, CHARS, LINKED = range(9)


def page_tree(page: list[Block]) -> Node:
    """The blocks of a page as a wrapper of one page."""
    root: Node = ["", 1, False, False, False, [], None, 0, 0]
    way: list[tuple[Element | None, Node]] = [(None, root)]
    for b in page:
        path = _path(b.element)
        k = 0
        while k < len(path) and k + 1 < len(way) and way[k + 1][0] is path[k]:
            k += 1
        for _, node in way[k + 1 :]:
            node[INSIDE] = fold(node[INSIDE])
        del way[k + 1 :]
        for e in path[k:]:
            node = [e.sign, 1, e.dropped, e.main, False, [], None, 0, 0]
            way[-1][1][INSIDE].append(node)
            way.append((e, node))
        way[-1][1][INSIDE].append(["#", 1, b.dropped, b.main, False, [], b.text, b.size, b.linked])
    for _, node in way[::-1]:
        node[INSIDE] = fold(node[INSIDE])
    return root


def fold(nodes: list[Node]) -> list[Node]:
    """Neighbouring copies of a group of nodes become one repeated group."""
    out: list[Node] = []
    places: dict[str, list[int]] = {}
    for node in nodes:
        out.append(node)
        before = places.setdefault(node[SIGN], [])
        size = len(out) - 1 - before[-1] if before else 0
        if size and len(out) >= 2 * size and all(out[-1 - i][SIGN] == out[-1 - size - i][SIGN] for i in range(size)):
            for i in range(size):
                one, other = out[-2 * size + i], out[-size + i]
                merged = merge(one, other, False)
                merged[MANY] = True
                out[-2 * size + i] = merged
            for gone in out[-size:-1]:
                places[gone[SIGN]].pop()
            del out[-size:]
        else:
            before.append(len(out) - 1)
    return out


def merge(a: Node, b: Node, pages: bool = True) -> Node:
    """One node for two at the same place; pages: of different pages."""
    inside = align(a[INSIDE], b[INSIDE], pages) if a[INSIDE] or b[INSIDE] else []
    return [a[SIGN], a[PAGES] + b[PAGES] if pages else max(a[PAGES], b[PAGES]), a[GONE] and b[GONE], a[MAIN] or b[MAIN], a[MANY] or b[MANY], inside, a[TEXT] if a[TEXT] == b[TEXT] else None, a[CHARS] + b[CHARS], a[LINKED] + b[LINKED]]


def _common(xs: list[Node], ys: list[Node]) -> list[tuple[int, int]]:
    """Pairs of nodes with equal signs that both sequences have once, in the longest order that both keep."""
    one, two = Counter(x[SIGN] for x in xs), Counter(y[SIGN] for y in ys)
    where = {y[SIGN]: j for j, y in enumerate(ys) if two[y[SIGN]] == 1}
    pairs = [(i, where[x[SIGN]]) for i, x in enumerate(xs) if one[x[SIGN]] == 1 and x[SIGN] in where]
    tails: list[int] = []  # patience: the pile on which each pair lies, and the pair below it
    below = [-1] * len(pairs)
    ends: list[int] = []
    for k, (_, j) in enumerate(pairs):
        lo, hi = 0, len(ends)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if ends[mid] < j else (lo, mid)
        below[k] = tails[lo - 1] if lo else -1
        if lo == len(ends):
            ends.append(j)
            tails.append(k)
        else:
            ends[lo], tails[lo] = j, k
    out = []
    k = tails[-1] if tails else -1
    while k >= 0:
        out.append(pairs[k])
        k = below[k]
    return out[::-1]


def align(xs: list[Node], ys: list[Node], pages: bool = True) -> list[Node]:
    """The sequence that matches both: what only one has is optional (it has fewer pages than what it is in)."""
    if [x[SIGN] for x in xs] == [y[SIGN] for y in ys]:
        return [merge(x, y, pages) for x, y in zip(xs, ys, strict=True)]
    if not xs or not ys:
        return xs or ys
    pairs = _common(xs, ys)
    if not pairs:  # nothing occurs once: go along the begins and ends that agree
        k = 0
        while k < min(len(xs), len(ys)) and xs[k][SIGN] == ys[k][SIGN]:
            k += 1
        e = 0
        while e < min(len(xs), len(ys)) - k and xs[-1 - e][SIGN] == ys[-1 - e][SIGN]:
            e += 1
        pairs = [(i, i) for i in range(k)] + [(len(xs) - i, len(ys) - i) for i in range(e, 0, -1)]
        if not pairs:
            return _told_apart(fold(xs + ys))
    out: list[Node] = []
    i = j = 0
    for a, b in [*pairs, (len(xs), len(ys))]:
        out += align(xs[i:a], ys[j:b], pages)
        if a < len(xs):
            out.append(merge(xs[a], ys[b], pages))
        i, j = a + 1, b + 1
    return _told_apart(fold(out))


def _told_apart(nodes: list[Node]) -> list[Node]:
    """Elements of one name with very many different classes lose them, as do those that come later."""
    if len(nodes) <= CLASSES and not any(n[SIGN].endswith(".*") for n in nodes):
        return nodes
    of: dict[str, set[str]] = {}
    for n in nodes:
        of.setdefault(n[SIGN].partition(".")[0], set()).add(n[SIGN])
    wide = {name for name, signs in of.items() if len(signs) > CLASSES or name + ".*" in signs}
    if not wide:
        return nodes
    out: list[Node] = []
    where: dict[tuple[str, bool], int] = {}
    for n in nodes:
        name = n[SIGN].partition(".")[0]
        if name in wide:
            key = name, n[GONE]
            if key in where:
                out[where[key]] = merge(out[where[key]], [name + ".*", *n[1:]])
                out[where[key]][MANY] = True
                continue
            where[key] = len(out)
            n = [name + ".*", *n[1:]]
        out.append(n)
    return out


def infer(pages: list[str]) -> Node:
    """Wrapper of the pages of one host; that of an empty page for none."""
    trees = [page_tree(blocks(page)) for page in pages] or [page_tree([])]
    wrapper = trees[0]
    for tree in trees[1:]:
        wrapper = merge(wrapper, tree)
    return wrapper


def expression(wrapper: Node) -> str:
    """The wrapper as a regular expression over tags: ``#`` is a slot, quoted text a constant."""

    def inside(nodes: list[Node], pages: int) -> str:
        out = []
        for n in nodes:
            own = (repr(n[TEXT]) if n[TEXT] is not None else "#") if n[SIGN] == "#" else " ".join(x for x in (f"<{n[SIGN]}>", inside(n[INSIDE], n[PAGES]), f"</{n[SIGN].partition('.')[0]}>") if x)
            own = f"( {own} )+" if n[MANY] else own
            out.append(f"( {own} )?" if n[PAGES] < pages else own)
        return " ".join(out)

    return inside(wrapper[INSIDE], wrapper[PAGES])


def _sizes(node: Node) -> tuple[int, int, int]:
    """Characters outside links, within links, and characters in articles, of what is not dropped."""
    if node[SIGN] == "#":
        return (0, 0, 0) if node[GONE] else (node[CHARS] - node[LINKED], node[LINKED], node[CHARS] if node[MAIN] else 0)
    found = [_sizes(n) for n in node[INSIDE]]
    return tuple(sum(x) for x in zip(*found, strict=True)) if found else (0, 0, 0)


class Verdict:
    """Which slots of a wrapper hold main text.

    The wrapper of one page alone says nothing about a template: all its slots count.
    """

    def __init__(self, wrapper: Node):
        self.root, self.region = wrapper, wrapper
        self.beside: set[int] = set()  # nodes outside the region whose slots count, by identity
        self.articles = _sizes(wrapper)[2] > 0
        if self.articles or wrapper[PAGES] < 2:
            return
        way = [wrapper]
        while True:
            best = max((n for n in way[-1][INSIDE] if n[SIGN] != "#" and not n[GONE]), key=lambda n: _sizes(n)[0], default=None)
            if best is None or best[SIGN].partition(".")[0] not in _BOXES:
                break
            most = _sizes(best)[0] / best[PAGES]
            # Text of the others on a page that has the best.
            rest = sum(_sizes(n)[0] / max(n[PAGES], best[PAGES]) for n in way[-1][INSIDE] if n is not best)
            if most < REGION_SHARE * max(most + rest, 1):
                break
            way.append(best)
        self.region = way[-1]
        for outer, inner in zip(way, way[1:], strict=False):
            for n in outer[INSIDE]:
                own, linked, _ = _sizes(n)
                if n is not inner and (n[SIGN].partition(".")[0] in ("h1", "h2") or (own > linked and own / n[PAGES] >= BESIDE_SHARE * _sizes(self.region)[0] / self.region[PAGES])):
                    self.beside.add(id(n))

    def main(self, page: list[Block]) -> list[Block]:
        """The blocks of a page whose slots count; of a page without the main region, all that are not dropped."""
        if self.articles:
            return [b for b in page if b.main and not b.dropped]
        at: dict[Element | None, tuple[Node | None, int]] = {None: (self.root, int(self.region is self.root))}  # 1: in the region, 2: beside it
        found = []
        for b in page:
            now: Element | None = None
            for e in _path(b.element):
                if e not in at:
                    node, kept = at[now]
                    inside = node[INSIDE] if node else ()
                    loose = e.sign.partition(".")[0] + ".*"
                    slot = next((n for n in inside if n[SIGN] == e.sign), None) or next((n for n in inside if n[SIGN] == loose), None)
                    at[e] = slot, kept or (slot is not None and (int(slot is self.region) or 2 * (id(slot) in self.beside)))
                now = e
            node, kept = at[now]
            kept = kept or 2 * any(n[SIGN] == "#" and id(n) in self.beside for n in (node[INSIDE] if node else ()))
            found.append(kept)
        if 1 not in found:
            return [b for b in page if not b.dropped]
        return [b for b, kept in zip(page, found, strict=True) if kept and not b.dropped]


#: Elements that the search for the main region goes into.
_BOXES = frozenset("html body div section main article center table tbody tr td form fieldset dl".split())


def main_text(page: str, verdict: Verdict | None = None, shared: Set[tuple[str, str]] = frozenset()) -> str:
    """Blocks of the main text of a page, by its host's wrapper (without one, by its own).

    ``shared``: (place, text) of blocks that recur on the host's different
    pages and so are the template's.  A page without an article on a host with
    articles is judged by its own wrapper.  An article of which the template
    would leave less than half is a copy of others, not a template, and stays
    whole.  A page of links alone has no main text.
    """
    found = blocks(page)
    articles = any(b.main and not b.dropped for b in found)
    if verdict is None or verdict.articles != articles:
        verdict = Verdict(page_tree(found))
    counted = verdict.main(found)
    kept = [b for b in counted if (place(b), b.text) not in shared]
    if not articles:
        own = [b for b in kept if b.linked < b.size]
    else:
        own = kept if 2 * sum(len(b.text) for b in kept) >= sum(len(b.text) for b in counted) else counted
    return "\n".join(b.text for b in own)


# --- wrappers of all hosts ---------------------------------------------------

_PARTS = "host string, part bigint, wrapper string"
_READ = "host string, place bigint, block bigint, page bigint, article boolean, part bigint, wrapper string"


def _host(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages (host, html) as digests of their places (block null) and of their blocks with places, and whether they stand in an article; after these, the wrappers of one task's hosts."""
    task = TaskContext.get()
    part = task.partitionId() if task else 0
    names = [x.split()[0] for x in _READ.split(", ")]
    held: dict[str, Node] = {}

    def wrappers() -> pa.RecordBatch:
        none = [pa.nulls(len(held), pa.int64())] * 3
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), *none, pa.nulls(len(held), pa.bool_()), pa.array([part] * len(held), pa.int64()), pa.array([json.dumps(w) for w in held.values()], pa.string())], names=names)

    for batch in batches:
        hosts, pages, places, texts, insides = [], [], [], [], []
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            every = blocks(html)
            tree = page_tree(every)
            held[host] = merge(held[host], tree) if host in held else tree
            found = [x for x in every if not x.dropped]
            articles = any(x.main for x in found)
            page = _digest(html)
            pairs = {(_digest(at := place(x)), _digest(at, x.text)) for x in found if x.main or not articles}
            rows = [*pairs, *((p, None) for p in {p for p, _ in pairs})]
            hosts += [host] * len(rows)
            pages += [page] * len(rows)
            insides += [articles] * len(rows)
            places += [p for p, _ in rows]
            texts += [t for _, t in rows]
        n = len(hosts)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(places, pa.int64()), pa.array(texts, pa.int64()), pa.array(pages, pa.int64()), pa.array(insides, pa.bool_()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string())], names=names)
        if len(held) > HELD:
            yield wrappers()
            held = {}
    yield wrappers()


def _merged(group: pa.Table) -> pa.Table:
    """One wrapper for the rows of a host's group."""
    trees = [json.loads(w) for w in group.sort_by([("part", "ascending"), ("wrapper", "ascending")]).column("wrapper").to_pylist()]
    wrapper = trees[0]
    for tree in trees[1:]:
        wrapper = merge(wrapper, tree)
    return pa.table({"host": group.column("host")[:1].cast(pa.string()), "part": pa.array([group.column("part")[0].as_py() // GROUP], pa.int64()), "wrapper": pa.array([json.dumps(wrapper)], pa.string())})


def _wrappers(read: DataFrame, tables: Tables) -> DataFrame:
    """(host, part, wrapper): the wrapper of each host, from those of tasks, aligned group by group."""
    now = read.where("wrapper IS NOT NULL").select("host", "part", "wrapper")
    highest, level = now.agg(F.max("part")).first()[0] or 0, 0
    while True:
        level += 1
        now = tables.stored(now.groupBy("host", F.floor(F.col("part") / GROUP)).applyInArrow(_merged, _PARTS), f"parts{level}")
        tables.drop(f"parts{level - 1}")
        highest //= GROUP
        if highest == 0:
            return now


def _digest(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


class Digests(frozenset):
    """(place, text) pairs known by their digests."""

    def __contains__(self, pair: tuple[str, str]) -> bool:
        return bool(self) and super().__contains__(_digest(*pair))


def _template_blocks(read: DataFrame, tables: Tables) -> DataFrame:
    """(of, blocks): digests of the blocks that recur on each host's pages.

    Copies of a page (the same html) count once.
    """
    rows = read.where("wrapper IS NULL").select("host", "place", "block", "page", "article").distinct()
    counts = tables.stored(rows.groupBy("host", "place", "block", "article").agg(F.count("*").alias("n")).where(F.col("n") >= RECURRING), "places")
    whole = counts.where("block IS NULL").select("host", "place", "article", F.col("n").alias("of"))
    often = F.when(F.col("article"), (F.col("n") >= ARTICLE_RECURRING) & (F.col("n") >= ARTICLE_SHARE * F.col("of"))).otherwise(F.col("n") >= SHARE * F.col("of"))
    kept = counts.where("block IS NOT NULL").join(whole, ["host", "place", "article"]).where(often)
    return kept.groupBy(F.col("host").alias("of")).agg(F.collect_list("block").alias("blocks"))


def _pages_read(pages: DataFrame, url: str, html: str, tables: Tables) -> DataFrame:
    return tables.stored(arrow_map(pages.select(_host(F.col(url)).alias("host"), F.coalesce(F.col(html), F.lit("")).alias("html")), _read, _READ), "read")


def infer_wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, n_pages, wrapper): each host's wrapper over all its pages, as an expression.

    Null html counts as an empty page; pages without a host share the empty host.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [json.loads(w) for w in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([w[PAGES] for w in found], pa.int64()), pa.array([expression(w) for w in found], pa.string())], names=["host", "n_pages", "wrapper"])

    tables = Tables(pages.sparkSession)
    found = _wrappers(_pages_read(pages, url, html, tables), tables)
    tables.drop("read")
    return arrow_map(found.select("host", "wrapper"), run, "host string, n_pages bigint, wrapper string")


def extract(pages: DataFrame) -> DataFrame:
    """Main text of every page of ``pages`` (page_id, url, html): page_id, url, text and n_chars.

    Null or empty html, and pages without main text, give the empty string.
    Repeated rows are extracted each; an empty table gives an empty result;
    other columns are not read.
    """
    tables = Tables(pages.sparkSession)
    read = _pages_read(pages, "url", "html", tables)
    wrappers = _wrappers(read, tables).select(F.col("host").alias("of"), "wrapper")
    known = tables.stored(wrappers.join(_template_blocks(read, tables), "of", "left"), "known")
    tables.drop("read", "places")
    each = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html"), _host(F.col("url")).alias("host"))
    joined = each.join(known, F.col("host") == F.col("of"), "left").select("page_id", "url", "html", "host", "wrapper", "blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, tuple] = {}
        for b in batches:
            hosts, wrapper, recurring = b.column("host").to_pylist(), b.column("wrapper"), b.column("blocks")
            for k, host in enumerate(hosts):
                if host not in own:
                    if len(own) >= HELD:
                        own.clear()
                    own[host] = Verdict(json.loads(wrapper[k].as_py())), Digests(recurring[k].as_py() or ())
            found = [main_text(html, *(own.get(host) or (None, Digests()))) for html, host in zip(b.column("html").to_pylist(), hosts, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return arrow_map(joined, run, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars bigint")


def query(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
