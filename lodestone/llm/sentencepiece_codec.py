"""SentencePiece encoding and decoding by streaming Viterbi over the piece lattice.

A model file is read by a small parser of its own.  At every character
boundary the lattice keeps one survivor, a back-pointer to the begin of its
last piece:

* unigram models: the path with the highest sum of scores;
* BPE models: the path whose last two pieces merging would have left as they
  are.  Exactly one piece can end the merged form of each prefix, and whether
  two pieces may stand side by side is decided from the order of merges alone,
  so the survivor is the result of merging without doing any merges.

All paths stream through one lattice, a block of boundaries as long as the
longest piece at a time.  No back-pointer is longer, so only boundaries in a
window of that length can still be gone on from.  When the back-pointers from
all survivors in the window lead to one boundary, the ids before it are final:
they are committed, and what stands before that boundary is forgotten.

Where no piece spans the step from a letter to a space mark, every such step
is a boundary on which all paths converge, known without looking.  The
stretches between these steps repeat often; each different one is a lane, and
all lanes of a piece of text advance together as numpy arrays.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from .common import Cache, arrow_map, mix, pieces, table

#: Path of the model file on the driver; a parameter of every function.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = 0x2581
# Piece and model types of the file format.
NORMAL, UNKNOWN, BYTE = 1, 2, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of one message: integers, floats and byte strings."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 5:
            at += 4
            yield key >> 3, struct.unpack("<f", data[at - 4 : at])[0]
        elif kind == 1:
            at += 8
            yield key >> 3, data[at - 8 : at]
        else:
            size = varint()
            at += size
            yield key >> 3, data[at - size : at]


class Hashed:
    """Fixed map from positive 64-bit keys to integers, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.mask = np.int64((1 << bits) - 1)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):
            free = self.keys[slot[left]] == -1
            self.keys[slot[left[free]]] = keys[left[free]]
            lost = self.keys[slot[left]] != keys[left]
            placed = left[~lost]
            self.values[slot[placed]] = values[placed]
            left = left[lost]
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return mix(keys.astype(np.uint64)).astype(np.int64) & self.mask

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 for absent keys."""
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], -1)
        left = np.flatnonzero((found != keys) & (found != -1))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            found = self.keys[slot[left]]
            hit = found == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (found != -1)]
        return out


class Codec:
    """Encoder and decoder of one model."""

    def __init__(self, data: bytes):
        names, scores, kinds = [], [], []
        self.kind, dummy, extra, charsmap, fallback = UNIGRAM, True, True, b"", False
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                names.append(own.get(1, b"").decode())
                scores.append(own.get(2, 0.0))
                kinds.append(own.get(3, NORMAL))
            elif number == 2:
                own = dict(_fields(value))
                self.kind, fallback = own.get(3, UNIGRAM), bool(own.get(35, 0))
            elif number == 3:
                own = dict(_fields(value))
                charsmap, dummy, extra = own.get(2, b""), bool(own.get(3, 1)), bool(own.get(4, 1))
        if self.kind not in (UNIGRAM, BPE) or charsmap or extra or any(k not in (1, 2, 3, 5, 6) for k in kinds):
            raise NotImplementedError("only unigram and BPE models that leave the text as it is and define no symbols of their own")
        self.dummy = dummy
        self.unknown = kinds.index(UNKNOWN) if UNKNOWN in kinds else 0
        self.size = len(names)
        self.bytes = np.full(256, self.unknown, np.int32)
        self.byte_fallback = fallback
        for k, (name, kind) in enumerate(zip(names, kinds, strict=True)):
            if kind == BYTE:
                self.bytes[int(name[3:5], 16)] = k
        usable = {name: k for k, (name, kind) in enumerate(zip(names, kinds, strict=True)) if kind == NORMAL and name}
        self.longest = max(map(len, usable), default=1)
        self.spans = any(chr(SPACE) in name.lstrip(chr(SPACE)) for name in usable)
        if self.kind == BPE:
            self._merges(usable, scores)
        self.score = np.append(np.array(scores, np.float64), min(scores, default=0.0) - 10)  # last: a character outside the vocabulary
        self._trie(usable)
        surface = [bytes([int(name[3:5], 16)]) if kind == BYTE else name.replace(chr(SPACE), " ").encode() if kind == NORMAL else " ⁇ ".encode() if kind == UNKNOWN else b"" for name, kind in zip(names, kinds, strict=True)]
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_at = np.concatenate(([0], np.cumsum([len(s) for s in surface])))
        self.seen = Cache()

    def _merges(self, usable: dict[str, int], scores: list[float]) -> None:
        """For every piece its rank among merges (-1 for one character) and the two pieces it is merged from last."""
        n = self.size
        long = sorted((name for name in usable if len(name) > 1), key=lambda name: (-scores[usable[name]], usable[name]))
        rank = {name: k for k, name in enumerate(long)}
        self.rank = np.full(n + 1, -1, np.int64)
        self.left, self.right = np.arange(n + 1), np.arange(n + 1)
        keys, values, dead = [], [], []
        for name in long:
            k = usable[name]
            self.rank[k] = rank[name]
            parts = list(name)
            while len(parts) > 2:
                best = min(range(len(parts) - 1), key=lambda i: (rank.get(parts[i] + parts[i + 1], n), i))
                if rank.get(parts[best] + parts[best + 1], n) == n:
                    break
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            if len(parts) == 2 and all(p in usable for p in parts):
                self.left[k], self.right[k] = usable[parts[0]], usable[parts[1]]
            else:
                dead.append(name)  # merging never makes it
            for i in range(1, len(name)):
                if name[:i] in usable and name[i:] in usable:
                    keys.append(usable[name[:i]] * (n + 1) + usable[name[i:]])
                    values.append(rank[name])
        for name in dead:
            del usable[name]
        self.pairs = Hashed(np.array(keys, np.int64), np.array(values, np.int64))

    def _trie(self, usable: dict[str, int]) -> None:
        chars = sorted({c for name in usable for c in name})
        self.char = np.zeros(0x110000, np.int32)  # 0: in no piece
        self.char[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.chars = len(chars) + 1
        state, keys, values, ends = {"": 0}, [], [], {}
        for name, k in usable.items():
            for i in range(1, len(name) + 1):
                if name[:i] not in state:
                    state[name[:i]] = len(state)
                    keys.append(state[name[: i - 1]] * self.chars + int(self.char[ord(name[i - 1])]))
                    values.append(state[name[:i]])
            ends[state[name]] = k
        self.steps = Hashed(np.array(keys, np.int64), np.array(values, np.int64))
        self.ends = np.full(len(state), -1, np.int32)
        self.ends[list(ends)] = list(ends.values())

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves pieces ``a`` and ``b`` side by side (BPE)."""
        if "keys" not in self.seen:
            self.seen["keys"], self.seen["good"] = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)
        keys, good = self.seen["keys"], self.seen["good"]
        key = a.astype(np.int64) * (self.size + 1) + b
        slot = (mix(key.astype(np.uint64)) >> np.uint64(44)).astype(np.int64)
        out = good[slot]
        new = np.flatnonzero(keys[slot] != key)
        if len(new):
            out[new] = self._apart(a[new].astype(np.int64), b[new].astype(np.int64))
            keys[slot[new]] = key[new]
            mine = new[keys[slot[new]] == key[new]]  # of two new keys in one slot, the last stays
            good[slot[mine]] = out[mine]
        return out

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Undo the latest merge on either side of the seam again and again: no earlier merge may cross it."""
        out = np.zeros(len(a), bool)
        live, limit = np.arange(len(a)), np.full(len(a), 1 << 40, np.int64)
        while len(live):
            across = self.pairs.get(a * (self.size + 1) + b)
            ok = (across < 0) | (across >= limit)
            ra, rb = self.rank[a], self.rank[b]
            over = ok & (ra < 0) & (rb < 0)
            out[live[over]] = True
            go = ok & ~over
            live, a, b, ra, rb = live[go], a[go], b[go], ra[go], rb[go]
            later = ra > rb
            limit = np.where(later, ra, rb + 1)
            a, b = np.where(later, self.right[a], a), np.where(later, b, self.left[b])
        return out

    # --- the lattice --------------------------------------------------------

    def _edges(self, chars: np.ndarray, begin: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pieces (index into ``begin``, length, id) that start at the places ``begin``; ``room``: characters from there to the end of the stretch."""
        which, sizes, ids = [], [], []
        live = np.arange(len(begin))
        state = np.zeros(len(begin), np.int64)
        for depth in range(1, self.longest + 1):
            char = chars[begin[live] + depth - 1]
            state = self.steps.get(state * self.chars + char)
            good = (state >= 0) & (char > 0)
            live, state = live[good], state[good].astype(np.int64)
            piece = self.ends[state]
            hit = piece >= 0
            which.append(live[hit])
            sizes.append(np.full(hit.sum(), depth))
            ids.append(piece[hit])
            more = room[live] > depth
            live, state = live[more], state[more]
            if not len(live):
                break
        alone = np.flatnonzero(chars[begin] == 0)  # characters outside the vocabulary
        which.append(alone)
        sizes.append(np.ones(len(alone), np.int64))
        ids.append(np.full(len(alone), self.size))
        return np.concatenate(which), np.concatenate(sizes), np.concatenate(ids).astype(np.int64)

    def _stream(self, chars: np.ndarray, lo: np.ndarray, size: np.ndarray, held: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many stretches of ``chars``, one after another, and their numbers.

        ``held`` gets the number of boundaries that are kept after each block.
        """
        step = self.longest
        lane = np.arange(len(lo))  # stretches that have not ended
        base = now = 0  # boundary in the first column, and the next to go on from: the same in all lanes
        done = np.zeros(len(lo), np.int64)  # boundary up to which ids are committed
        last = np.full((len(lo), 1), -1, np.int64)
        back = np.zeros((len(lo), 1), np.int64)
        best = np.zeros((len(lo), 1))
        owner, places, found = [], [], []

        def commit(rows: np.ndarray, end: np.ndarray) -> None:
            """Ids of the paths that lead to ``end``; the rest of the window is untouched."""
            begin = done[rows].copy()
            done[rows] = end
            more = end > begin
            while more.any():
                rows, begin, end = rows[more], begin[more], end[more]
                owner.append(lane[rows])
                places.append(end)
                found.append(last[rows, end - base])
                end = back[rows, end - base]
                more = end > begin

        while len(lane):
            wide = now + 2 * step - base + 1 - last.shape[1]  # boundaries that this block can reach
            last = np.pad(last, ((0, 0), (0, wide)), constant_values=-1)
            back = np.pad(back, ((0, 0), (0, wide)))
            best = np.pad(best, ((0, 0), (0, wide)), constant_values=-np.inf)
            count = np.minimum(step, size[lane] - now)
            row = np.repeat(np.arange(len(lane)), count)
            offset = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + now
            which, length, piece = self._edges(chars, lo[lane][row] + offset, size[lane][row] - offset)
            order = np.argsort(offset[which], kind="stable")
            row, offset, length, piece = row[which][order], offset[which][order], length[order], piece[order]
            cut = np.searchsorted(offset, np.arange(now, now + step + 1))
            for k in range(step):  # all pieces from one boundary
                part = slice(cut[k], cut[k + 1])
                r, p, b = row[part], piece[part], now + k
                if not len(r):
                    continue
                e = b + length[part] - base
                before = last[r, b - base]
                if self.kind == BPE:
                    ok = last[r, e] < 0
                    if b:
                        ok &= before >= 0
                        ask = np.flatnonzero(ok)
                        ok[ask] = self.apart(before[ask], p[ask])
                else:
                    total = best[r, b - base] + self.score[p]
                    ok = total > best[r, e]
                    best[r[ok], e[ok]] = total[ok]
                r, e = r[ok], e[ok]
                last[r, e], back[r, e] = p[ok], b
            now += step
            ended = size[lane] <= now
            commit(np.flatnonzero(ended), size[lane][ended])
            stay = np.flatnonzero(~ended)
            lane, done, last, back, best = lane[stay], done[stay], last[stay], back[stay], best[stay]
            if len(lane):
                commit(np.arange(len(lane)), self._shared(last, back, now - base, base))
                drop = int(done.min()) - base
                last, back, best, base = last[:, drop:], back[:, drop:], best[:, drop:], base + drop
                if held is not None:
                    held.append(last.shape[1])
        owner, places, found = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (owner, places, found))
        order = np.lexsort((places, owner))
        return found[order], np.bincount(owner, minlength=len(lo))

    @staticmethod
    def _shared(last: np.ndarray, back: np.ndarray, now: int, base: int) -> np.ndarray:
        """The last boundary that the paths to all survivors from column ``now`` on have in common."""
        marked = last >= 0
        marked[:, :now] = False
        left = marked.sum(axis=1)
        for column in range(last.shape[1] - 1, -1, -1):  # the farthest path goes back one piece, until one boundary is left
            rows = np.flatnonzero(marked[:, column] & (left > 1))
            marked[rows, column] = False
            to = back[rows, column] - base
            left[rows] -= marked[rows, to]
            marked[rows, to] = True
        return marked.argmax(axis=1) + base

    def _fallback(self, ids: np.ndarray, count: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Put bytes (or the unknown id) for characters outside the vocabulary; ``points`` are those characters in order."""
        odd = np.flatnonzero(ids == self.size)
        if not len(odd):
            return ids, count
        if not self.byte_fallback:
            ids = ids.copy()
            ids[odd] = self.unknown
            return ids, count
        raw = [chr(c).encode("utf-8", "surrogatepass") for c in points.tolist()]
        times = np.ones(len(ids), np.int64)
        times[odd] = [len(r) for r in raw]
        out = np.repeat(ids, times)
        out[out == self.size] = self.bytes[np.frombuffer(b"".join(raw), np.uint8)]
        edge = np.concatenate(([0], np.cumsum(count)))
        total = np.concatenate(([0], np.cumsum(times)))
        return out, total[edge[1:]] - total[edge[:-1]]

    def encode(self, buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many documents (UTF-8 bytes and offsets), one after another, and their numbers."""
        n = len(at) - 1
        points = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
        lead = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
        size = lead[at[1:]] - lead[at[:-1]]
        points = np.where(points == 32, SPACE, points)
        if self.dummy:
            points = np.insert(points, lead[at[:-1]][size > 0], SPACE)
            size = size + (size > 0)
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        edge = np.zeros(len(points) + 1, bool)
        edge[np.cumsum(size) - size] = True
        if not self.spans:
            mark = points == SPACE
            edge[1:-1] |= mark[1:] & ~mark[:-1]
        edge[-1] = True
        cut = np.flatnonzero(edge)
        lo, length = cut[:-1], np.diff(cut)
        # Stretches that repeat are run once.
        h = np.zeros(len(points) + 1, np.uint64)
        power = _powers(len(points) + 1)
        np.cumsum(mix(points.astype(np.uint64)) * power[0][: len(points)], out=h[1:])
        key = mix((h[lo + length] - h[lo]) * power[1][lo] + length.astype(np.uint64))
        _, one, number = np.unique(key, return_index=True, return_inverse=True)
        own = points[_ranges(lo[one], length[one])]
        chars = self.char[np.minimum(own, 0x10FFFF)]
        ids, count = self._stream(chars, np.cumsum(length[one]) - length[one], length[one])
        ids, count = self._fallback(ids, count, own[chars == 0])
        begin = np.cumsum(count) - count
        out = ids[_ranges(begin[number], count[number])].astype(np.int32)
        doc = np.searchsorted(np.cumsum(size), lo, "right")
        return out, np.bincount(doc, weights=count[number], minlength=n)[:n].astype(np.int64)

    def decode(self, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of many id sequences and the offsets of each."""
        size = self.surface_at[ids + 1] - self.surface_at[ids]
        buf = self.surface[_ranges(self.surface_at[ids], size)]
        total = np.concatenate(([0], np.cumsum(size)))
        edge = np.concatenate(([0], np.cumsum(count)))
        at = total[edge]
        if self.dummy:  # the mark put before the text
            filled = at[1:] > at[:-1]
            first = at[:-1][filled]
            drop = np.zeros(len(buf) + 1, np.int64)
            drop[first[buf[first] == 32]] = 1
            gone = np.concatenate(([0], np.cumsum(drop[:-1])))
            buf, at = buf[drop[:-1] == 0], at - gone[at]
        return buf, at


_kept = Cache()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_kept.get("up", ())) < n:
        base = 0x9E3779B97F4A7C15
        up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _kept["up"], _kept["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _kept["up"], _kept["down"]


def _ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.repeat(begin - np.cumsum(count) + count, count) + np.arange(int(count.sum()))


def load(path: str = MODEL) -> Codec:
    """The codec of a model file on the driver; its tables (a few MB) travel with the tasks."""
    with open(path, "rb") as f:
        return Codec(f.read())


def _equal(buf: np.ndarray, at: np.ndarray, other: np.ndarray, other_at: np.ndarray) -> np.ndarray:
    """Whether each text equals its counterpart."""
    if len(buf) == len(other) and (at == other_at).all() and (buf == other).all():
        return np.ones(len(at) - 1, bool)
    return np.array([buf[a:b].tobytes() == other[c:d].tobytes() for a, b, c, d in zip(at[:-1], at[1:], other_at[:-1], other_at[1:], strict=True)], bool)


def encode(docs: DataFrame, codec: Codec | None = None, text: str = "text", ids: str = "ids", exact: str = "exact") -> DataFrame:
    """``docs`` with two more columns: the ids of the whole text, and whether they decode to exactly that text.

    Null and empty texts have no ids and decode to the empty text.  Decoding
    is inexact only for texts that hold the space mark itself (U+2581) or,
    without byte pieces, characters outside the vocabulary.  Columns of the
    same names are replaced; all others stay.
    """
    codec = codec or load()
    fields = [f for f in docs.schema.fields if f.name not in (ids, exact)]
    at_text = [f.name for f in fields].index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for rows, buf, at in pieces(iter([pa.RecordBatch.from_arrays([batch.column(at_text)], names=["text"])])):
                flat, count = codec.encode(buf, at)
                same = _equal(buf, at, *codec.decode(flat, count))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32)), pa.array(flat, pa.int32()))
                part = batch.slice(done, rows.num_rows)
                done += rows.num_rows
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(same)], names=[*part.schema.names, ids, exact])

    schema = T.StructType([*fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(exact, T.BooleanType())])
    return arrow_map(docs.select(*[docs[f"`{f.name}`"] for f in fields]), run, schema)


def decode(tokens: DataFrame, codec: Codec | None = None, ids: str = "ids", text: str = "text") -> DataFrame:
    """``tokens`` with the text that its ids stand for; null ids give null, ids outside the vocabulary raise an error."""
    codec = codec or load()
    fields = [f for f in tokens.schema.fields if f.name != text]
    at_ids = [f.name for f in fields].index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at_ids)
            count = np.array([0 if x is None else x for x in pc.list_value_length(column).to_pylist()], np.int64)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            buf, at = codec.decode(flat, count)
            texts = [None if missing else buf[a:b].tobytes().decode("utf-8", "replace") for a, b, missing in zip(at[:-1], at[1:], column.is_null().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text])

    return arrow_map(tokens.select(*[tokens[f"`{f.name}`"] for f in fields]), run, T.StructType([*fields, T.StructField(text, T.StringType())]))


def digest(docs: DataFrame, codec: Codec | None = None) -> DataFrame:
    """doc_id, n_ids, ids_sha256 (of the ids as little-endian 32-bit integers) and exact, one row for each row of ``docs``."""
    codec = codec or load()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, at in pieces(batches):
            flat, count = codec.encode(buf, at)
            same = _equal(buf, at, *codec.decode(flat, count))
            edge = np.concatenate(([0], np.cumsum(count)))
            shas = [hashlib.sha256(flat[a:b].astype("<i4").tobytes()).hexdigest() for a, b in zip(edge[:-1], edge[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(count, pa.int64()), pa.array(shas, pa.string()), pa.array(same)], names=["doc_id", "n_ids", "ids_sha256", "exact"])

    return arrow_map(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id bigint, n_ids bigint, ids_sha256 string, exact boolean")


def query(spark, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
