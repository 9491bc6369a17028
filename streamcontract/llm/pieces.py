"""SentencePiece encoding and decoding: a parallel max-plus scan, under a unigram model.

The best segmentation of a text is a max-plus product. A boundary inside a text has
one state for each number of characters by which a piece may reach over it. A chunk's
transfer matrix holds, for each pair of states at its two ends, the best score of the
pieces between. Texts over `CHUNK` characters are cut into chunks, rows of their own:

 1. each chunk's matrix is computed by itself;
 2. matrices are multiplied in groups of `FAN`, and the products again, until one is
    left for a text (products are associative); from there back down each group learns
    the states at its ends and finds those between;
 3. each chunk is traced back by itself between its two places, and the pieces are joined.

A text of one chunk is only traced. Inside a chunk places that no piece of the
vocabulary can reach over (no piece has the two characters next to each other) part it
into cells; equal cells are solved once, all different cells of a run side by side.
Ties go to the longer last piece, as in the library; where several best paths cross a
chunk's end, the one with the least overhang is taken, with the library's score.

The model is a file for the library. A unigram file is taken as it is. A BPE file has
ranks for scores, and merges by rank are not a best path; its vocabulary is taken as a
unigram model by Zipf's law: the piece of rank r scores -ln(1 + r), to a thirty-second.
So sums are exact in the library's single precision too, and the library, given
`unigram_proto`, is the measure of every result. Nothing is trained. Ids are not those
of BPE merges.

Cases: null and empty texts have no pieces and decode to the empty text; repeated rows
give repeated results, long repeated texts are encoded once; an empty table gives an
empty result; unknown characters become byte pieces (or one unknown piece a run, if
the model has none), and `round_trip` tells whether decoding gave the text back.
Extra columns do not matter.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamcontract.llm.common import mix, once, prepare, runs, stored, table

CHUNK, FAN = 1 << 15, 64
RUN_CHARS = 1 << 18
NEVER = -1e30
STEP = 32  # scores by rank are multiples of 1 / STEP
BPE, UNIGRAM = 2, 1

# ---------------------------------------------------------------- model files


def _varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        out |= (data[at] & 127) << shift
        shift += 7
        at += 1
        if data[at - 1] < 128:
            return out, at


def _fields(data: bytes) -> Iterator[tuple[int, int, int, int]]:
    """Number, start of the field, start and end of its value, for each field of a message."""
    at = 0
    while at < len(data):
        start = at
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 2:
            size, at = _varint(data, at)
        elif kind == 0:
            size = _varint(data, at)[1] - at
        else:
            size = {1: 8, 5: 4}[kind]
        yield tag >> 3, start, at, at + size
        at += size


def _block(number: int, body: bytes) -> bytes:
    out, n = bytes([number << 3 | 2]), len(body)
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n]) + body


def unigram_proto(data: bytes) -> bytes:
    """The model file as a unigram model: unchanged if it is one, with scores by rank if it is BPE."""
    parts = [(k, data[s:e], data[v:e]) for k, s, v, e in _fields(data)]
    spec = next((body for k, _, body in parts if k == 2), b"")
    kinds = [(v, e) for k, _, v, e in _fields(spec) if k == 3]
    kind = _varint(spec, kinds[-1][0])[0] if kinds else UNIGRAM
    if kind == UNIGRAM:
        return data
    if kind != BPE:
        raise ValueError("the model is neither unigram nor BPE")
    entries = [{k: body[v:e] for k, _, v, e in _fields(body)} for n, _, body in parts if n == 1]
    normal = [i for i, x in enumerate(entries) if _varint(x.get(3, b"\x01"), 0)[0] == 1]
    score = {i: struct.unpack("<f", entries[i].get(2, b"\0\0\0\0"))[0] for i in normal}
    by_rank = {i: -round(STEP * math.log(1 + r)) / STEP for r, i in enumerate(sorted(normal, key=lambda i: (-score[i], i)), 1)}
    out, i = [], 0
    for k, whole, body in parts:
        if k == 1:
            if i in by_rank:
                kept = b"".join(body[s:e] for n, s, _, e in _fields(body) if n != 2)
                whole = _block(1, kept + b"\x15" + struct.pack("<f", by_rank[i]))
            i += 1
        elif k == 2:
            whole = _block(2, b"".join(body[s:e] for n, s, _, e in _fields(body) if n != 3) + bytes([3 << 3, UNIGRAM]))
        out.append(whole)
    return b"".join(out)


# ---------------------------------------------------------------- lattice


class _Table:
    """Values of 64-bit keys, by open addressing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.mask = np.int64((1 << max(4, (4 * len(keys)).bit_length())) - 1)
        self.keys, self.values = np.full(int(self.mask) + 1, -1, np.int64), np.zeros(int(self.mask) + 1, np.int32)
        todo, at = np.arange(len(keys)), self._place(keys)
        while len(todo):
            free = self.keys[at] < 0
            _, one = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[one]
            self.keys[at[put]], self.values[at[put]] = keys[todo[put]], values[todo[put]]
            rest = np.ones(len(todo), bool)
            rest[put] = False
            todo, at = todo[rest], (at[rest] + 1) & self.mask

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return mix(keys.view(np.uint64)).view(np.int64) & self.mask

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Their values, 0 for the others."""
        at = self._place(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], 0)
        todo = np.flatnonzero((there != keys) & (there >= 0))
        at = at[todo]
        while len(todo):
            at = (at + 1) & self.mask
            there = self.keys[at]
            same = there == keys[todo]
            out[todo[same]] = self.values[at[same]]
            on = ~same & (there >= 0)
            todo, at = todo[on], at[on]
        return out


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a[:, :, None] + b[None]).max(1), NEVER)


class Unigram:
    """A unigram model over normalised text, as code points."""

    def __init__(self, proto: bytes) -> None:
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.score = np.array([sp.get_score(i) for i in range(n)], np.float64)
        self.unk = sp.unk_id()
        self.score[self.unk] = min((self.score[i] for i in plain), default=0.0) - 10.0
        self.reach = max([1, *(len(names[i]) for i in plain)])
        # characters by number, 0 for those in no piece
        chars = sorted({ord(c) for i in plain for c in names[i]})
        self.char = np.zeros(0x110000, np.int32)
        self.char[chars] = np.arange(1, len(chars) + 1)
        self.width = len(chars) + 1
        # neighbours that some piece has: no other place between two characters can be reached over
        self.linked = np.zeros(self.width * self.width, bool)
        nodes: dict[tuple[int, int], int] = {}
        ids = [-1]
        for i in plain:
            at, before = 0, 0
            for c in self.char[[ord(x) for x in names[i]]].tolist():
                if at:
                    self.linked[before * self.width + c] = True
                if (at, c) not in nodes:
                    nodes[at, c] = len(ids)
                    ids.append(-1)
                at, before = nodes[at, c], c
            ids[at] = i
        self.ids = np.array(ids)
        keys = np.array(list(nodes), np.int64).reshape(-1, 2)
        self.step = _Table(keys[:, 0] * self.width + keys[:, 1], np.array(list(nodes.values()), np.int32))
        self.byte = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32) if sp.is_byte(sp.piece_to_id("<0x00>")) else None
        # what each id decodes to: marks are spaces
        body = [b"" if sp.is_control(i) else bytes([int(x[3:5], 16)]) if sp.is_byte(i) else " ⁇ ".encode() if i == self.unk else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        self.body = np.frombuffer(b"".join(body), np.uint8)
        self.size = np.array([len(x) for x in body], np.int64)
        self.first = np.cumsum(self.size) - self.size

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Code points of the normalised texts, one after the other, and offsets."""
        normal = [self.sp.normalize(t) for t in texts]
        return points(normal)

    def edges(self, x: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and id of all pieces inside x that end at or before their start's stop."""
        c = self.char[x].astype(np.int64)
        at, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        single = np.zeros(len(x), bool)
        starts, ends, found = [], [], []
        for n in range(1, self.reach + 1):
            node = self.step.get(node * self.width + c[at + n - 1]).astype(np.int64)
            on = node > 0
            at, node = at[on], node[on]
            if not len(at):
                break
            ids = self.ids[node]
            hit = ids >= 0
            starts.append(at[hit])
            ends.append(at[hit] + n)
            found.append(ids[hit])
            if n == 1:
                single[at[hit]] = True
            on = at + n < stop[at]
            at, node = at[on], node[on]
        other = np.flatnonzero(~single)
        return np.concatenate([*starts, other]), np.concatenate([*ends, other + 1]), np.concatenate([*found, np.full(len(other), self.unk)])

    def cells(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Offsets of the cells of texts: at their ends and wherever no piece reaches over."""
        c = self.char[x].astype(np.int64)
        cut = np.ones(len(x) + 1, bool)
        cut[1:-1] = ~self.linked[c[:-1] * self.width + c[1:]]
        cut[at] = True
        return np.flatnonzero(cut)

    def solve(self, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best pieces of each cell of x (none empty): ids, how many a cell, scores. All cells are worked on side by side."""
        first, size = at[:-1], np.diff(at)
        stop = np.repeat(at[1:], size)
        start, end, ids = self.edges(x, stop)
        offset = start - np.repeat(first, size)[start]
        longest = int(size.max(initial=0))
        order = np.argsort(offset.astype(np.uint16) if longest < 1 << 16 else offset, kind="stable")
        start, end, ids = start[order], end[order], ids[order]
        score = self.score[ids]
        # place p of cell k stands at p + k: each cell has a place more than characters
        number = np.repeat(np.arange(len(size)), size)
        shift = number[start]
        source, target = start + shift, end + shift
        best = np.full(len(x) + len(size), NEVER)
        best[first + np.arange(len(size))] = 0.0
        back, piece = np.zeros(len(best), np.int64), np.zeros(len(best), np.int32)
        ends = np.cumsum(np.bincount(offset, minlength=longest))
        lo = 0
        for hi in ends.tolist():
            s, t = source[lo:hi], target[lo:hi]
            new = best[s] + score[lo:hi]
            better = new > best[t]
            t = t[better]
            best[t], back[t], piece[t] = new[better], s[better], ids[lo:hi][better]
            lo = hi
        base, place = first + np.arange(len(size)), at[1:] + np.arange(len(size))
        total = best[place]
        cells, found = [], []
        live = np.arange(len(size))
        while len(live):
            cells.append(live)
            found.append(piece[place])
            place = back[place]
            on = place > base[live]
            live, place = live[on], place[on]
        count = np.bincount(np.concatenate(cells), minlength=len(size)) if cells else np.zeros(0, np.int64)
        out, after = np.zeros(int(count.sum()), np.int32), np.cumsum(count)
        for t, (cell, ids) in enumerate(zip(cells, found, strict=True)):
            out[after[cell] - 1 - t] = ids
        return out, count, total

    def encode(self, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of texts (code points, offsets), how many each has, and scores."""
        n = len(at) - 1
        cuts = self.cells(x, at) if len(x) else np.zeros(1, np.int64)
        first, size = cuts[:-1], np.diff(cuts)
        h = _hashes(x, first, size)
        _, one, which = np.unique(h, return_index=True, return_inverse=True)
        lengths = size[one]
        inner = np.concatenate([[0], np.cumsum(lengths)])
        different = x[np.repeat(first[one] - inner[:-1], lengths) + np.arange(inner[-1])]
        ids, count, score = self.solve(different, inner)
        if self.byte is not None:
            ids, count = self._bytes(ids, count, different, inner, lengths)
        begin = np.cumsum(count) - count
        each = count[which]
        out = ids[np.repeat(begin[which] - (np.cumsum(each) - each), each) + np.arange(each.sum())]
        text = np.searchsorted(at, first, "right") - 1
        sizes = np.bincount(text, weights=each, minlength=n).astype(np.int64)
        if self.byte is None:  # a run of unknown characters is one piece
            owner = np.repeat(np.arange(n), sizes)
            again = np.zeros(len(out), bool)
            again[1:] = (out[1:] == self.unk) & (out[:-1] == self.unk) & (owner[1:] == owner[:-1])
            out, sizes = out[~again], np.bincount(owner[~again], minlength=n)
        return out.astype(np.int32), sizes, np.bincount(text, weights=score[which], minlength=n)

    def _bytes(self, ids: np.ndarray, count: np.ndarray, x: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unknown characters as their bytes. One stands between places that no piece reaches over unless a longer piece has it."""
        unknown = np.flatnonzero(ids == self.unk)
        if not len(unknown):
            return ids, count
        cell = np.repeat(np.arange(len(count)), count)
        chars = np.where(ids == self.unk, 1, self.chars[ids])
        place = np.cumsum(chars) - chars
        begin = np.cumsum(count) - count
        place += (at[:-1] - place[np.minimum(begin, len(place) - 1)])[cell]
        body = [chr(c).encode("utf-8", "replace") for c in x[place[unknown]].tolist()]
        n = np.ones(len(ids), np.int64)
        n[unknown] = [len(b) for b in body]
        out = np.repeat(ids, n)
        out[np.repeat(ids == self.unk, n)] = self.byte[np.frombuffer(b"".join(body), np.uint8)]
        return out, np.bincount(np.repeat(cell, n), minlength=len(count))

    @property
    def chars(self) -> np.ndarray:
        if not hasattr(self, "_chars"):
            self._chars = np.array([len(self.sp.id_to_piece(i)) for i in range(self.sp.get_piece_size())])
        return self._chars

    def transfer(self, x: np.ndarray, m: int) -> np.ndarray:
        """Best score from state i (x[i] is the first character not yet covered) to state j after x[:m]; what of x lies beyond m is only reached over."""
        r = self.reach
        out = np.full((r, r), NEVER)
        cuts = self.cells(x, np.array([0, len(x)]))
        stop = np.repeat(cuts[1:], np.diff(cuts))
        inner = cuts[(cuts > 0) & (cuts <= m)]
        if len(inner):
            # through a place that nothing reaches over: from the states to the first such place, and from the last one on
            a, b = int(inner[0]), int(inner[-1])
            head, tail = np.full(r, NEVER), np.full(r, NEVER)
            back = self._plain(x[:a], stop[:a], a, reverse=True)
            head[: min(r, a + 1)] = back[: min(r, a + 1)]
            front = self._plain(x[b:], stop[b:] - b, m - b)
            k = min(r, len(front) - (m - b))
            tail[:k] = front[m - b : m - b + k]
            middle = self.solve(x[a:b], inner - a)[2].sum() if b > a else 0.0
            return np.maximum(head[:, None] + middle + tail[None], NEVER)
        start, end, ids = self.edges(x, stop)
        order = np.argsort(start, kind="stable")
        start, end, score = start[order].tolist(), end[order].tolist(), self.score[ids[order]].tolist()
        best = np.full((len(x) + 1, r), NEVER)
        k = np.arange(min(r, m + 1))
        best[k, k] = 0.0
        for s, e, v in zip(start, end, score, strict=True):
            if s < m:
                np.maximum(best[e], best[s] + v, out=best[e])
        k = min(r, len(x) + 1 - m)
        out[:, :k] = best[m : m + k].T
        return np.maximum(out, NEVER)

    def _plain(self, x: np.ndarray, stop: np.ndarray, m: int, reverse: bool = False) -> np.ndarray:
        """Best scores by place: from place 0, over pieces that begin before m; reverse: to the end."""
        start, end, ids = self.edges(x, stop)
        order = np.argsort(start, kind="stable")
        start, end, score = start[order].tolist(), end[order].tolist(), self.score[ids[order]].tolist()
        best = [NEVER] * (len(x) + 1)
        best[-1 if reverse else 0] = 0.0
        if reverse:
            for s, e, v in zip(reversed(start), reversed(end), reversed(score), strict=True):
                best[s] = max(best[s], best[e] + v)
        else:
            for s, e, v in zip(start, end, score, strict=True):
                if s < m:
                    best[e] = max(best[e], best[s] + v)
        return np.maximum(best, NEVER)

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """Texts of runs of ids, without the mark put in front."""
        n = self.size[ids]
        at = np.concatenate([[0], np.cumsum(n)])
        data = self.body[np.repeat(self.first[ids] - at[:-1], n) + np.arange(at[-1])].tobytes()
        ends = at[np.cumsum(sizes)].tolist()
        begins = [0, *ends[:-1]]
        out = [data[a + 1 : b] if data[a : a + 1] == b" " and b > a else data[a:b] for a, b in zip(begins, ends, strict=True)]
        return [x.decode("utf-8", "replace").encode() for x in out]


def points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def _hashes(x: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of ranges of x."""
    base = 0x9E3779B97F4A7C15
    n = len(x) + 1
    power, inverse = (np.concatenate([[np.uint64(1)], np.full(n - 1, b, np.uint64)]).cumprod(dtype=np.uint64) for b in (base, pow(base, -1, 1 << 64)))
    cum = np.concatenate([np.zeros(1, np.uint64), np.cumsum((x.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64)])
    return mix((cum[first + size] - cum[first]) * inverse[first] + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


# ---------------------------------------------------------------- on tables

ENCODED = "n_pieces long, ids_crc32 long, decoded_crc32 long, round_trip boolean, ids array<int>"
NAMES = [x.split(" ")[0] for x in ENCODED.split(", ")]


def _encoded(ids: np.ndarray, sizes: np.ndarray, back: list[bytes], same: list[bool]) -> list[pa.Array]:
    at = np.concatenate([[0], np.cumsum(sizes)])
    body = ids.astype("<i4")
    return [pa.array(sizes), pa.array([zlib.crc32(body[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.int64()), pa.array([zlib.crc32(t) for t in back], pa.int64()), pa.array(same, pa.bool_()), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(body))]


def _short(rows: DataFrame, proto: object) -> DataFrame:
    """Texts of one chunk."""

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = once(proto, Unigram)
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            size = np.cumsum([len(t) for t in texts])
            cuts = np.unique(np.searchsorted(size, np.arange(0, int(size[-1]) if len(size) else 0, RUN_CHARS), "left")) if len(texts) else []
            for lo, hi in zip(cuts, [*cuts[1:], len(texts)], strict=True):
                some = texts[lo:hi]
                ids, sizes, _ = u.encode(*u.codes(some))
                back = u.decode(ids, sizes)
                yield pa.record_batch([b.column(0).slice(lo, hi - lo), *_encoded(ids, sizes, back, [x == t.encode("utf-8", "replace") for x, t in zip(back, some, strict=True)])], ["doc_id", *NAMES])

    return rows.mapInArrow(encode, f"doc_id long, {ENCODED}")


def chunks(rows: DataFrame, proto: object, chunk: int) -> DataFrame:
    """key, k, n, m, part: the chunks of each different text (key: its SHA-256): m characters and those that pieces can reach over."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = once(proto, Unigram)
        for b in batches:
            for key, text in zip(b.column(0), b.column(1), strict=True):
                t = u.sp.normalize(text.as_py())
                n = max(1, len(t) // max(chunk, u.reach))
                at = [len(t) * i // n for i in range(n + 1)]
                for lo in range(0, n, 256):
                    some = range(lo, min(lo + 256, n))
                    yield pa.record_batch([pa.array([key.as_py()] * len(some)), pa.array(some, pa.int32()), pa.array([n] * len(some), pa.int32()), pa.array([at[k + 1] - at[k] for k in some], pa.int32()), pa.array([t[at[k] : at[k + 1] + u.reach - 1] for k in some], pa.string())], ["key", "k", "n", "m", "part"])

    return rows.select("key", "text").mapInArrow(cut, "key string, k int, n int, m int, part string").groupBy("key", "k").agg(F.first("n").alias("n"), F.first("m").alias("m"), F.first("part").alias("part"))


def transfers(parts: DataFrame, proto: object) -> DataFrame:
    """key, k, matrix of each chunk."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = once(proto, Unigram)
        for b in batches:
            found = [u.transfer(points([p])[0], m).tobytes() for m, p in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(found, pa.binary())], ["key", "k", "matrix"])

    return parts.select("key", "k", "m", "part").mapInArrow(of, "key string, k int, matrix binary")


def _matrices(t: pa.Table) -> list[np.ndarray]:
    out = [np.frombuffer(x.as_buffer()) for x in t.sort_by("k")["matrix"].combine_chunks()]
    r = math.isqrt(len(out[0]))
    return [x.reshape(r, r) for x in out]


def upwards(level: DataFrame) -> DataFrame:
    """Products of each FAN matrices in a row."""

    def product(t: pa.Table) -> pa.Table:
        out, *rest = _matrices(t)
        for m in rest:
            out = max_plus(out, m)
        return pa.table({"key": t["key"][:1], "k": pa.array([t["k"][0].as_py() // FAN], pa.int32()), "matrix": pa.array([out.tobytes()], pa.binary())})

    return level.groupBy("key", F.floor(F.col("k") / FAN)).applyInArrow(product, "key string, k int, matrix binary")


def downwards(level: DataFrame, ends: DataFrame) -> DataFrame:
    """key, k and the states before and after each matrix of a level; ends: those of the groups of FAN."""

    def split(t: pa.Table) -> pa.Table:
        ms, (first, last) = _matrices(t), (t[c][0].as_py() for c in ("before", "after"))
        after = [ms[-1][:, last]] if len(ms) > 1 else []  # best score from each state in front of a matrix to the group's end
        for m in ms[-2:0:-1]:
            after.append((m + after[-1]).max(1))
        states = [first]
        for m, v in zip(ms[:-1], after[::-1], strict=True):
            states.append(int((m[states[-1]] + v).argmax()))
        return pa.table({"key": t["key"], "k": t["k"].combine_chunks().sort(), "before": pa.array(states, pa.int32()), "after": pa.array([*states[1:], last], pa.int32())})

    up = ends.select("key", F.col("k").alias("up"), "before", "after")
    return level.withColumn("up", F.floor(F.col("k") / FAN).cast("int")).join(up, ["key", "up"]).groupBy("key", "up").applyInArrow(split, "key string, k int, before int, after int")


def trace(u: Unigram, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, k, ids of chunks (key, k, m, part, before, after), about RUN_CHARS characters at a time however many a batch holds."""
    for b in batches:
        m, before, after = (b.column(i).to_numpy() for i in (2, 4, 5))
        for lo, hi in runs(np.concatenate([[0], np.cumsum(m)]), RUN_CHARS):
            at = slice(lo, hi)
            parts = b.column(3).slice(lo, hi - lo).to_pylist()
            ids, sizes, _ = u.encode(*points([p[i : k + j] for k, p, i, j in zip(m[at].tolist(), parts, before[at].tolist(), after[at].tolist(), strict=True)]))
            yield pa.record_batch([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(ids))], ["key", "k", "ids"])


def _long(rows: DataFrame, proto: object, chunk: int) -> DataFrame:
    """Texts of several chunks, by the scan."""
    rows = rows.withColumn("key", F.sha2("text", 256))
    parts = stored(chunks(rows, proto, chunk))
    levels, n = [stored(transfers(parts, proto))], parts.agg(F.max("n")).first()[0] or 1
    while n > 1:
        levels.append(stored(upwards(levels[-1])))
        n = -(-n // FAN)
    states = levels[-1].select("key", "k", F.lit(0).alias("before"), F.lit(0).alias("after"))
    for level in levels[-2::-1]:
        states = downwards(level, states)

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = once(proto, Unigram)
        for b in batches:
            for key, x in zip(b.column(0), b.column(1), strict=True):
                ids = x.values.to_numpy()
                if u.byte is None:
                    ids = ids[np.append(True, (ids[1:] != u.unk) | (ids[:-1] != u.unk))]
                sizes = np.array([len(ids)])
                back = u.decode(ids, sizes)
                yield pa.record_batch([pa.array([key.as_py()]), *_encoded(ids, sizes, back, [hashlib.sha256(back[0]).hexdigest() == key.as_py()])], ["key", *NAMES])

    traced = parts.select("key", "k", "m", "part").join(states, ["key", "k"]).select("key", "k", "m", "part", "before", "after").mapInArrow(lambda batches: trace(once(proto, Unigram), batches), "key string, k int, ids array<int>")
    # one text's pieces meet: no more than a row of the result holds
    whole = traced.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"))
    return rows.select("doc_id", "key").join(whole.mapInArrow(decode, f"key string, {ENCODED}"), "key").select("doc_id", *NAMES)


def pieces(docs: DataFrame, model: bytes, *, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of the ids as 32-bit little-endian integers), decoded_crc32, round_trip, ids of every row's text; model: a model file's bytes."""
    spark = prepare(docs.sparkSession)
    proto = spark.sparkContext.broadcast(unigram_proto(model))  # a vocabulary
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    long = F.coalesce(F.length("text"), F.lit(0)) > chunk
    return _short(rows.where(~long), proto).unionByName(_long(rows.where(long), proto, chunk))


def public_model() -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(table(spark, sf_dir, "documents"), public_model())
