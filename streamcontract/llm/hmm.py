"""Hidden Markov language model: counts of Baum-Welch over all training texts, exact likelihood of every text.

Tokens are the words of a text, A-Z lower-cased, then one end. A token emits in
two steps: a hidden state emits a symbol, the symbol emits the word. Symbols are
the end, the `FREQUENT` most frequent words one each, and `CLASSES` classes of the
other words by their first and last letters, so what is broadcast is bounded
whatever the vocabulary. Inside a class a word has its share of the class's training
count, and words without a training count are one type whose share is that of the
class's words seen once. The counts of all words, however many, are gathered and used.

Each round of Baum-Welch runs over all training texts as wholes: tasks add up
expected transition and emission counts of their partition (at most states x symbols)
and the sums meet per symbol. A text is cut into segments that are worked on side by
side; the product of a segment's matrices (its operator) carries the state over its
ends, so counts and likelihoods are those of the whole text.

Steps: word counts of the training texts, added up by word; the texts as numbers of
symbols, written once (rows of about 4 MB of text, without a shuffle); the rounds; a
scoring pass. Words of a class meet their counts by a join of (text, word) with the
counts, summed up by text. Words are known by 64-bit hashes, the 64-bit number of a
row of symbols is drawn when it is written. Texts over `SLICE` bytes are cut at white
space into rows of their own; their operators are combined by text and what comes
in from both sides goes back to the slices by a join.

Cases: null and empty texts are one token, the end; a null id has remainder 0;
repeated rows are scored, and learned from, each; without training rows all words
are unknown and the emissions are uniform; an empty table gives an empty result;
extra columns do not matter.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamcontract.llm.common import Words, mix, prepare, remainder, runs, slices, stored, table, utf8

STATES, FREQUENT, CLASSES, ROUNDS, SEGMENT = 8, 60_000, 4096, 4, 1024
ROW_BYTES, SLICE = 4 << 20, 1 << 20
END, FIRST = 0, 1  # symbols; FIRST + FREQUENT + CLASSES is below 2^16
#: Occurrences that a symbol has besides its count, shared by the states like all tokens: those with a training count, and the others.
PRIOR, REST = 0.5, 1e-3


@dataclass
class Hmm:
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # symbols x states
    segment: int = SEGMENT  # longest segment worked on as one

    @classmethod
    def first(cls, states: int, counts: np.ndarray, segment: int = SEGMENT, seed: int = 11) -> Hmm:
        rng = np.random.default_rng(seed)
        move = rng.dirichlet(np.full(states, 5.0), states) * 0.3 + 0.7 * np.eye(states)
        emit = (counts[:, None] + 1e-2) * rng.uniform(0.5, 1.5, (len(counts), states))
        return cls(np.full(states, 1 / states), move, emit / emit.sum(0), segment)

    def scaled(self, dtype: type) -> tuple[np.ndarray, np.ndarray]:
        """Emissions, each symbol's scaled to a maximum of one, and the logs of the scales."""
        top = np.maximum(self.emit.max(1), 1e-300)
        return (self.emit / top[:, None]).astype(dtype), np.log(top)


def _emitted(emit: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """States x symbols; whole rows are taken, as a row is one line of the cache."""
    return np.ascontiguousarray(emit.take(symbols, axis=0).T)


@dataclass
class Cut:
    """Sequences cut into segments, the longest first."""

    symbols: np.ndarray  # longest x segments; anything beyond a segment's end
    length: np.ndarray
    text: np.ndarray
    part: np.ndarray  # number of the segment in its sequence
    parts: np.ndarray  # segments of that sequence
    live: list[int]  # how many segments are longer than t

    @classmethod
    def of(cls, flat: np.ndarray, sizes: np.ndarray, segment: int) -> Cut:
        """flat: one sequence after the other, none empty."""
        count = -(-sizes // segment)
        text = np.repeat(np.arange(len(sizes)), count)
        part = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        length = np.minimum(segment, sizes[text] - part * segment)
        start = (np.cumsum(sizes) - sizes)[text] + part * segment
        order = np.argsort(-length, kind="stable")
        length, start = length[order], start[order]
        width = int(length[0]) if len(length) else 0
        at = np.minimum(start[None] + np.arange(width)[:, None], max(0, len(flat) - 1))
        live = np.searchsorted(-length, -np.arange(width), "left").tolist()
        return cls(flat[at], length, text[order], part[order], count[text[order]], live)

    def chains(self) -> Iterator[np.ndarray]:
        """The segments of each sequence that has several, in order."""
        several = np.flatnonzero(self.parts > 1)
        several = several[np.lexsort((self.part[several], self.text[several]))]
        yield from np.split(several, np.flatnonzero(np.diff(self.text[several])) + 1) if len(several) else []


def operators(h: Hmm, c: Cut, which: np.ndarray, dtype: type = np.float64) -> tuple[np.ndarray, np.ndarray]:
    """For each segment of `which` (sorted) the matrix from the weights of states at its first place to those after its end, scaled, and the log of the scale (without that of the emissions)."""
    emit, _ = h.scaled(dtype)
    k, n = len(h.start), len(which)
    down = h.move.T.astype(dtype)
    x = np.repeat(np.eye(k, dtype=dtype)[:, None], n, axis=1)  # state, segment, state at the start
    logs = np.zeros(n)
    ends = np.searchsorted(which, c.live, "left").tolist()
    for t, m in enumerate(ends):
        if not m:
            break
        y = _emitted(emit, c.symbols[t, which[:m]])[:, :, None] * x[:, :m]
        y = (down @ y.reshape(k, m * k)).reshape(k, m, k)
        s = y.max((0, 2))
        x[:, :m] = y / s[None, :, None]
        logs[:m] += np.log(s)
    return x.transpose(1, 0, 2), logs


def boundaries(h: Hmm, c: Cut, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of states before and after each segment (segments x states); begin, end: those of each sequence."""
    before, after = begin[c.text].copy(), end[c.text].copy()
    chains = list(c.chains())
    if chains:
        which = np.sort(np.concatenate(chains))
        ops, _ = operators(h, c, which, np.float32)
        for chain in chains:
            at = np.searchsorted(which, chain)
            for i in range(1, len(chain)):
                v = ops[at[i - 1]] @ before[chain[i - 1]]
                before[chain[i]] = v / v.sum()
            for i in range(len(chain) - 1, 0, -1):
                v = ops[at[i]].T @ after[chain[i]]
                after[chain[i - 1]] = v / v.sum()
    return before, after


def expected_counts(h: Hmm, c: Cut, begin: np.ndarray, end: np.ndarray, opens: np.ndarray, closes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, transition and emission counts of whole sequences.

    begin, end: weights of states before and after each; opens, closes: which ones
    begin and end a text. A symbol's emissions are scaled to a maximum of one, which
    leaves the posteriors as they are, so that rescaling every fourth step is enough.
    """
    k, n = len(h.start), len(c.length)
    if not n:
        return np.zeros(k), np.zeros((k, k)), np.zeros(h.emit.shape)
    emit, _ = h.scaled(np.float32)
    move = h.move.astype(np.float32)
    before, after = boundaries(h, c, begin, end)
    forward = np.zeros((len(c.live), k, n), np.float32)
    last = np.empty((k, n), np.float32)
    emitted, scales = [], {}
    for t, m in enumerate(c.live):
        emitted.append(_emitted(emit, c.symbols[t, :m]))
        a = (before[:m].T.astype(np.float32) if t == 0 else move.T @ forward[t - 1, :, :m]) * emitted[t]
        if t % 4 == 0:
            scales[t] = a.sum(0)
            a /= scales[t]
        forward[t, :, :m] = a
        ended = c.live[t + 1] if t + 1 < len(c.live) else 0
        last[:, ended:m] = a[:, ended:]
    b = move @ after.T.astype(np.float32)
    moved = np.zeros((k, k))
    ends = np.cumsum(c.live)
    posterior = np.empty((k, int(ends[-1])), np.float32)  # place by place
    for t in range(len(c.live) - 1, -1, -1):
        m = c.live[t]
        e = emitted.pop() * b[:, :m]
        now = forward[t, :, :m] * b[:, :m]
        z = np.maximum(now.sum(0), 1e-38)
        np.divide(now, z, out=posterior[:, ends[t] - m : ends[t]])
        if t:
            moved += (forward[t - 1, :, :m] / (z * scales[t] if t in scales else z)) @ e.T
            up = move @ e
            b[:, :m] = up / up.sum(0) if t % 4 == 0 else up
    go_on = np.flatnonzero((c.part < c.parts - 1) | ~closes[c.text])
    if len(go_on):
        x, y = last[:, go_on], after[go_on].T
        moved += (x / (x * (h.move @ y)).sum(0)) @ y.T
    moved *= h.move
    heads = np.flatnonzero((c.part == 0) & opens[c.text])
    start = posterior[:, heads].sum(1, dtype=np.float64)
    flat = np.concatenate([c.symbols[t, :m] for t, m in enumerate(c.live)]).astype(np.int64)
    seen = np.stack([np.bincount(flat, weights=posterior[j], minlength=len(h.emit)) for j in range(k)], axis=1)
    return start, moved, seen


def log_likelihood(h: Hmm, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Natural log of the probability of each whole sequence of symbols (one after another in flat), by the scaled forward recursion."""
    c = Cut.of(flat, sizes, h.segment)
    emit, tops = h.scaled(np.float64)
    down = np.ascontiguousarray(h.move.T)
    total = np.add.reduceat(tops[flat], np.cumsum(sizes) - sizes) if len(sizes) else np.zeros(0)
    single = np.flatnonzero(c.parts == 1)
    logs, a = np.zeros(len(single)), None
    for t, m in enumerate(np.searchsorted(single, c.live, "left").tolist()):
        if not m:
            break
        a = (np.repeat(h.start[:, None], m, axis=1) if t == 0 else down @ a[:, :m]) * _emitted(emit, c.symbols[t, single[:m]])
        s = a.sum(0)
        a /= s
        logs[:m] += np.log(s)
    total[c.text[single]] += logs
    chains = list(c.chains())
    if chains:
        which = np.sort(np.concatenate(chains))
        ops, scales = operators(h, c, which)
        for chain in chains:
            v = h.start
            for i in np.searchsorted(which, chain):
                v = ops[i] @ v
                total[c.text[chain[0]]] += scales[i] + np.log(v.sum())
                v = v / v.sum()
    return total


def whole_operator(h: Hmm, flat: np.ndarray) -> tuple[np.ndarray, float]:
    """The operator of one sequence and the log of its scale, emissions included."""
    c = Cut.of(flat, np.array([len(flat)]), h.segment)
    order = np.argsort(c.part)
    ops, scales = operators(h, c, np.arange(len(c.part)))
    _, tops = h.scaled(np.float64)
    out, log = np.eye(len(h.start)), float(tops[flat].sum())
    for i in order:
        out = ops[i] @ out
        log += scales[i] + np.log(out.max())
        out = out / out.max()
    return out, log


# ---------------------------------------------------------------- words and symbols


def _class(w: Words) -> np.ndarray:
    """Class of a word: its first three and last two bytes."""
    a = w.part(w.start, np.minimum(w.start + 3, w.end))
    b = w.part(np.maximum(w.end - 2, w.start), w.end)
    return mix(a + b * np.uint64(31)) % np.uint64(CLASSES)


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, class, n) of all words of the column text; tasks add up first, in bounded tables."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def added() -> list[np.ndarray]:
            word, cls, n = (np.concatenate(x) for x in zip(*held, strict=True))
            word, first, at = np.unique(word, return_index=True, return_inverse=True)
            return [word, cls[first], np.bincount(at, weights=n).astype(np.int64)]

        def out() -> pa.RecordBatch:
            word, cls, n = added()
            return pa.record_batch([pa.array(word.view(np.int64)), pa.array(cls), pa.array(n)], ["word", "class", "n"])

        for b in batches:
            data, at = utf8(b.column(0))
            at, _ = slices(data, at, SLICE)
            for lo, hi in runs(at):
                w = Words(data, at, lo, hi)
                word, first, n = np.unique(w.hash, return_index=True, return_counts=True)
                held.append([word, _class(w)[first].astype(np.int32), n])
                size += len(word)
                if size > 1 << 20:
                    held = [added()]
                    size = len(held[0][0])
                    if size > 1 << 19:
                        yield out()
                        held, size = [], 0
        if held:
            yield out()

    return texts.select("text").mapInArrow(count, "word long, class int, n long").groupBy("word").agg(F.min("class").alias("class"), F.sum("n").alias("n"))


@dataclass
class Alphabet:
    frequent: np.ndarray  # sorted word hashes, unsigned
    symbols: np.ndarray  # their symbols
    count: np.ndarray  # training count of each symbol
    unseen: np.ndarray  # of each class: the share of words without a training count
    n_train: int
    n_types: int
    rest: int  # the first class's symbol

    def of(self, words: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Symbol of each word."""
        out = self.rest + classes.astype(np.int64)
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, words), len(self.frequent) - 1)
            out = np.where(self.frequent[at] == words, self.symbols[at], out)
        return out.astype(np.uint16)

    @property
    def bottom(self) -> float:
        return self.n_train + 0.1 * (self.n_types + 1)

    def base(self) -> np.ndarray:
        """log10 base probability by symbol; of a class: that of a word without a count."""
        return np.log10((np.where(np.arange(len(self.count)) < self.rest, self.count, 0.0) + 0.1) / self.bottom)

    def inside(self) -> np.ndarray:
        """log10 probability of the word given the symbol; of a class: that of a word without a count."""
        return np.concatenate([np.zeros(self.rest), np.log10(self.unseen)])


def alphabet(counts: DataFrame, n_train_docs: int, frequent: int = FREQUENT) -> Alphabet:
    """counts: word, class, n of all words of the training texts."""
    rest = FIRST + frequent
    top = counts.orderBy(F.desc("n"), "word").limit(frequent).toArrow().to_pandas()  # at most FREQUENT rows
    sums = counts.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sum((F.col("n") == 1).cast("long")).alias("ones")).toPandas()  # at most CLASSES rows
    n_train = int(sums["n"].sum()) + n_train_docs
    types = int(sums["v"].sum()) + (n_train_docs > 0)
    count = np.zeros(rest + CLASSES)
    count[END] = n_train_docs
    count[FIRST + np.arange(len(top))] = top["n"]
    ones, at = np.zeros(CLASSES), sums["class"].to_numpy(np.int64)
    count[rest + at], ones[at] = sums["n"], sums["ones"]
    np.subtract.at(count, rest + top["class"].to_numpy(np.int64), top["n"].to_numpy(float))
    np.subtract.at(ones, top["class"].to_numpy(np.int64), (top["n"] == 1).to_numpy(float))
    words = top["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(words)
    return Alphabet(words[order], (FIRST + np.arange(len(top)))[order], count, (ones + 0.5) / (count[rest:] + ones + 0.5), n_train, types, rest)


# ---------------------------------------------------------------- texts as symbols

PACKED = "key long, k int, n int, doc_id array<long>, held_out array<boolean>, sizes array<int>, symbols binary, rare array<struct<place: int, word: long, m: int>>"


def _rare(place: np.ndarray, word: np.ndarray) -> pa.Array:
    """One row: how often each text (place) has each word."""
    order = np.lexsort((word, place))
    place, word = place[order], word[order]
    new = np.ones(len(word), bool)
    new[1:] = (place[1:] != place[:-1]) | (word[1:] != word[:-1])
    first = np.flatnonzero(new)
    m = np.diff(np.append(first, len(word)))
    entries = pa.StructArray.from_arrays([pa.array(place[first].astype(np.int32)), pa.array(word[first].view(np.int64)), pa.array(m.astype(np.int32))], ["place", "word", "m"])
    return pa.ListArray.from_arrays(pa.array([0, len(first)], pa.int32()), entries)


def packed(docs: DataFrame, letters: Alphabet) -> DataFrame:
    """The texts as symbols (16-bit numbers).

    A row has the texts of about ROW_BYTES, each with its end (k = 0, n = 1), or one
    slice of a longer text (number k of n), the last one with the end. (key, place in
    the row) names a text; all slices of one have the same key and the place 0.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(F.col("doc_id"), 10) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    shared = rows.sparkSession.sparkContext.broadcast(letters)

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = shared.value
        key = lambda: int.from_bytes(os.urandom(8), "little", signed=True)

        def row(key: int, k: int, n: int, ids: pa.Array, held: pa.Array, flat: np.ndarray, sizes: np.ndarray, place: np.ndarray, word: np.ndarray) -> pa.RecordBatch:
            one = pa.array([0, len(sizes)], pa.int32())
            lists = [pa.ListArray.from_arrays(one, x) for x in (ids, held, pa.array(sizes.astype(np.int32)))]
            return pa.record_batch([pa.array([key]), pa.array([k], pa.int32()), pa.array([n], pa.int32()), *lists, pa.array([flat.astype("<u2").tobytes()], pa.binary()), _rare(place, word)], [x.split(" ")[0] for x in ("key", "k", "n", "doc_id", "held_out", "sizes", "symbols", "rare")])

        for b in batches:
            data, at = utf8(b.column(2))
            at, doc = slices(data, at, SLICE)
            count = np.bincount(doc, minlength=b.num_rows)
            first = np.cumsum(count) - count
            ids: list[int] = []
            flats, sizes, places, words, size = [], [], [], [], 0
            name = {}

            def flush() -> Iterator[pa.RecordBatch]:
                if ids:
                    take = pa.array(ids)
                    yield row(key(), 0, 1, b.column(0).take(take), b.column(1).take(take), np.concatenate(flats), np.concatenate(sizes), np.concatenate(places), np.concatenate(words))
                    for x in (ids, flats, sizes, places, words):
                        x.clear()

            for lo, hi in runs(at):
                w = Words(data, at, lo, hi)
                symbols = letters.of(w.hash, _class(w))
                rare = symbols >= letters.rest
                n = np.bincount(w.doc, minlength=hi - lo)
                alone = count[doc[lo:hi]] == 1
                own = alone[w.doc]
                number = np.cumsum(alone) - 1 + len(ids)
                flats.append(np.insert(symbols[own], np.cumsum(n[alone]), END))
                sizes.append(n[alone] + 1)
                places.append(number[w.doc[own & rare]])
                words.append(w.hash[own & rare])
                ids.extend(doc[lo:hi][alone].tolist())
                for i in np.flatnonzero(~alone):
                    d = int(doc[lo + i])
                    k = lo + int(i) - int(first[d])
                    here = w.doc == i
                    flat = symbols[here]
                    if k == count[d] - 1:
                        flat = np.append(flat, np.uint16(END))
                    there = here & rare
                    yield row(name.setdefault(d, key()), k, int(count[d]), b.column(0).slice(d, 1), b.column(1).slice(d, 1), flat, np.array([len(flat)]), np.zeros(int(there.sum()), np.int64), w.hash[there])
                size += int(at[hi] - at[lo])
                if size > ROW_BYTES:
                    yield from flush()
                    size = 0
            yield from flush()

    return rows.mapInArrow(pack, PACKED)


@dataclass
class Row:
    """One row of packed()."""

    doc_id: pa.Array
    held_out: np.ndarray
    sizes: np.ndarray
    flat: np.ndarray


def _rows(b: pa.RecordBatch) -> Iterator[Row]:
    """Columns from the fourth on as in packed(), without rare."""
    for ids, held, sizes, body in zip(b.column(3), b.column(4), b.column(5), b.column(6), strict=True):
        yield Row(ids.values, held.values.to_numpy(zero_copy_only=False), sizes.values.to_numpy().astype(np.int64), np.frombuffer(body.as_buffer(), "<u2"))


def slice_operators(slices_: DataFrame, h: object) -> DataFrame:
    """key, k, operator and the log of its scale of each slice."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [whole_operator(h.value, r.flat) if len(r.flat) else (np.eye(len(h.value.start)), 0.0) for r in _rows(b)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array([o.ravel() for o, _ in found], pa.list_(pa.float64())), pa.array([s for _, s in found], pa.float64())], ["key", "k", "operator", "log"])

    return slices_.drop("rare").mapInArrow(of, "key long, k int, operator array<double>, log double")


def _chain(t: pa.Table, states: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t = t.sort_by("k")
    return t["k"].to_numpy(), np.array(t["operator"].to_pylist()).reshape(-1, states, states), t["log"].to_numpy()


def slice_boundaries(ops: DataFrame, h: object, states: int) -> DataFrame:
    """key, k and the weights of states before and after each slice; a group has one small matrix for each SLICE bytes of one text."""

    def scan(t: pa.Table) -> pa.Table:
        k, op, _ = _chain(t, states)
        before, after = [h.value.start], [np.ones(states)]
        for x in op[:-1]:
            v = x @ before[-1]
            before.append(v / v.sum())
        for x in op[:0:-1]:
            v = x.T @ after[-1]
            after.append(v / v.sum())
        return pa.table({"key": t.sort_by("k")["key"], "k": pa.array(k, pa.int32()), "before": pa.array(before, pa.list_(pa.float64())), "after": pa.array(after[::-1], pa.list_(pa.float64()))})

    return ops.groupBy("key").applyInArrow(scan, "key long, k int, before array<double>, after array<double>")


# ---------------------------------------------------------------- training


def train(rows: DataFrame, letters: Alphabet, *, states: int = STATES, rounds: int = ROUNDS, segment: int = SEGMENT) -> Hmm:
    """Baum-Welch over all training texts of packed(); each round is one distributed pass."""
    spark = rows.sparkSession
    h = Hmm.first(states, letters.count, segment)
    if not letters.n_train:
        return h
    names = [f"s{j}" for j in range(states)]
    nothing = F.lit(None).cast("array<double>")
    whole = rows.where("n = 1").drop("rare").withColumns({"before": nothing, "after": nothing})
    parts = rows.where("n > 1 AND NOT held_out[0]")
    sliced = bool(parts.limit(1).count())
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(h)

        def count(batches: Iterable[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            h = now.value
            k = len(h.start)
            start, moved, seen = np.zeros(k), np.zeros((k, k)), np.zeros((len(h.emit), k))
            for b in batches:
                for x, number, n, before, after in zip(_rows(b), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(7).to_pylist(), b.column(8).to_pylist(), strict=True):
                    learn = ~x.held_out & (x.sizes > 0)
                    c = Cut.of(x.flat[np.repeat(learn, x.sizes)], x.sizes[learn], h.segment)
                    m = int(learn.sum())
                    begin, end = np.tile(h.start if before is None else before, (m, 1)), np.tile(np.ones(k) if after is None else after, (m, 1))
                    for total, part in zip((start, moved, seen), expected_counts(h, c, begin, end, np.full(m, number == 0), np.full(m, number == n - 1)), strict=True):
                        total += part
            used = np.flatnonzero(seen.sum(1))
            keys = np.concatenate([[-1], -2 - np.arange(k), used])
            found = np.vstack([start[None], moved, seen[used]]).astype(np.float32)
            yield pa.record_batch([pa.array(keys), *(pa.array(found[:, j]) for j in range(k))], ["key", *names])

        todo = whole
        if sliced:
            ends = slice_boundaries(slice_operators(parts, now), now, states)
            todo = whole.unionByName(parts.drop("rare").join(ends, ["key", "k"]).select(*whole.columns))
        got = todo.mapInArrow(count, "key long, " + ", ".join(f"{c} float" for c in names)).groupBy("key").agg(*(F.sum(F.col(c).cast("double")).alias(c) for c in names)).toArrow().to_pandas()  # a row a symbol and a few
        key, sums = got["key"].to_numpy(), got[names].to_numpy()
        start, moved, seen = sums[key == -1].sum(0) + 1e-3, np.full((states, states), 1e-3), np.zeros(h.emit.shape)
        moved[-2 - key[key <= -2]] += sums[key <= -2]
        seen[key[key >= 0]] += sums[key >= 0]
        seen += np.where(letters.count > 0, PRIOR, REST)[:, None] * seen.sum(0) / seen.sum() + 1e-9
        h = Hmm(start / start.sum(), moved / moved.sum(1, keepdims=True), seen / seen.sum(0), segment)
    return h


# ---------------------------------------------------------------- scoring

SCORED = "key long, place int, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"
NAMES = [x.split(" ")[0] for x in SCORED.split(", ")]


def _sums(x: Row, letters: Alphabet) -> list[np.ndarray]:
    """Tokens, known tokens, base and inside log10 of each text, its rare words taken as unknown."""
    known = np.concatenate([letters.count[: letters.rest] > 0, np.zeros(CLASSES, bool)])
    text = np.repeat(np.arange(len(x.sizes)), x.sizes)
    add = lambda v: np.bincount(text, weights=v[x.flat], minlength=len(x.sizes))
    return [x.sizes, add(known.astype(float)).astype(np.int64), add(letters.base()), add(letters.inside())]


def score_whole(rows: DataFrame, shared: object) -> DataFrame:
    """SCORED of the texts that are no slices."""

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, h = shared.value
        for b in batches:
            for key, x in zip(b.column(0).to_pylist(), _rows(b), strict=True):
                tokens, known, base, inside = _sums(x, letters)
                total = log_likelihood(h, x.flat, x.sizes) / np.log(10) + inside
                yield pa.record_batch([pa.array(np.full(len(tokens), key)), pa.array(np.arange(len(tokens), dtype=np.int32)), x.doc_id, pa.array(x.held_out), pa.array(tokens), pa.array(known), pa.array(base), pa.array(total)], NAMES)

    return rows.where("n = 1").drop("rare").mapInArrow(score, SCORED)


def score_slices(rows: DataFrame, shared: object, model: object, states: int) -> DataFrame:
    """SCORED of the sliced texts: sums of the slices' sums, likelihood from their operators in order."""
    parts = rows.where("n > 1")

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[v[0] for v in _sums(x, shared.value[0])] for x in _rows(b)]
            columns = [pa.array(np.array(v)) for v in zip(*found, strict=True)]
            if found:
                yield pa.record_batch([b.column(0), b.column(1), pa.array([x.doc_id[0] for x in _rows(b)]).cast(pa.int64()), pa.array([bool(x.held_out[0]) for x in _rows(b)]), *columns], ["key", "k", "doc_id", "held_out", "n_tokens", "n_known", "base", "score"])

    def scan(t: pa.Table) -> pa.Table:
        _, op, logs = _chain(t, states)
        v, total = model.value.start, 0.0
        for x, log in zip(op, logs, strict=True):
            v = x @ v
            total += log + np.log(v.sum())
            v = v / v.sum()
        return pa.table({"key": t["key"][:1], "log": pa.array([total / np.log(10)])})

    likelihood = slice_operators(parts, model).groupBy("key").applyInArrow(scan, "key long, log double")
    own = parts.drop("rare").mapInArrow(sums, SCORED.replace("place", "k"))
    own = own.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min("held_out").alias("held_out"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")))
    return own.join(likelihood, "key").select("key", F.lit(0).alias("place"), "doc_id", "held_out", "n_tokens", "n_known", "base", (F.col("score") + F.col("log")).alias("score"))


def language_model(docs: DataFrame, *, states: int = STATES, rounds: int = ROUNDS, frequent: int = FREQUENT, segment: int = SEGMENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id, text)."""
    spark = prepare(docs.sparkSession)
    learn = docs.where(remainder(F.col("doc_id"), 10) != 0)
    counts = stored(word_counts(learn.select(F.col("text").cast("string").alias("text"))))
    letters = alphabet(counts, learn.count(), frequent)
    rows = stored(packed(docs, letters))
    h = train(rows, letters, states=states, rounds=rounds, segment=segment)
    shared, model = spark.sparkContext.broadcast((letters, h)), spark.sparkContext.broadcast(h)
    scored = score_whole(rows, shared)
    if rows.where("n > 1").limit(1).count():
        scored = scored.unionByName(score_slices(rows, shared, model, states))
    # what a word's training count adds to the sums that take it as unknown
    classes = spark.createDataFrame([(i, float(u), float(n)) for i, (u, n) in enumerate(zip(letters.unseen, letters.count[letters.rest :], strict=True))], "class int, unseen double, total double")  # CLASSES rows
    worth = counts.join(F.broadcast(classes), "class").select("word", F.log10(10.0 * F.col("n") + 1).alias("more_base"), (F.log10((1 - F.col("unseen")) * F.col("n") / F.greatest("total", F.lit(1.0))) - F.log10("unseen")).alias("more_score"))
    rare = rows.select("key", F.explode("rare").alias("r")).select("key", "r.place", "r.word", "r.m")
    more = rare.join(worth, "word").groupBy("key", "place").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("more_base")).alias("more_base"), F.sum(F.col("m") * F.col("more_score")).alias("more_score"))
    add = lambda x: F.coalesce(x, F.lit(0.0))
    return scored.join(more, ["key", "place"], "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("m", F.lit(0))).cast("long").alias("n_known"), F.lit(letters.n_train).cast("long").alias("train_tokens"),
        (F.col("base") + add(F.col("more_base"))).alias("base_score"), (F.col("score") + add(F.col("more_score"))).alias("score"),
    )


def op5_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model(table(spark, sf_dir, "documents"))
