"""MinHash near-deduplication: one-permutation hashing, optimal densification, bands, star-shaped candidate edges.

A text's set is its distinct shingles of `width` words. One hash of a shingle
chooses one of 512 bins and a value; a bin keeps its least value. Each empty bin
takes the value of the first full bin in its own fixed random order of all bins
(the same order for all texts). 64 bands of eight bins are hashed; at similarity 0.8
a pair shares no band with a probability of about 8 in a million.

Texts with the same set are one class; the class goes on as its smallest id.
Buckets (band hashes that two or more classes have) are worked off as stars:

 * passes: each class that shares an unsettled bucket with a smaller class of
   another component is compared with the smallest such class: at most one edge
   a class and pass;
 * then one step that leaves nothing out: in every bucket that still has several
   components, all its members of different components are weighed against each
   other inside a task by an upper bound of the intersection (the sum of the smaller
   counts of both sets in each of 256 cells of the hash range). Only pairs that the
   bound allows to reach the similarity are sent on. Buckets of more than 2 * PART
   members are dealt out as pairs of parts, so a task never holds a larger group.

So no bucket is capped, a bucket whose members are one component costs about one
comparison a member, every pair in a bucket is compared, ruled out exactly or
already connected, and pairs are never expanded. Edges
are confirmed on the full sets: 100 * intersection >= percent * union. Components
come from minimum labels with pointer jumping, in DataFrames.

Cases: null and empty texts, and those without words, have an empty set, are
linked with nothing and are their own component; a text of fewer words is one
shingle. Rows of the same doc_id are one document, linked through any of its texts,
and keep a row each. A null doc_id joins a component but cannot name it; alone it
is its own (null) component and kept. Extra columns do not matter; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from streamcontract.llm.common import Words, fresh, keep, mix, prepare, runs, shuffle_partitions, table, utf8

BINS, ROWS = 512, 8
BANDS = BINS // ROWS
PASSES, PART, CELLS = 2, 1024, 256
_U = np.uint64

#: Each bin's order of donor bins.
DONORS = np.stack([np.random.default_rng(1000 + b).permutation(BINS) for b in range(BINS)])


def shingle_sets(data: np.ndarray, at: np.ndarray, lo: int, hi: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a run of texts, sorted within each text, and the sets' sizes."""
    w = Words(data, at, lo, hi)
    n = np.bincount(w.doc, minlength=hi - lo)
    first = np.cumsum(n) - n
    place = np.arange(len(w.hash)) - first[w.doc]
    total = n[w.doc]
    whole = place + width <= total
    short = (place == 0) & (total < width)
    start = np.flatnonzero(whole | short)
    h = np.zeros(len(start), np.uint64)
    for k in range(width):
        inside = place[start] + k < total[start]
        h = np.where(inside, mix(h * _U(0x9E3779B97F4A7C15) + w.hash[np.minimum(start + k, len(w.hash) - 1)] + _U(k + 1)), h)
    doc = w.doc[start]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.bincount(doc, minlength=hi - lo)


def signatures(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Densified signatures, (texts with a set, BINS), of sorted sets."""
    full = np.flatnonzero(sizes)
    doc = np.repeat(np.arange(len(full)), sizes[full])
    bins = (h >> _U(64 - BINS.bit_length() + 1)).astype(np.int64)
    cell = doc * BINS + bins
    first = np.ones(len(h), bool)
    first[1:] = cell[1:] != cell[:-1]
    sig = np.zeros(len(full) * BINS, np.uint64)
    have = np.zeros(len(full) * BINS, bool)
    sig[cell[first]], have[cell[first]] = h[first], True
    sig, have = sig.reshape(-1, BINS), have.reshape(-1, BINS)
    for i in np.flatnonzero(~have.all(1)):
        empty = np.flatnonzero(~have[i])
        for width in (32, BINS):  # nearly always one of the first is full
            donors = DONORS[empty, :width]
            full_ones = have[i][donors]
            at = full_ones.argmax(1)
            found = full_ones[np.arange(len(empty)), at]
            sig[i, empty[found]] = sig[i, donors[np.arange(len(empty)), at][found]]
            empty = empty[~found]
            if not len(empty):
                break
    return sig


def bands(sig: np.ndarray) -> np.ndarray:
    x = sig[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _U(0xD1B54A32D192ED03), x.shape[:2]).copy()
    for k in range(ROWS):
        out = mix(out * _U(0x9E3779B97F4A7C15) + x[:, :, k])
    return out


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n, k1, k2 (128 bits that identify the set), bands."""

    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = utf8(b.column(1))
            for lo, hi in runs(at):
                h, n = shingle_sets(data, at, lo, hi, width)
                full = np.flatnonzero(n)
                first = (np.cumsum(n) - n)[full]
                k1, k2 = np.zeros(hi - lo, np.uint64), np.zeros(hi - lo, np.uint64)
                if len(full):
                    k1[full], k2[full] = np.add.reduceat(mix(h), first), np.add.reduceat(mix(h ^ _U(0xA5A5A5A5A5A5A5A5)), first)
                    values = bands(signatures(h, n)).ravel()
                else:
                    values = np.zeros(0, np.uint64)
                offsets = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
                yield pa.record_batch([b.column(0).slice(lo, hi - lo), pa.array(n.astype(np.int64)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))], ["doc_id", "n", "k1", "k2", "bands"])

    return docs.select("doc_id", "text").mapInArrow(sketch, "doc_id long, n long, k1 long, k2 long, bands array<long>")


def set_keys(docs: DataFrame, width: int) -> DataFrame:
    """All columns of docs (one is text) and n, k1, k2 of each row's set."""
    rows = docs.withColumn("text", F.col("text").cast("string"))
    names, at_text = rows.columns, rows.columns.index("text")

    def key(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = utf8(b.column(at_text))
            for lo, hi in runs(at):
                h, n = shingle_sets(data, at, lo, hi, width)
                k1, k2 = np.zeros(hi - lo, np.uint64), np.zeros(hi - lo, np.uint64)
                if len(h):
                    full = np.flatnonzero(n)
                    first = (np.cumsum(n) - n)[full]
                    k1[full], k2[full] = np.add.reduceat(mix(h), first), np.add.reduceat(mix(h ^ _U(0xA5A5A5A5A5A5A5A5)), first)
                part = b.slice(lo, hi - lo)
                yield pa.record_batch([*part.columns, pa.array(n.astype(np.int64)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64))], [*names, "n", "k1", "k2"])

    return rows.mapInArrow(key, StructType([*rows.schema, *StructType.fromDDL("n long, k1 long, k2 long")]))


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id and the sorted set as bytes."""

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = utf8(b.column(1))
            for lo, hi in runs(at):
                h, n = shingle_sets(data, at, lo, hi, width)
                ends = np.cumsum(n)
                yield pa.record_batch([b.column(0).slice(lo, hi - lo), pa.array([h[e - k : e].tobytes() for e, k in zip(ends, n, strict=True)], pa.binary())], ["doc_id", "set"])

    return docs.select("doc_id", "text").mapInArrow(sets, "doc_id long, set binary")


def confirm(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The edges (a, b) whose full sets reach the similarity.

    Each edge carries the set of b; the set of a comes once for every PART edges of a,
    in front of them, so neither a hub's set nor its edges meet in one task.
    """
    parts = edges.groupBy("a").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part")
    ends = edges.join(parts, "a").select("a", part, "b").join(sets.select(F.col("doc_id").alias("b"), "set"), "b").select("a", "part", "b", "set")
    heads = parts.join(sets.select(F.col("doc_id").alias("a"), "set"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "set")
    both = heads.unionByName(ends).repartition(shuffle_partitions(edges.sparkSession), "a", "part").sortWithinPartitions("a", "part", "b")

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = None
        for batch in batches:
            good = []
            for other, y in zip(batch.column(2), batch.column(3), strict=True):
                y = np.frombuffer(y.as_buffer(), np.uint64)
                if not other.is_valid:
                    x = y
                    good.append(False)
                    continue
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    good.append(False)
                    continue
                short, long = (x, y) if len(x) < len(y) else (y, x)
                at = np.minimum(np.searchsorted(long, short), len(long) - 1)
                same = int((long[at] == short).sum())
                good.append(100 * same >= percent * (len(x) + len(y) - same))
            yield batch.select([0, 2]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(check, "a long, b long").distinct()


def components(edges: DataFrame, fresh: Callable[[DataFrame], DataFrame] = fresh) -> DataFrame:
    """(node, label): the smallest node that each node of an edge reaches. Minimum labels and pointer jumping."""
    both = fresh(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = fresh(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        new = labels.join(near, labels["node"] == near["a"]).select("node", F.least("label", "near").alias("to"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("far"))
        new = fresh(new.join(jump, "to").select("node", F.col("far").alias("label"), (F.col("far") != F.col("old")).alias("moved")))
        labels = new.select("node", "label")
        if not new.where("moved").limit(1).count():
            return labels


def cell_counts(sets: DataFrame) -> DataFrame:
    """rep and the counts of its set in equal cells of the hash range, as 16-bit integers (65535: as many or more)."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column(1):
                cells = np.frombuffer(x.as_buffer(), np.uint64) >> _U(56)
                out.append(np.minimum(np.bincount(cells.astype(np.int64), minlength=CELLS), 65535).astype("<u2").tobytes())
            yield pa.record_batch([b.column(0), pa.array(out, pa.binary())], ["rep", "cells"])

    return sets.mapInArrow(count, "rep long, cells binary")


def possible_pairs(rep: np.ndarray, comp: np.ndarray, side: np.ndarray, cells: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different components that may reach the similarity; of a group of two sides, across them only."""
    total = cells.sum(1, dtype=np.int64)
    exact = (cells < 65535).all(1)
    left, right = [], []
    two = len(set(side.tolist())) > 1
    for i in range(len(rep) - 1):
        j = np.arange(i + 1, len(rep))
        j = j[comp[j] != comp[i]]
        if two:
            j = j[side[j] != side[i]]
        if not len(j):
            continue
        common = np.minimum(cells[i], cells[j]).sum(1, dtype=np.int64)
        # 100 * common >= percent * (sizes - common)
        j = j[((100 + percent) * common >= percent * (total[i] + total[j])) | ~exact[i] | ~exact[j]]
        left.append(np.full(len(j), rep[i]))
        right.append(rep[j])
    if not left:
        return rep[:0], rep[:0]
    a, b = np.concatenate(left), np.concatenate(right)
    return np.minimum(a, b), np.maximum(a, b)


def remaining_pairs(buckets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs of the unsettled buckets (bucket, rep, comp) that may be links."""
    sizes = buckets.groupBy("bucket").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    rows = buckets.select("bucket", "rep", "comp").join(sizes, "bucket")
    single = F.col("parts") <= 2
    own = F.when(single, F.lit(0)).otherwise(F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    rows = rows.withColumn("side", own).withColumn("other", F.explode(F.when(single, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
    rows = rows.select("bucket", F.least("side", "other").alias("p"), F.greatest("side", "other").alias("q"), "side", "rep", "comp").join(cell_counts(sets), "rep")
    n = shuffle_partitions(buckets.sparkSession)
    rows = rows.repartition(n, "bucket", "p", "q").sortWithinPartitions("bucket", "p", "q").select("bucket", "p", "q", "side", "rep", "comp", "cells")

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
            k = [t[c].to_numpy() for c in ("bucket", "p", "q")]
            first = np.flatnonzero(np.concatenate([[True], (k[0][1:] != k[0][:-1]) | (k[1][1:] != k[1][:-1]) | (k[2][1:] != k[2][:-1])]))
            rep, comp, side = (t[c].to_numpy() for c in ("rep", "comp", "side"))
            cells = np.frombuffer(b"".join(t["cells"].to_pylist()), "<u2").reshape(-1, CELLS)
            a, b = [], []
            for lo, hi in zip(first, [*first[1:], len(rep)], strict=True):
                x, y = possible_pairs(rep[lo:hi], comp[lo:hi], side[lo:hi], cells[lo:hi], percent)
                a.append(x)
                b.append(y)
            pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0)
            yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            k = [t[c].to_numpy() for c in ("bucket", "p", "q")]
            same = np.flatnonzero((k[0] != k[0][-1]) | (k[1] != k[1][-1]) | (k[2] != k[2][-1]))
            cut = int(same[-1]) + 1 if len(same) else 0  # the last group may go on
            if cut:
                yield from out(t.slice(0, cut))
            held = t.slice(cut)
        if held is not None:
            yield from out(held)

    return rows.mapInArrow(weigh, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80, passes: int = PASSES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text)."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = keep(sketches(docs, width))
    key = ["k1", "k2", "n"]
    classes = keep(rows.where("n > 0").groupBy(*key).agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")))
    # rows of one id with different sets: the id stands for all of them
    tied = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.countDistinct(*key).alias("sets")).where("sets > 1").select("doc_id")
    same_id = rows.join(tied, "doc_id").join(classes.select(*key, "rep"), key).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b").distinct()
    member = classes.where("rep IS NOT NULL").select("rep", F.explode("bands").alias("bucket"))
    shared = member.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1").select("bucket")
    buckets = keep(member.join(shared, "bucket").select("bucket", "rep"))
    n_rows = buckets.count()
    # tables of the rounds have at most as many rows as buckets: as many partitions as those need
    few = lambda df: fresh(df.coalesce(max(8, n_rows // 100_000)))
    texts = docs.join(buckets.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = full_sets(texts, width)
    if rows.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count():
        sets = sets.distinct()  # repeated rows of an id would meet each other
    sets = keep(sets)
    links = few(same_id)
    labels = components(links, few)
    sizes = classes.where("rep IS NOT NULL").groupBy("rep").agg(F.struct(F.min("n").alias("least"), F.max("n").alias("most")).alias("size"))
    buckets, tested, turn = few(buckets.join(sizes, "rep").select("bucket", "rep", "size")), None, 0
    close = lambda x, y: (x["most"] * 100 >= y["least"] * percent) & (y["most"] * 100 >= x["least"] * percent)  # noqa: E731  sizes that can reach the similarity
    while True:
        own = labels.select(F.col("node").alias("rep"), F.col("label"))
        now = buckets.join(own, "rep", "left").select("bucket", "rep", "size", F.coalesce("label", "rep").alias("comp"))
        unsettled = now.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(F.struct("rep", "size", "comp")).alias("centre")).where("lo <> hi")
        buckets = few(now.join(unsettled.select("bucket", "centre"), "bucket"))
        if not buckets.limit(1).count():
            break
        if turn < passes:
            e = buckets.where((F.col("comp") != F.col("centre.comp")) & close(F.col("size"), F.col("centre.size"))).select(F.col("centre.rep").alias("a"), F.col("rep").alias("b"))
            e = e if tested is None else e.join(tested, ["a", "b"], "left_anti")
            edges = few(e.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
            buckets = buckets.select("bucket", "rep", "size")
        else:
            e = remaining_pairs(buckets, sets, percent)
            edges = few(e if tested is None else e.join(tested, ["a", "b"], "left_anti"))
        turn += 1
        new = few(confirm(edges, sets, percent))
        tested = edges if tested is None else tested.union(edges)
        if new.limit(1).count():
            links = links.union(new)
            labels = components(links, few)
        if turn > passes:
            break
    # every class of a component, then every row of a class
    by_class = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(*key, F.coalesce("label", "rep").alias("component_id"))
    found = rows.where("n > 0").select("doc_id", *key).join(by_class, key, "left").select("doc_id", "n", "component_id")
    alone = rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END) AS shingles
  FROM w
), n AS (SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles FROM s),
u AS (SELECT doc_id, unnest(shingles) AS x FROM s),
link AS (
  SELECT a, b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS common FROM u p JOIN u q ON p.x = q.x AND p.doc_id <> q.doc_id GROUP BY 1, 2) c
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 80 * (na.n_shingles + nb.n_shingles - common)
), reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM n
  UNION
  SELECT reach.node, link.b FROM reach JOIN link ON link.a = reach.seen
), best AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN best ON best.node = n.doc_id
"""
