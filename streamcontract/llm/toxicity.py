"""Convolutional text classifier for toxicity.

A word is the sum of hashed embeddings of its whole lower-cased form and of its
first four, five and six bytes. Filters of width 1, 2 and 3 run over the words of
the whole text, are max-pooled over it and feed a logistic layer. All is trained
in numpy with sparse Adagrad: through the maximum, a text's gradient reaches only
the windows that won.

The model is fitted on the driver on a bounded sample of labelled rows:
`per_class` texts of each label at most, those with the smallest hash of their id,
whatever their length, each whole: its different words' buckets and where they
stand. A fifth of the sample is set aside; on it the score is shifted so that the
best cut is at 0.7. A threshold is then chosen for each language from the scores of
all labelled rows that were not trained on, as counts by label and a ten-thousandth
of the score, where both labels have at least `least` of them (0.7 for the others).
Language, source, label and id are never inputs of a score.

Scoring is one narrow pass over all whole texts; what is broadcast is the model,
2^17 x 8 floats whatever the data.

Cases: null and empty texts, and texts without words, get the score of the bias
alone; conflicting labels of one id count as toxic; rows without a usable label
are only scored; without labelled rows of both kinds every score is 0. Repeated
rows give repeated results, input columns with clashing names are not kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from streamcontract.llm.common import NOT_ALNUM, Words, keep, prepare, remainder, runs, table, utf8

BUCKETS, DIM, FILTERS, WIDTHS, PARTS = 1 << 17, 8, 8, (1, 2, 3), (4, 5, 6)
PER_CLASS, LEAST, STEPS, CUT = 2500, 20, 10_000, 0.7


@dataclass
class Model:
    table: np.ndarray
    filters: dict[int, np.ndarray]  # width: (width, DIM, FILTERS)
    weights: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def score(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -30, 30)))


def features(w: Words) -> np.ndarray:
    """Bucket of the word and of its beginnings, (n, 4)."""
    out = [w.hash, *(w.part(w.start, np.minimum(w.start + k, w.end)) for k in PARTS)]
    return np.stack([(h + np.uint64(i * 0x9E3779B1)) % np.uint64(BUCKETS) for i, h in enumerate(out)], axis=1).astype(np.int32)


def pooled(model: Model, words: np.ndarray, word: np.ndarray, sizes: np.ndarray, winners: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Maximum of each filter over each text, (texts, filters), and, for training, where it was.

    words: buckets of the different words; word: index into them for each place;
    sizes: places of each text. A window that reaches over a text's end sees zeros there.
    """
    n = len(sizes)
    top = np.zeros((n, FILTERS * len(WIDTHS)), np.float32)
    place = np.full(top.shape, -1, np.int64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return top, place
    vectors = np.vstack([model.table[words].sum(1), np.zeros((1, DIM), np.float32)])
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[full]
    left = np.repeat(ends, sizes) - np.arange(len(word))  # places to the text's end, this one included
    for i, width in enumerate(WIDTHS):
        out = None
        for j in range(width):
            at = word if j == 0 else np.where(left > j, np.append(word[j:], np.full(j, len(words), word.dtype))[: len(word)], len(words))
            part = (vectors @ model.filters[width][j])[at]
            out = part if out is None else out + part
        top[full, i * FILTERS : (i + 1) * FILTERS] = np.maximum.reduceat(out, starts, axis=0)
        if winners:
            for d, a, b in zip(full, starts, ends[full], strict=True):
                place[d, i * FILTERS : (i + 1) * FILTERS] = a + out[a:b].argmax(0)
    return top, place


class Packed:
    """A whole text: (different words, 4) buckets and the word at each place."""

    __slots__ = ("places", "words")

    def __init__(self, words: np.ndarray, places: np.ndarray) -> None:
        self.words, self.places = words, places

    def __len__(self) -> int:
        return len(self.places)


def joined(docs: list[Packed | np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts and the word at each place of their concatenation."""
    docs = [d if isinstance(d, Packed) else Packed(d, np.arange(len(d))) for d in docs]
    words = np.concatenate([d.words for d in docs])
    first = np.cumsum([0, *(len(d.words) for d in docs)])
    return words, np.concatenate([d.places + np.int64(f) for d, f in zip(docs, first, strict=False)])


def train(docs: list[Packed | np.ndarray], labels: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.1, seed: int = 7) -> Model:
    """docs: each text, packed or as its (places, 4) buckets."""
    rng = np.random.default_rng(seed)
    model = Model(rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32), {w: rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}, rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32), 0.0)
    grown = {"t": np.full(BUCKETS, 1e-2, np.float32), "w": np.full_like(model.weights, 1e-2), "b": 1e-2, **{w: np.full_like(f, 1e-2) for w, f in model.filters.items()}}
    share = max(1e-3, labels.mean())
    weight = np.where(labels == 1, 0.5 / share, 0.5 / max(1e-3, 1 - share))
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for lo in range(0, len(order), batch):
            some = order[lo : lo + batch]
            sizes = np.array([len(docs[i]) for i in some])
            if not sizes.sum():
                continue
            flat, at = joined([docs[i] for i in some])
            _, first, word = np.unique(flat[:, 0].astype(np.int64) << 32 | flat[:, 1], return_index=True, return_inverse=True)
            words, word = flat[first], word[at]
            top, place = pooled(model, words, word, sizes, winners=True)
            h = np.maximum(top, 0)
            z = h @ model.weights + model.bias
            err = ((1 / (1 + np.exp(-z)) - labels[some]) * weight[some] / len(some)).astype(np.float32)
            d_top = np.outer(err, model.weights) * (top > 0) * (place >= 0)
            d_w, d_b = h.T @ err + 1e-5 * model.weights, float(err.sum())
            ends = np.cumsum(sizes)
            gradients = np.zeros((len(words), DIM), np.float32)
            for i, width in enumerate(WIDTHS):
                f, d_f = model.filters[width], np.zeros_like(model.filters[width])
                d = d_top[:, i * FILTERS : (i + 1) * FILTERS]
                doc, col = np.nonzero(d)
                g, at = d[doc, col], place[doc, i * FILTERS + col]
                for j in range(width):
                    ok = at + j < ends[doc]
                    x = word[at[ok] + j]
                    e = model.table[words[x]].sum(1)
                    np.add.at(d_f[j].T, col[ok], g[ok, None] * e)
                    np.add.at(gradients, x, g[ok, None] * f[j].T[col[ok]])
                grown[width] += d_f * d_f
                model.filters[width] = f - rate * d_f / np.sqrt(grown[width])
            used = np.flatnonzero(np.abs(gradients).sum(1))
            rows, g = words[used].ravel(), np.repeat(gradients[used], words.shape[1], axis=0)
            np.add.at(grown["t"], rows, (g * g).mean(1))
            np.subtract.at(model.table, rows, rate * g / np.sqrt(grown["t"][rows])[:, None])
            grown["w"] += d_w * d_w
            model.weights -= rate * d_w / np.sqrt(grown["w"])
            grown["b"] += d_b * d_b
            model.bias -= rate * d_b / np.sqrt(grown["b"])
    return model


def raw_scores(model: Model, docs: list[Packed | np.ndarray]) -> np.ndarray:
    out = np.zeros(len(docs))
    for lo in range(0, len(docs), 64):
        some = docs[lo : lo + 64]
        words, word = joined(some)
        top, _ = pooled(model, words, word, np.array([len(d) for d in some]))
        out[lo : lo + len(some)] = np.maximum(top, 0) @ model.weights + model.bias
    return out


def best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap at which F1 is highest; the widest such gap of several."""
    order = np.argsort(-z)
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(z) + 1) + y.sum())
    high = z[order]
    gap = np.append(high[:-1] - high[1:], 1.0)
    f1 = np.where(gap > 1e-9, f1, -1)
    k = max(np.flatnonzero(f1 >= f1.max() - 1e-12), key=lambda i: gap[i])
    return float(high[k] - gap[k] / 2)


def best_step(step: np.ndarray, hits: np.ndarray, count: np.ndarray) -> float:
    """best_cut of scores known as counts: step (in STEPS of 1), toxic texts and all texts of each."""
    order = np.argsort(-step)
    high = (step[order] + 0.5) / STEPS
    f1 = 2 * np.cumsum(hits[order]) / (np.cumsum(count[order]) + hits.sum())
    gap = np.append(high[:-1] - high[1:], 1.0)
    k = max(np.flatnonzero(f1 >= f1.max() - 1e-12), key=lambda i: gap[i])
    return float(high[k] - gap[k] / 2)


def fit(docs: list[Packed], labels: np.ndarray) -> tuple[Model, np.ndarray]:
    """Trains on four fifths, calibrates on the rest; the model and which texts it was trained on."""
    set_aside = np.arange(len(docs)) % 5 == 4
    if len(set(labels[~set_aside])) < 2 or len(set(labels[set_aside])) < 2:
        set_aside[:] = False
    model = train([d for d, s in zip(docs, set_aside, strict=True) if not s], labels[~set_aside])
    at = np.flatnonzero(set_aside) if set_aside.any() else np.arange(len(docs))
    z, y = raw_scores(model, [docs[i] for i in at]), labels[at]
    cut = best_cut(z, y)
    apart = np.median(z[y == 1]) - np.median(z[y == 0])
    model.scale = float(np.clip(6 / max(apart, 1e-3), 0.3, 3))
    model.shift = float(np.log(CUT / (1 - CUT)) - model.scale * cut)
    return model, ~set_aside


def thresholds(scored: DataFrame, least: int = LEAST) -> dict[str, float]:
    """Each language's cut; scored: lang, label, score. At most STEPS rows a language and label come to the driver."""
    step = F.floor(F.col("score") * STEPS).cast("int").alias("step")
    by = scored.groupBy(F.coalesce("lang", F.lit("")).alias("lang"), step).agg(F.sum("label").alias("hits"), F.count("*").alias("n")).toArrow().to_pandas()
    out = {}
    for name, own in by.groupby("lang"):
        hits, n = own["hits"].to_numpy(), own["n"].to_numpy()
        if min(hits.sum(), (n - hits).sum()) >= least:
            out[name] = float(np.clip(best_step(own["step"].to_numpy(), hits, n), 0.5, 0.9))
    return out


def _packed(rows: DataFrame) -> DataFrame:
    """The sample's features; columns: doc_id, text, label."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = utf8(b.column(1))
            words, places = [], []
            for i in range(len(at) - 1):
                w = Words(data, at, i, i + 1, NOT_ALNUM)
                _, first, word = np.unique(w.hash, return_index=True, return_inverse=True)
                words.append(features(w)[first].tobytes())
                places.append(word.astype(np.int32).tobytes())
            yield pa.record_batch([b.column(0), b.column(2), pa.array(words, pa.binary()), pa.array(places, pa.binary())], ["doc_id", "label", "words", "places"])

    return rows.mapInArrow(of, "doc_id long, label int, words binary, places binary")


def learn(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", may_learn: object = None, per_class: int = PER_CLASS, least: int = LEAST) -> Model | None:
    """The model of a bounded sample of the labelled rows of docs, with thresholds from the other labelled rows."""
    spark = prepare(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    if may_learn is not None:
        known = known.where(may_learn)
    mixed = F.xxhash64("doc_id")
    there = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().join(known, "doc_id")
    ids = None
    for y in (0, 1):
        part = there.where(F.col("label") == y).orderBy(mixed, "doc_id").limit(per_class)
        ids = part if ids is None else ids.unionByName(part)
    ids = keep(ids)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # ids is bounded: 2 * per_class rows
    rows = texts.join(F.broadcast(ids), "doc_id").select("doc_id", "text", "label")
    sample = _packed(rows).dropDuplicates(["doc_id"]).toArrow()
    if len(set(sample["label"].to_pylist())) < 2:
        return None
    order = np.lexsort((sample["doc_id"].to_numpy(), _spread(sample["doc_id"].to_numpy())))
    sample = sample.take(pa.array(order))
    found = [Packed(np.frombuffer(w.as_buffer(), np.int32).reshape(-1, 1 + len(PARTS)), np.frombuffer(p.as_buffer(), np.int32)) for w, p in zip(sample["words"], sample["places"], strict=True)]
    labels_, names = sample["label"].to_numpy().astype(np.int64), sample["doc_id"].to_numpy()
    del sample
    try:
        model, trained = fit(found, labels_)
    finally:
        del found
        pa.default_memory_pool().release_unused()
    # at most 2 * per_class ids
    seen = spark.createDataFrame(pa.table({"doc_id": names[trained]}))
    # all rows are scored and only their scores meet the labels: no text is shuffled
    scored = toxicity(docs, model).select("doc_id", "lang", "score")
    model.thresholds = thresholds(scored.join(F.broadcast(seen), "doc_id", "left_anti").join(known, "doc_id").select("lang", "label", "score"), least)
    return model


def _spread(ids: np.ndarray) -> np.ndarray:
    from streamcontract.llm.common import mix

    return mix(ids.astype(np.int64).view(np.uint64))


def toxicity(docs: DataFrame, model: Model | None, carry: Sequence[str] = ()) -> DataFrame:
    """docs' columns doc_id, lang and, of the whole text, score double and toxic boolean (score >= the language's threshold); in_<c> is the row's own column c of carry."""
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), *(F.col(c).alias(f"in_{c}") for c in carry if c != "text"))
    rest = [f"in_{c}" for c in carry if c != "text"]
    names = ["in_text", *rest] if "text" in carry else rest
    given = rows.withColumn("in_text", F.col("text"))
    if model is None:
        return given.select("doc_id", "lang", F.lit(0.0).alias("score"), F.lit(False).alias("toxic"), *names)
    schema = StructType([*StructType.fromDDL("doc_id long, lang string, score double, toxic boolean"), *(given.schema[c] for c in names)])
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            data, at = utf8(b.column(1))
            z = np.zeros(len(at) - 1)
            for lo, hi in runs(at):
                w = Words(data, at, lo, hi, NOT_ALNUM)
                _, first, word = np.unique(w.hash, return_index=True, return_inverse=True)
                top, _ = pooled(model, features(w)[first], word, np.bincount(w.doc, minlength=hi - lo))
                z[lo:hi] = np.maximum(top, 0) @ model.weights + model.bias
            s = model.score(z)
            cuts = np.array([model.thresholds.get(x or "", CUT) for x in b.column(2).to_pylist()])
            yield pa.record_batch([b.column(0), b.column(2), pa.array(s), pa.array(s >= cuts), *([b.column(1)] if "in_text" in names else []), *b.columns[3:]], ["doc_id", "lang", "score", "toxic", *names])

    return rows.mapInArrow(score, schema)


def filter_toxicity(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs that are not toxic, with all their columns; each row is decided by its own text."""
    return toxicity(docs, model, docs.columns).where(~F.col("toxic")).select(*(F.col(f"in_{c}").alias(c) for c in docs.columns))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"), may_learn=remainder(F.col("doc_id"), 3) != 1)
    out = toxicity(docs, model)
    return out.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "toxic")
