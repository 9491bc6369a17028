"""Mixing sources to target weights by entropy balancing.

Sources weigh 1, 2, 3, repeating, in the order of their code points (null last).
All sizes together are shared by weight; a source stops at `most` times its size
and the excess is shared again, until none is above: by distributed rounds over
the table of sources.

Inside a source the rates w_i of its texts minimise the relative entropy to equal
rates under sum(w_i size_i) = target and w_i <= most. The solution is
min(most, exp(lambda * size_i / scale)), scale being the source's size-weighted
mean size, so the convex dual has one lambda a source.
Newton's iterations run for all sources at once as joins and aggregations over the
table (source, size, how many): gradient and curvature are sums over it. The
smallest text bounds lambda from both sides; an iteration that leaves the bracket,
and each eighth one, halves it instead. They go on until every source reaches its
target to a billionth; `solve_rates` raises if one does not.

Rates become whole copies in two steps. Over a source's different sizes, the largest
first, all texts of a size together get the whole number of copies that keeps the
running miss least; so a source misses its target by about its smallest text. The
copies of a size are dealt out evenly by rank: the i-th of m texts takes
floor(i k / m) - floor((i - 1) k / m). Ranks are counted in `DEALS` groups by the id's
hash, so that no task holds all texts of one source or size; only a source's table of
sizes (no longer than its longest text) meets in one task. All sums that decide
are of integers or decimals, so the order in which tasks end does not matter.

Cases: null and empty texts have size 0 and are not taken; null sources are one
source, the last; sources with no words have target 0; repeated rows are texts of
their own; a null doc_id is kept as null; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from streamcontract.llm.common import fresh, keep, prepare, table

WEIGHTS, MOST, ROUNDS, DEALS = (1.0, 2.0, 3.0), 3, 1000, 256
PER_PARTITION = 100_000  # rows of the small tables
EXACT = "decimal(38,9)"  # of a word


def word_count(text: Column) -> Column:
    """How often [^\\x20\\x09-\\x0D]+ occurs."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ranked_sources(histogram: DataFrame) -> DataFrame:
    """source, last, total, weight: one row a source. Ranks come from a range partitioning and the partitions' counts."""
    by = histogram.groupBy("source", "last").agg(F.sum(F.col("m") * F.col("size")).alias("total"))
    by = keep(by.repartitionByRange(F.col("last"), F.col("source")).withColumn("part", F.spark_partition_id()))
    counts = sorted((r["part"], r["count"]) for r in by.groupBy("part").count().collect())  # one row a partition
    before = dict(zip([p for p, _ in counts], np.cumsum([0, *(c for _, c in counts)])[:-1].tolist(), strict=True))
    spark = histogram.sparkSession
    offsets = spark.createDataFrame(pa.table({"part": pa.array(before.keys(), pa.int32()), "before": pa.array(before.values(), pa.int64())}))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("last", "source")) - 1 + F.col("before")
    weights = F.array(*(F.lit(w) for w in WEIGHTS))
    return by.join(F.broadcast(offsets), "part").select("source", "last", "total", F.element_at(weights, (rank % len(WEIGHTS) + 1).cast("int")).alias("weight"))


def targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """Adds target: weights shared out, capped at most * total, the excess shared again until none is above."""
    total = sources.agg(F.sum("total").alias("t")).first()["t"] or 0
    level, cap = 0.0, F.col("total") * float(most)
    while True:
        capped = F.col("weight") * level >= cap
        got = sources.agg(F.sum(F.when(~capped, F.col("weight"))).alias("w"), F.sum(F.when(capped, cap)).alias("c"), F.count("*").alias("n")).first() if level else sources.agg(F.sum("weight").alias("w"), F.lit(0.0).alias("c")).first()
        if not got["w"]:
            break
        new = (total - (got["c"] or 0.0)) / got["w"]
        if new <= level * (1 + 1e-15):
            break
        level = new
    return sources.withColumn("target", F.least(F.col("weight") * level, cap))


def solve_rates(histogram: DataFrame, sources: DataFrame, most: int = MOST, rounds: int = ROUNDS) -> DataFrame:
    """source key, lambda, scale. histogram: source, last, size, m; sources: with target and total.

    Raises if a source is not at its target after `rounds` rounds, which is far more than halving alone needs.
    """
    on = ["source", "last"]
    words = F.col("m").cast("decimal(19,0)") * F.col("size")
    scale = histogram.groupBy(*on).agg((F.sum((words * F.col("size")).cast("decimal(38,0)")).cast("double") / F.sum(words).cast("double")).alias("scale"), F.min("size").alias("least"))
    state = sources.join(scale, (sources["source"].eqNullSafe(scale["source"])) & (sources["last"] == scale["last"])).select(sources["source"], sources["last"], "total", "target", "scale", "least")
    top = math.log(most)
    # at lambda = x * scale / least all texts have a rate of at least exp(x), for x > 0, or at most that, for x < 0; the bracket is a little wider
    reach = 1.001 * F.col("scale") / F.col("least")
    low = F.when(F.col("target") < F.col("total"), F.log(F.col("target") / F.col("total")) * reach).otherwise(0.0) - 1e-3
    # a source that is taken whole `most` times, or not at all, needs no search
    state = state.withColumns({"lam": F.lit(0.0), "low": low, "high": top * reach + 1e-3, "done": (F.col("target") >= F.col("total") * most * (1 - 1e-12)) | (F.col("target") <= 0)})
    # small tables in few partitions, so that a round costs few files
    few = lambda df: fresh(df.coalesce(max(1, n // PER_PARTITION)))
    n = sources.count()
    state = few(state.drop("least"))
    n_sizes = histogram.count()
    histogram = keep(histogram.coalesce(max(1, n_sizes // PER_PARTITION)))
    for i in range(rounds):
        if not state.where("NOT done").limit(1).count():
            return state
        s = state.where("NOT done").alias("s")
        h = histogram.alias("h")
        e = F.least(F.col("lam") * F.col("size") / F.col("scale"), F.lit(top))
        joined = h.join(s, F.col("h.source").eqNullSafe(F.col("s.source")) & (F.col("h.last") == F.col("s.last")))
        mass = F.col("m") * F.col("size") * F.exp(e)
        same = ["total", "target", "scale", "lam", "low", "high"]
        sums = joined.groupBy(F.col("s.source").alias("source"), F.col("s.last").alias("last")).agg(
            F.sum(mass.cast(EXACT)).cast("double").alias("reached"), F.sum(F.when(e < top, mass * F.col("size") / F.col("scale")).otherwise(0.0).cast(EXACT)).cast("double").alias("slope"), *(F.first(F.col(f"s.{c}")).alias(c) for c in same)
        )
        miss = F.col("reached") - F.col("target")
        low, high = F.when(miss < 0, F.col("lam")).otherwise(F.col("low")), F.when(miss > 0, F.col("lam")).otherwise(F.col("high"))
        newton = F.col("lam") - miss / F.when(F.col("slope") > 0, F.col("slope"))
        inside = F.coalesce((newton > low) & (newton < high), F.lit(False)) if i % 8 < 7 else F.lit(False)
        moved = F.abs(miss) > 1e-9 * F.col("target")
        after = sums.select(
            "source", "last", "total", "target", "scale",
            F.when(moved, F.when(inside, newton).otherwise((low + high) / 2)).otherwise(F.col("lam")).alias("lam"),
            F.when(moved, low).otherwise(F.col("low")).alias("low"), F.when(moved, high).otherwise(F.col("high")).alias("high"), (~moved).alias("done"),
        )
        state = few(after.unionByName(state.where("done").select(*after.columns)))
    left = state.where("NOT done")
    if n := left.count():
        raise RuntimeError(f"{n} sources have not reached their target after {rounds} rounds, {left.first()['source']!r} among them")
    return state


def round_copies(size: np.ndarray, m: np.ndarray, rate: np.ndarray, most: int = MOST) -> np.ndarray:
    """Copies of all m texts of each size together: from the largest size down, what keeps the running miss least."""
    out = np.zeros(len(size), np.int64)
    miss = 0.0
    for i in np.argsort(-size, kind="stable").tolist():
        if s := float(size[i]):
            miss += float(m[i]) * rate[i] * s
            out[i] = min(most * int(m[i]), max(0, math.floor(miss / s + 0.5)))
            miss -= float(out[i]) * s
    return out


def mix(docs: DataFrame, *, most: int = MOST, deals: int = DEALS, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every row of docs (doc_id, source, text); in_<c> is the row's own column c of carry."""
    prepare(docs.sparkSession)
    text, doc_id, source = F.col("text").cast("string"), F.col("doc_id").cast("long"), F.col("source").cast("string")
    own = F.pmod(F.xxhash64(doc_id, F.lit(3)), F.lit(deals)).cast("int")
    null = F.pmod(F.xxhash64(text), F.lit(deals)).cast("int")
    columns = [doc_id.alias("doc_id"), F.coalesce(source, F.lit("")).alias("source"), source.isNull().alias("last"), word_count(text).alias("size"), F.when(doc_id.isNull(), null).otherwise(own).alias("g"), F.xxhash64(text).alias("h")]
    sizes = keep(docs.select(*columns))
    groups = keep(sizes.groupBy("source", "last", "size", "g").agg(F.count("*").alias("n")))
    histogram = groups.groupBy("source", "last", "size").agg(F.sum("n").alias("m"))
    histogram = keep(histogram.coalesce(max(1, groups.count() // PER_PARTITION)))
    sources = keep(targets(ranked_sources(histogram), most))
    texts = histogram.where("size > 0")
    state = solve_rates(texts, sources, most)
    on = ["source", "last"]
    per_source = sources.select(*on, F.col("total").alias("source_size"), "target").join(state.select(*on, "lam", "scale"), on, "left")
    full = F.col("target") >= F.col("source_size") * most * (1 - 1e-12)
    rate = F.when(full, F.lit(float(most))).when(F.col("target") <= 0, 0.0).otherwise(F.least(F.lit(float(most)), F.exp(F.least(F.col("lam") * F.col("size") / F.col("scale"), F.lit(math.log(most))))))
    rates = texts.join(per_source, on).select(*on, "size", "m", F.coalesce(rate, F.lit(0.0)).alias("rate"))

    def whole(t: pa.Table) -> pa.Table:
        return t.drop_columns(["rate"]).append_column("k", pa.array(round_copies(*(t[c].to_numpy() for c in ("size", "m", "rate")), most)))

    planned = rates.groupBy(*on).applyInArrow(whole, "source string, last boolean, size long, m long, k long")
    before = Window.partitionBy("source", "last", "size").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    dealt = groups.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(planned, [*on, "size"], "left").join(per_source.select(*on, "source_size", "target"), on)
    key = [*on, "size", "g"]
    # what is carried is shuffled once, and never stored here
    each = docs.select(*columns, *(F.col(c).alias(f"in_{c}") for c in carry)) if carry else sizes
    ranked = each.withColumn("i", F.row_number().over(Window.partitionBy(*key).orderBy("doc_id", "h")))
    rows = ranked.join(dealt, key).withColumn("i", (F.col("before") + F.col("i")).cast("decimal(19,0)"))
    rows = rows.withColumn("copies", F.expr("CASE WHEN size > 0 THEN CAST(i * CAST(k AS DECIMAL(19,0)) DIV m - (i - 1) * CAST(k AS DECIMAL(19,0)) DIV m AS LONG) ELSE 0L END"))
    return rows.select("doc_id", F.when(~F.col("last"), F.col("source")).alias("source"), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(f"in_{c}" for c in carry))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")
