"""Exact top-k inner-product search by distributed histogram selection.

Vectors are scaled to integers, so scores are exact integers. For a block of
queries the norms bound every score. Each round scores all rows against the
block and adds up, per query, a histogram of the scores inside the query's
present range; the bin that holds the k-th highest score becomes the next range,
until the range is one integer wide: the k-th score itself. A last pass keeps the
rows above it and, of those that tie with it, each task's smallest ids, as many
as are still needed; a ranking by (score, id) finishes.

Queries go in blocks of bounded size (`block` rows at most in expectation), which
is all that is broadcast; the rest of the rows are never collected or shuffled.
What a task sends is one sparse histogram per query, at most `bins` long, or at
most `2 k` rows a query. A block's result is written before the next one starts, so the
plan does not grow with the number of blocks.

Cases: null vectors, vectors with null or non-finite components and rows with a
null id take no part. Candidates have the query's length. Rows of one query id are
queries of their own whose scores are ranked together; a query's own id is never a
candidate; repeated candidate rows are ranked each. Ties go to the smaller id. A
scaled component beyond 64 bits is the nearest long; sums of products are exact
however large, and a score beyond 64 bits is the nearest long (the least one excepted).
Without queries or candidates the result is empty.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from streamcontract.llm.common import keep, prepare, shared_dir, table

BLOCK, BINS, ROWS = 2048, 1024, 2048


def integer_vectors(df: DataFrame, id_column: str, vector: str, scale: int) -> DataFrame:
    """vec_id long, v array<long>: floor(scale * x) of each component; rows that take no part are left out."""
    x = F.col(vector).cast("array<double>")
    finite = F.forall("x", lambda a: F.coalesce(~F.isnan(a) & (F.abs(a) < F.lit(float("inf"))), F.lit(False)))
    return df.select(F.col(id_column).cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull()).where(finite).select("vec_id", F.transform("x", lambda a: F.floor(a * scale)).cast("array<long>").alias("v"))


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of rows with the same vector length."""
    for b in batches:
        ids, vectors = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
        lengths = np.diff(vectors.offsets.to_numpy())
        values = vectors.flatten().to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        for n in np.unique(lengths):
            rows = np.flatnonzero(lengths == n)
            for i in range(0, len(rows), ROWS):
                part = rows[i : i + ROWS]
                yield ids[part], values[starts[part][:, None] + np.arange(n)] if n else np.zeros((len(part), 0), np.int64)


#: Scores lie between -LIMIT and LIMIT.
LIMIT = (1 << 63) - 1


def _exact(m: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Inner products in unbounded integers, cut off at the limits of a score."""
    out = m.astype(object) @ matrix.T.astype(object)
    return np.clip(out, -LIMIT, LIMIT).astype(np.int64) if m.shape[1] else np.zeros((len(m), len(matrix)), np.int64)


def _scores(q: dict[int, tuple[np.ndarray, np.ndarray]], m: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Query numbers and exact integer scores (rows x queries)."""
    if (got := q.get(m.shape[1])) is None:
        return None
    numbers, matrix = got
    # up to `cut` doubles hold every sum; the few rows and queries with larger components are worked out apart
    cut = (2**53 / max(1, m.shape[1])) ** 0.5
    large, great = (np.abs(x.astype(np.float64)).max(1, initial=0) >= cut for x in (m, matrix))
    plain = m.astype(np.float64), matrix.astype(np.float64)
    plain[0][large], plain[1][great] = 0, 0
    out = (plain[0] @ plain[1].T).astype(np.int64)
    if large.any():
        out[large] = _exact(m[large], matrix)
    if great.any():
        out[:, great] = _exact(m, matrix[great])
    return numbers, out


def _by_length(vectors: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    out: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        out.setdefault(len(v), []).append(i)
    return {n: (np.array(i), np.array([vectors[j] for j in i], np.int64).reshape(len(i), n)) for n, i in out.items()}


def search_block(rows: DataFrame, queries: pd.DataFrame, k: int, bound: int, bins: int = BINS) -> DataFrame:
    """query_id, vec_id, score of the k best rows of each query (ties cut by id), for one bounded block of queries."""
    spark = rows.sparkSession
    own = queries["vec_id"].to_numpy(np.int64)
    shared = spark.sparkContext.broadcast((own, _by_length(list(queries["v"]))))
    n = len(own)
    bound = min(bound, LIMIT)
    low, width = np.full(n, -bound, object), np.full(n, 2 * bound + 1, object)  # the range that holds the k-th score, in unbounded integers
    above = np.zeros(n, np.int64)  # candidates over the range
    short = np.zeros(n, bool)  # fewer than k candidates: all are taken
    while (width[~short] > 1).any():
        step = np.maximum(1, -(-width // bins))
        now = spark.sparkContext.broadcast((low.astype(np.int64), width.astype(np.uint64), step.astype(np.uint64), short.copy()))

        def histogram(batches: Iterable[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            own, by_length = shared.value
            low, width, step, short = now.value
            total: dict[int, np.ndarray] = {}
            for ids, m in _blocks(batches):
                if (got := _scores(by_length, m)) is None:
                    continue
                numbers, s = got
                over = s.view(np.uint64) - low.view(np.uint64)[numbers]  # distance, where s >= low
                good = (s >= low[numbers]) & (over < width[numbers]) & (ids[:, None] != own[numbers]) & ~short[numbers]
                at = (np.broadcast_to(np.arange(len(numbers)), s.shape) * bins + (over // step[numbers]).astype(np.int64))[good]
                h = np.bincount(at, minlength=len(numbers) * bins)
                key = m.shape[1]
                total[key] = total[key] + h if key in total else h
            for key, h in total.items():
                cells = np.flatnonzero(h)
                numbers = by_length[key][0]
                yield pa.record_batch([pa.array(numbers[cells // bins]), pa.array(cells % bins), pa.array(h[cells])], ["q", "bin", "n"])

        found = rows.mapInArrow(histogram, "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        # per query only the bin that holds the k-th score comes to the driver
        down = Window.partitionBy("q").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
        need = spark.createDataFrame(pd.DataFrame({"q": np.arange(n), "need": k - above}))
        ranked = found.withColumn("reach", F.sum("n").over(down)).join(F.broadcast(need), "q")
        hit = ranked.where(F.col("reach") >= F.col("need")).groupBy("q").agg(F.max_by(F.struct("bin", "n", "reach"), "bin").alias("x")).select("q", "x.*").toPandas()
        seen = np.zeros(n, bool)
        q, b = hit["q"].to_numpy(np.int64), hit["bin"].to_numpy(np.int64)
        seen[q] = True
        above[q] += (hit["reach"] - hit["n"]).to_numpy(np.int64)
        b = b.astype(object)
        end = np.minimum(low[q] + (b + 1) * step[q], low[q] + width[q])
        low[q] += b * step[q]
        width[q] = end - low[q]
        short |= ~seen
    low[short], above[short] = -bound, 0
    last = spark.sparkContext.broadcast((low.astype(np.int64), k - above, short))

    def take(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, by_length = shared.value
        kth, need, short = last.value
        best: list[list[np.ndarray]] = [[], [], []]

        def cut(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
            """Of ties with the k-th score, each query's smallest ids that are still needed."""
            q, ids, s = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in parts)
            tie = (s == kth[q]) & ~short[q]
            order = np.lexsort((ids, q, ~tie))  # ties first, by query and id
            q, ids, s, tie = q[order], ids[order], s[order], tie[order]
            m = int(tie.sum())
            first = np.searchsorted(q[:m], q[:m], "left")
            good = np.concatenate([np.arange(m) - first < need[q[:m]], np.ones(len(q) - m, bool)])
            return [q[good], ids[good], s[good]]

        held = 0
        for ids, m in _blocks(batches):
            if (got := _scores(by_length, m)) is None:
                continue
            numbers, s = got
            r, c = np.nonzero((s >= kth[numbers]) & (ids[:, None] != own[numbers]))
            for x, y in zip(best, (numbers[c], ids[r], s[r, c]), strict=True):
                x.append(y)
            held += len(r)
            if held > 1 << 18:
                best = [[x] for x in cut(best)]
                held = 0
        q, ids, s = cut(best)
        yield pa.record_batch([pa.array(own[q]), pa.array(ids), pa.array(s)], ["query_id", "vec_id", "score"])

    return rows.mapInArrow(take, "query_id long, vec_id long, score long")


def exact_topk(df: DataFrame, is_query: object, *, k: int = 10, id_column: str = "vec_id", vector: str = "embedding", scale: int = 1024, block: int = BLOCK, bins: int = BINS) -> DataFrame:
    """query_id long, rank int, vec_id long, score long. `is_query` is a condition on the column vec_id."""
    spark = prepare(df.sparkSession)
    rows = keep(integer_vectors(df, id_column, vector, scale))
    queries = keep(rows.where(is_query))
    sizes = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)).alias("n2")).first()
    bound = int(math.ceil(math.sqrt(sizes["n2"] or 0.0) * (1 + 1e-9) + 1)) ** 2 + 1  # no inner product exceeds the largest squared norm
    n = queries.count()
    blocks = max(1, -(-2 * n // block)) if n > block else 1
    folder = f"{shared_dir(spark)}/topk-{uuid.uuid4().hex}"
    queries = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)))
    for i in range(blocks):
        chosen = queries.where(F.col("block") == i).select("vec_id", "v").toPandas()
        if len(chosen):
            search_block(rows, chosen, k, bound, bins).write.parquet(f"{folder}/block={i}")
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    result = spark.read.schema("query_id long, vec_id long, score long").parquet(folder)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return result.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
