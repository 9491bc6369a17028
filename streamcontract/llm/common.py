"""What the operators share: the shared folder, Arrow text buffers and vectorised word hashes.

Texts are handled as whole UTF-8 buffers. A batch of rows is cut into runs of
whole documents of about ``RUN_BYTES``; inside a run all work is numpy over the
concatenated bytes, so memory stays at a small multiple of ``RUN_BYTES`` however
many rows a batch has. A single longer document is a run of its own.
"""

from __future__ import annotations

import gc
import os
import re
import tempfile
import time
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_BYTES = 1 << 20
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> SparkSession:
    """Makes checkpoint() usable and lets Python workers import this package.

    The folder is the one the cluster names in spark.checkpoint.dir. Where that is
    unset a local session, as in tests, gets a temporary one; on a cluster this raises.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that the driver and the executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    paths = [x for x in sc.environment.get("PYTHONPATH", "").split(os.pathsep) if x]
    if ROOT not in paths:
        sc.environment["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application in the shared one, for tables that an operator writes itself; it goes when the application ends."""
    sc = prepare(spark).sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    path = f"{top}/tables-{sc.applicationId}"
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(at):
        fs.mkdirs(at)
        fs.deleteOnExit(at)
    return path


def drop_table(spark: SparkSession, path: str) -> None:
    """Removes a table that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: The part of the driver's heap that may be committed before tidy() collects it, and the least seconds between two turns of tidy().
COMMITTED, EVERY = 0.4, 3.0
#: What a collection leaves free of the committed heap, in percent: HotSpot's own limit of 70 keeps over three times what is in use.
FREE = {"MinHeapFreeRatio": 20, "MaxHeapFreeRatio": 40}
_tidied = [0.0]


def _shrinking(jvm: object) -> None:
    """Sets FREE, which HotSpot lets a running JVM set. Other JVMs keep their own way."""
    try:
        kind = jvm.java.lang.Class.forName("com.sun.management.HotSpotDiagnosticMXBean")
        options = jvm.java.lang.management.ManagementFactory.getPlatformMXBean(kind)
        if int(options.getVMOption("MaxHeapFreeRatio").getValue()) > FREE["MaxHeapFreeRatio"]:
            for name, percent in FREE.items():  # the lower one first: it may not pass the other
                options.setVMOption(name, str(percent))
    except (AttributeError, Py4JError):
        pass


def tidy(spark: SparkSession) -> None:
    """Gives memory of the driver back to the system: operators of many jobs leave garbage that the JVM else keeps until its heap is full.

    Finished shuffles and broadcasts of the executors go with it. FREE holds for the whole JVM from the first collection on.
    """
    if time.monotonic() - _tidied[0] < EVERY:
        return
    jvm = spark.sparkContext._jvm
    runtime = jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() > COMMITTED * runtime.maxMemory():
        gc.collect()
        _shrinking(jvm)
        jvm.java.lang.System.gc()
    _tidied[0] = time.monotonic()


#: The least seconds between two turns of tidy_executors().
EXECUTORS_EVERY = 10.0
_rested = [0.0]


def tidy_executors(spark: SparkSession) -> None:
    """tidy() for executors in JVMs of their own: theirs keep the largest heap that any job needed, beside Python workers that the heap's limit knows nothing of.

    One short task for each executor, while no other job of the operator runs.
    """
    if time.monotonic() - _rested[0] < EXECUTORS_EVERY:
        return
    n = spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1  # the driver is one of them
    if n > 0:
        spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).collect()
    _rested[0] = time.monotonic()


def keep(df: DataFrame) -> DataFrame:
    """Materialises df in the shared folder and cuts its lineage."""
    prepare(df.sparkSession)
    out = df.checkpoint(eager=True)
    tidy(df.sparkSession)
    tidy_executors(df.sparkSession)
    return out


def stored(df: DataFrame) -> DataFrame:
    """df written as a Parquet table of the shared folder: smaller than a checkpoint for large tables."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    tidy(spark)
    tidy_executors(spark)
    return spark.read.parquet(path)


def fresh(df: DataFrame) -> DataFrame:
    """keep(), for tables of loops: forgets the constraints that the optimizer derived, which else multiply from turn to turn."""
    kept = keep(df)
    session = df.sparkSession
    return DataFrame(session._jsparkSession.createDataFrame(kept._jdf.toJavaRDD(), kept._jdf.schema()), session)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def collected(df: DataFrame) -> pd.DataFrame:
    """A table of bounded size on the driver, by Arrow: no Python object a row."""
    out = df.toArrow().to_pandas()
    pa.default_memory_pool().release_unused()
    return out


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


_made: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def once(shared: object, build: Callable[[object], object]) -> object:
    """What build makes of a broadcast's value: made once in a worker, and gone with the broadcast, so that workers of later stages do not hold it."""
    if shared not in _made:
        _made[shared] = build(shared.value)
    return _made[shared]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- Arrow text


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column and the n + 1 offsets into them; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def runs(at: np.ndarray, limit: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about `limit` bytes each."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def slices(data: np.ndarray, at: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the texts with those over `limit` bytes cut in front of white space, and the text of each slice. A longer word stays whole."""
    out, doc = [int(at[0])], []
    long = np.diff(at) > limit
    if not long.any():
        return at, np.arange(len(at) - 1)
    for i in range(len(at) - 1):
        end = int(at[i + 1])
        if long[i]:
            place = out[-1] + limit
            while place < end:
                near = WHITE[data[place : min(end, place + (1 << 16))]]
                if near.any():
                    place += int(near.argmax())
                    out.append(place)
                    doc.append(i)
                    place += limit
                else:
                    place += len(near)
        out.append(end)
        doc.append(i)
    return np.array(out, np.int64), np.array(doc, np.int64)


# ---------------------------------------------------------------- word hashes

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII but letters and digits.
NOT_ALNUM = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on unsigned 64-bit integers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_powers: list[np.ndarray] = []


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, RUN_BYTES + 4096)
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[:] = [np.concatenate([[_U(1)], np.full(size - 1, x, np.uint64)]).cumprod(dtype=np.uint64) for x in (_BASE, inverse)]
    return _powers[0][:n], _powers[1][:n]


class Words:
    """The words of a run of documents: byte ranges, document numbers and 64-bit hashes of lower-cased bytes."""

    __slots__ = ("cum", "doc", "end", "hash", "inverse", "n_docs", "start")

    def __init__(self, data: np.ndarray, at: np.ndarray, lo: int, hi: int, separators: np.ndarray = WHITE) -> None:
        base = int(at[lo])
        raw = LOWER[data[base : int(at[hi])]]
        edges = (at[lo : hi + 1] - base).astype(np.int64)
        n = len(raw)
        self.n_docs = hi - lo
        inside = np.zeros(n + 2, bool)
        inside[1 : n + 1] = ~separators[raw]
        first = inside[1 : n + 1] & ~inside[:n]
        last = inside[1 : n + 1] & ~inside[2:]
        cuts = edges[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        first[cuts] = inside[cuts + 1]
        last[cuts - 1] = inside[cuts]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(edges, self.start, "right") - 1
        power, self.inverse = _pow(n + 1)
        self.cum = np.zeros(n + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + _U(1)) * power[:n], out=self.cum[1:])
        self.hash = self.part(self.start, self.end)

    def part(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes of each range."""
        return mix((self.cum[end] - self.cum[start]) * self.inverse[start] + (end - start).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def counts_by_doc(doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, minlength=n).astype(np.int64)
