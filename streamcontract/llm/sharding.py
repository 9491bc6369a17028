"""Sharding with size-tiered compaction and a versioned manifest, in DataFrame functions alone.

A store is a folder: runs/<name>/ hold immutable Parquet shards, manifests/<name>/
hold the rows of one manifest each, versions/<n> names the manifest of version n.

 * `append` writes arrivals as small shards, one run an arrival, without a shuffle:
   each task writes what it has read, one file for each arrival in it.
 * `compact` puts the runs of the present version into tiers by size (a tier spans a
   factor of `fan_in`); a tier with `fan_in` runs or more is merged into one run without
   a shuffle: whole files, the largest first, are packed into tasks of up to `target`
   bytes, and a task writes one file. Runs whose files have reached the target are
   sealed and never read again. This repeats until no tier is full, so a row is
   rewritten about log(size / smallest) times to base fan_in.
 * `commit` writes the manifest rows under a new name and then publishes versions/<n>
   by a rename that does not overwrite: of two writers one gets a ConflictError, a
   writer that dies leaves the version before, and readers see either version whole.

A row of the manifest is a shard: run, file, rows, bytes, tier, least and greatest
id, and an order-free checksum of the rows' ids. `vacuum` removes runs that no version later
than `keep_versions` ago names and that are older than `grace` seconds, so what another
writer is about to commit stays. A failed job leaves only unnamed runs.

Cases: an empty table commits a version without shards; nulls, empty and very long
texts and repeated rows are stored as they are; all columns of the table are kept
whatever their names: the arrival's and the file's columns get names that the table
does not have.
"""

from __future__ import annotations

import math
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streamcontract.llm.common import shared_dir, table
from streamcontract.sources.tables import ConflictError, Versions

TARGET, FAN_IN, SMALLEST, GRACE = 64 << 20, 4, 64 << 10, 24 * 3600.0
SHARDS = "run string, file string, rows long, bytes long, tier int, first_id long, last_id long, checksum decimal(38,0)"


__all__ = ["ConflictError", "Store", "op4_sharding", "shard"]


def free_name(name: str, df: DataFrame) -> str:
    """name, or one like it that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Store:
    """One sharded table. All data stay on the cluster; the driver handles a row a run (an arrival or a merge)."""

    def __init__(self, spark: SparkSession, path: str, id_column: str = "doc_id", target: int = TARGET, fan_in: int = FAN_IN) -> None:
        self.spark, self.path, self.id_column, self.target, self.fan_in = spark, path, id_column, target, fan_in
        self._versions = Versions(spark, path)
        self._path, self._fs = self._versions.at, self._versions.fs

    # ------------------------------------------------------------ versions

    def versions(self) -> list[int]:
        return self._versions.all()

    def manifest(self, version: int | None = None) -> DataFrame:
        """The shards of a version, the latest by default."""
        version = self._versions.latest() if version is None else version
        if not version:
            return self.spark.createDataFrame([], SHARDS)
        return self.spark.read.schema(SHARDS).parquet(f"{self.path}/manifests/{self._versions.get(version)}")

    def commit(self, shards: DataFrame, base: int) -> int:
        """Makes shards version base + 1; ConflictError if that version is there."""
        name = uuid.uuid4().hex
        shards.coalesce(1).write.parquet(f"{self.path}/manifests/{name}")
        return self._versions.publish(base + 1, name)

    def _latest(self) -> int:
        return self._versions.latest()

    # ------------------------------------------------------------ runs

    def _tier(self, size: Column) -> Column:
        return F.greatest(F.lit(0), F.floor(F.log(F.greatest(size, F.lit(1)) / SMALLEST) / math.log(self.fan_in))).cast("int")

    def _describe(self, folder: str, run: Column) -> DataFrame:
        """Manifest rows of the files below a folder, from ids and file metadata alone."""
        df = self.spark.read.parquet(f"{self.path}/runs/{folder}")
        of = df.metadataColumn("_metadata")
        by = df.select(F.col(self.id_column).alias("id"), of["file_path"].alias("path"), _below_runs(of["file_path"]).alias("file"), of["file_size"].alias("size"))
        shards = by.groupBy("path", "file").agg(F.count("*").alias("rows"), F.max("size").alias("bytes"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("checksum"))
        shards = shards.withColumn("run", run)
        whole = shards.groupBy("run").agg(F.sum("bytes").alias("whole"))
        # one row a run
        return shards.join(whole, "run").select("run", "file", "rows", "bytes", self._tier(F.col("whole")).alias("tier"), "first_id", "last_id", F.col("checksum").cast("decimal(38,0)").alias("checksum"))

    def append(self, df: DataFrame, arrival: Column | None = None) -> int:
        """Adds rows as small shards, one run for each value of `arrival`, and commits."""
        base, name = self._latest(), uuid.uuid4().hex
        column = free_name("__arrival", df)
        df.withColumn(column, F.lit(0) if arrival is None else arrival).write.partitionBy(column).parquet(f"{self.path}/runs/{name}")
        if not self._has_rows(name):
            return self.commit(self.manifest(), base)
        part = F.element_at(F.split("path", "/"), -2)
        return self.commit(self.manifest().unionByName(self._describe(name, F.concat(F.lit(name + "/"), part))), base)

    def _has_rows(self, name: str) -> bool:
        return any(x.isDirectory() for x in self._fs.listStatus(self._path("runs", name)))

    def compact(self) -> int:
        """Merges until no tier of unsealed runs is full; commits each round."""
        while True:
            base = self._latest()
            shards = self.manifest()
            runs = shards.groupBy("run", "tier").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("files"), F.avg("bytes").alias("mean"))
            loose = runs.where(F.col("mean") < self.target / 2)
            full = loose.groupBy("tier").agg(F.count("*").alias("n")).where(F.col("n") >= self.fan_in)
            chosen = loose.join(full, "tier", "left_semi").orderBy("tier", "run").collect()  # one row a run
            if not chosen:
                return base
            names: dict[int, list] = {}
            for r in chosen:
                names.setdefault(r["tier"], []).append(r)
            after = shards.join(self.spark.createDataFrame([(r["run"],) for r in chosen], "run string"), "run", "left_anti")
            for rows in names.values():
                name = uuid.uuid4().hex
                self._packing().read.parquet(*(f"{self.path}/runs/{r['run']}" for r in rows)).write.parquet(f"{self.path}/runs/{name}")
                after = after.unionByName(self._describe(name, F.lit(name)))
            self.commit(after, base)

    def _packing(self) -> SparkSession:
        """A session whose scans fill each task with whole files of up to `target` bytes together."""
        session = self.spark.newSession()
        for name, value in (("maxPartitionBytes", self.target), ("openCostInBytes", 0), ("minPartitionNum", 1)):
            session.conf.set(f"spark.sql.files.{name}", value)
        return session

    def vacuum(self, keep_versions: int = 1, grace: float = GRACE) -> list[str]:
        """Removes runs and manifests that none of the last versions names and that have not changed for `grace` seconds."""
        until = (time.time() - grace) * 1000
        alive: set[str] = set()
        known = self.versions()
        for v in known[-keep_versions:]:
            alive |= {r["run"] for r in self.manifest(v).select("run").distinct().collect()}  # one row a run
        gone = []
        top = self._path("runs")
        for x in self._fs.listStatus(top) if self._fs.exists(top) else []:
            name = x.getPath().getName()
            inner = [name] if name in alive else [f"{name}/{y.getPath().getName()}" for y in self._fs.listStatus(x.getPath()) if y.isDirectory()]
            for y in inner:
                if y not in alive and self._changed(y) <= until:
                    self._fs.delete(self._path("runs", y), True)
                    gone.append(y)
            if name not in alive and not any(y in alive for y in inner) and self._changed(name) <= until:
                self._fs.delete(x.getPath(), True)
        for v in known[:-keep_versions]:
            self._fs.delete(self._path("manifests", self._versions.get(v)), True)
            self._fs.delete(self._path("versions", str(v)), False)
        return gone

    def _changed(self, run: str) -> float:
        """When the run's folder, or one below it, changed last, in milliseconds."""
        at = self._path("runs", run)
        inner = [x.getModificationTime() for x in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return max([self._fs.getFileStatus(at).getModificationTime(), *inner]) if self._fs.exists(at) else 0.0

    def read(self, version: int | None = None, file_column: str | None = None) -> DataFrame:
        """The rows of a version; with their shard's name (run/file) in a column of this name if it is given."""
        shards = self.manifest(version)
        names = [r["run"] for r in shards.select("run").distinct().orderBy("run").collect()]  # one row a run
        if not names:
            raise ValueError("the store has no rows")
        df = self.spark.read.parquet(*(f"{self.path}/runs/{x}" for x in names))
        return df if file_column is None else df.select("*", _below_runs(df.metadataColumn("_metadata")["file_path"]).alias(file_column))


def _below_runs(path: Column) -> Column:
    """run/file: a file's place below the folder of runs."""
    return F.regexp_extract(path, r"/runs/((?:[^/]+/)+[^/]+)$", 1)


def shard(df: DataFrame, path: str, *, arrivals: int = 8, id_column: str = "doc_id", target: int = TARGET, fan_in: int = FAN_IN) -> Store:
    """Appends df as `arrivals` arrivals of unequal size, compacts and vacuums."""
    store = Store(df.sparkSession, path, id_column, target, fan_in)
    store.append(df, F.floor(F.sqrt(F.pmod(F.xxhash64(id_column), F.lit(arrivals * arrivals)))).cast("int"))
    store.compact()
    store.vacuum(grace=0)  # nobody else knows the store yet
    return store


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's shard in the committed version."""
    store = shard(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}")
    if not store.manifest().limit(1).count():
        return spark.createDataFrame([], "doc_id long, n_bytes long, shard string, shard_rows long, shard_bytes long, tier int, version int")
    shards = store.manifest().select("file", F.col("rows").alias("shard_rows"), F.col("bytes").alias("shard_bytes"), "tier")
    name = free_name("file", store.read())
    rows = store.read(file_column=name).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.col(name).alias("file"))
    return rows.join(shards, "file").select("doc_id", "n_bytes", F.col("file").alias("shard"), "shard_rows", "shard_bytes", "tier", F.lit(store.versions()[-1]).alias("version"))
