"""Versioned tables without MERGE: each change writes a new folder, then a pointer says which counts.

One writer at a time changes a table (a second one that started from the same
version fails); readers keep the version that they began with.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class ConflictError(RuntimeError):
    """Another writer has changed the table."""


class Versions:
    """Numbered pointers <path>/versions/<n>, each one line.

    A pointer is written whole under another name and then renamed without overwriting:
    readers see it complete or not at all, a writer that dies in between leaves nothing
    that counts, and of two writers of one number the second gets a ConflictError
    (as surely as the file system's rename is atomic).
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        sc = spark.sparkContext
        self._hadoop, self._gateway = sc._jvm.org.apache.hadoop.fs, sc._gateway
        self._conf = sc._jsc.hadoopConfiguration()
        self.at = lambda *x: self._hadoop.Path("/".join([path, *x]))
        self.path, self.fs = path, self.at().getFileSystem(self._conf)

    def all(self) -> list[int]:
        at = self.at("versions")
        return sorted(int(x.getPath().getName()) for x in self.fs.listStatus(at) if x.getPath().getName().isdigit()) if self.fs.exists(at) else []

    def latest(self) -> int:
        return max(self.all(), default=0)

    def get(self, version: int) -> str:
        stream = self.fs.open(self.at("versions", str(version)))
        try:
            return stream.readLine() or ""
        finally:
            stream.close()

    def write(self, line: str) -> object:
        """The line as a file that is no version yet."""
        at = self.at("versions", f".{uuid.uuid4().hex}")
        stream = self.fs.create(at, False)
        try:
            stream.writeBytes(line)
        finally:
            stream.close()
        return at

    def publish(self, version: int, line: str) -> int:
        written = self.write(line)
        never = getattr(self._hadoop, "Options$Rename")
        how = self._gateway.new_array(never, 1)
        how[0] = never.NONE
        try:
            self._hadoop.FileContext.getFileContext(written.toUri(), self._conf).rename(written, self.at("versions", str(version)), how)
        except Py4JJavaError as e:
            self.fs.delete(written, False)
            if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                raise ConflictError(f"version {version} of {self.path} is there") from e
            raise
        return version


class Table:
    """Rows in <path>/data/<name>; <path>/versions/<n> holds that name."""

    def __init__(self, spark: SparkSession, path: str, schema: str, partition: tuple[str, ...] = ()) -> None:
        self.spark, self.path, self.schema, self.partition = spark, path, schema, partition
        self.versions = Versions(spark, path)

    def version(self) -> int:
        return self.versions.latest()

    def create(self) -> Table:
        """Makes an empty table where there is none."""
        if not self.version():
            self._commit(self.spark.createDataFrame([], self.schema), 0)
        return self

    def read(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        out = self.spark.createDataFrame([], self.schema)
        for n in self._names(version):
            at = f"{self.path}/data/{n}"
            out = out.unionByName(self.spark.read.schema(self.schema).option("basePath", at).parquet(at).select(*out.columns))
        return out

    def _names(self, version: int) -> list[str]:
        return self.versions.get(version).split(",") if version else []

    def _write(self, df: DataFrame) -> str:
        name = uuid.uuid4().hex
        df = df.select(*(df[c] for c in self.spark.createDataFrame([], self.schema).columns))
        df.write.partitionBy(*self.partition).parquet(f"{self.path}/data/{name}")
        return name

    def _commit(self, df: DataFrame, base: int, also: list[str] | None = None) -> int:
        name = self._write(df)
        return self.versions.publish(base + 1, ",".join([*(also or []), name]))

    def append(self, df: DataFrame, compact_after: int = 32) -> int:
        """Adds rows: writes only them, and every `compact_after` appends the whole table as one folder."""
        base = self.version()
        names = self._names(base)
        if len(names) >= compact_after:
            return self._commit(self.read(base).unionByName(df.select(*self.read(base).columns)), base)
        return self._commit(df, base, names)

    def update(self, change: Callable[[DataFrame], DataFrame]) -> int:
        """Replaces the rows by change(rows)."""
        base = self.version()
        return self._commit(change(self.read(base)), base)
