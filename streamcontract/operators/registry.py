"""Schema registry over four tables. Set operations are DataFrames; compatibility is decided on the driver, pair by pair."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from streamcontract.operators import avro
from streamcontract.sources.tables import Table

SCHEMAS = "id bigint, schema string, schema_type string, hash string, created_at timestamp"
SUBJECT_VERSIONS = "subject string, version bigint, schema_id bigint, deleted boolean, created_at timestamp"
CONFIGS = "subject string, compatibility string, updated_at timestamp"
MODES = "subject string, mode string, updated_at timestamp"
TYPES = ("AVRO", "JSON", "PROTOBUF")
DEFAULT_LEVEL, DEFAULT_MODE = "FULL", "READWRITE"
ALL_MODES = ("READWRITE", "READONLY", "READONLY_OVERRIDE", "IMPORT")


class NotFoundError(LookupError):
    code = 404


class InvalidError(ValueError):
    code = 422


# ---------------------------------------------------------------- set operations


def live(versions: DataFrame) -> DataFrame:
    return versions.where(~F.col("deleted"))


def subjects(versions: DataFrame) -> DataFrame:
    return live(versions).select("subject").distinct()


def subject_versions(versions: DataFrame, subject: str) -> DataFrame:
    return live(versions).where(F.col("subject") == subject).select("version").orderBy("version")


def latest(versions: DataFrame) -> DataFrame:
    """The latest live version of each subject: one aggregation, no window."""
    return live(versions).groupBy("subject").agg(F.max("version").alias("version"), F.max_by("schema_id", "version").alias("schema_id"))


def with_schemas(versions: DataFrame, schemas: DataFrame) -> DataFrame:
    """Versions with their schema's text and type, in one join."""
    return versions.join(schemas.select(F.col("id").alias("schema_id"), "schema", "schema_type"), "schema_id")


def schema_versions(versions: DataFrame, schema_id: int) -> DataFrame:
    return live(versions).where(F.col("schema_id") == schema_id).select("subject", "version").orderBy("subject", "version")


def referenced_by(versions: DataFrame, schemas: DataFrame, subject: str, version: int) -> DataFrame:
    """Live versions that share the schema of a subject's version."""
    of = live(versions).where((F.col("subject") == subject) & (F.col("version") == version)).select("schema_id")
    return with_schemas(live(versions).join(of, "schema_id", "left_semi"), schemas).select("subject", "version", "schema_id").orderBy("subject", "version")


def next_versions(versions: DataFrame) -> DataFrame:
    """The next version of each subject, counting deleted ones."""
    return versions.groupBy("subject").agg((F.max("version") + 1).alias("next_version"))


def soft_delete(versions: DataFrame, subject: str, version: int | None = None) -> DataFrame:
    hit = (F.col("subject") == subject) & (F.lit(True) if version is None else F.col("version") == version)
    return versions.withColumn("deleted", F.col("deleted") | hit)


def effective_config(subjects: DataFrame, configs: DataFrame, default: str = DEFAULT_LEVEL) -> DataFrame:
    """Level of each subject: its own, else the global one, else the default."""
    newest = configs.groupBy("subject").agg(F.max_by("compatibility", "updated_at").alias("own"))
    overall = newest.where("subject IS NULL").select(F.col("own").alias("overall"))  # one row at most
    out = subjects.join(newest.where("subject IS NOT NULL"), "subject", "left")
    return out.join(F.broadcast(overall), F.lit(True), "left").select("subject", F.coalesce("own", "overall", F.lit(default)).alias("compatibility"))


def register_bulk(requests: DataFrame, schemas: DataFrame, versions: DataFrame, now: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """New rows of schemas and versions for requests (subject, schema, schema_type, seq).

    A known hash keeps its id; new ones follow the greatest id in the order of first request;
    each request is a new version of its subject.
    """
    r = requests.withColumn("hash", request_hash(F.col("schema"), F.col("schema_type")))
    fresh = r.join(schemas.select("hash"), "hash", "left_anti").groupBy("hash").agg(F.min("seq").alias("seq"), F.min_by("schema", "seq").alias("schema"), F.min_by("schema_type", "seq").alias("schema_type"))
    top = schemas.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    # one row for each different new schema
    new = fresh.join(F.broadcast(top), F.lit(True)).select((F.col("top") + F.row_number().over(Window.orderBy("seq", "hash"))).alias("id"), "schema", "schema_type", "hash", F.lit(now).alias("created_at"))
    ids = schemas.select("id", "hash").unionByName(new.select("id", "hash"))
    base = next_versions(versions)
    order = F.row_number().over(Window.partitionBy("subject").orderBy("seq"))
    rows = r.join(ids, "hash").join(base, "subject", "left").select("subject", (F.coalesce("next_version", F.lit(1)) + order - 1).cast("bigint").alias("version"), F.col("id").alias("schema_id"), F.lit(False).alias("deleted"), F.lit(now).alias("created_at"))
    return new, rows


def request_hash(schema: object, schema_type: object) -> object:
    """SHA-256, in hex, of the canonical JSON of a request."""
    return F.sha2(F.to_json(F.struct(schema.alias("schema"), F.coalesce(schema_type, F.lit("AVRO")).alias("schemaType"))), 256)


def compatibility_matrix(pairs: DataFrame, level: str) -> DataFrame:
    """Adds compatible and problems to rows (old, new) of Avro texts, in Arrow batches."""
    from streamcontract.runtime import prepare

    prepare(pairs.sparkSession)

    @F.pandas_udf("struct<compatible:boolean,problems:array<string>>")
    def run(old: pd.Series, new: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b in zip(old, new, strict=True):
            try:
                found = [str(p) for p in avro.check_level(level, [avro.parse(a)], avro.parse(b))]
            except avro.AvroError as e:
                found = [f"invalid schema: {e}"]
            rows.append((not found, found))
        return pd.DataFrame(rows, columns=["compatible", "problems"])

    return pairs.withColumn("check", run("old", "new")).select(*pairs.columns, "check.compatible", "check.problems")


# ---------------------------------------------------------------- the service


@dataclass(frozen=True)
class Registered:
    subject: str
    version: int
    id: int
    schema: str
    schema_type: str


class Registry:
    """The registry's calls over stored tables. `enforce` refuses incompatible versions at registration."""

    def __init__(self, spark: SparkSession, path: str, enforce: bool = False, clock: Callable[[], dt.datetime] | None = None, default_level: str = DEFAULT_LEVEL) -> None:
        self.spark, self.enforce, self.default_level = spark, enforce, default_level
        self.clock = clock or (lambda: dt.datetime.now(dt.timezone.utc).replace(tzinfo=None))
        self.schemas, self.versions, self.configs, self.modes = (Table(spark, f"{path}/{name}", schema).create() for name, schema in (("schemas", SCHEMAS), ("subject_versions", SUBJECT_VERSIONS), ("configs", CONFIGS), ("modes", MODES)))

    def schema_types(self) -> list[str]:
        return list(TYPES)

    def schema_by_id(self, schema_id: int) -> Registered:
        return self._one(self.schemas.read().where(F.col("id") == schema_id).select(F.lit("").alias("subject"), F.lit(0).alias("version"), F.col("id").alias("schema_id"), "schema", "schema_type"), f"schema {schema_id}")

    def _one(self, df: DataFrame, what: str) -> Registered:
        r = df.first()
        if r is None:
            raise NotFoundError(what)
        return Registered(r["subject"], r["version"], r["schema_id"], r["schema"], r["schema_type"])

    def subjects(self) -> list[str]:
        return sorted(r[0] for r in subjects(self.versions.read()).collect())

    def subject_versions(self, subject: str) -> list[int]:
        return [r[0] for r in subject_versions(self.versions.read(), subject).collect()]

    def schema_versions(self, schema_id: int) -> list[tuple[str, int]]:
        return [tuple(r) for r in schema_versions(self.versions.read(), schema_id).collect()]

    def version(self, subject: str, version: int | str) -> Registered:
        if version == "latest":
            return self.latest(subject)
        rows = live(self.versions.read()).where((F.col("subject") == subject) & (F.col("version") == int(version)))
        return self._one(with_schemas(rows, self.schemas.read()), f"{subject} {version}")

    def latest(self, subject: str) -> Registered:
        rows = latest(self.versions.read().where(F.col("subject") == subject))
        return self._one(with_schemas(rows, self.schemas.read()), subject)

    def schema_text(self, subject: str, version: int | str) -> str:
        return self.version(subject, version).schema

    def register(self, subject: str, schema: str, schema_type: str = "AVRO") -> int:
        """The schema's id."""
        if schema_type not in TYPES:
            raise InvalidError(schema_type)
        if self.mode(subject).startswith("READONLY"):
            raise InvalidError(f"{subject} is read-only")
        if self.enforce and (found := self.check_latest(subject, schema, schema_type)):
            raise InvalidError("; ".join(map(str, found)))
        request = self.spark.createDataFrame([(subject, schema, schema_type, 0)], "subject string, schema string, schema_type string, seq long")
        new, rows = register_bulk(request, self.schemas.read(), self.versions.read(), self.clock())
        got = rows.first()
        if new.limit(1).count():
            self.schemas.append(new)
        self.versions.append(self.spark.createDataFrame([got], rows.schema))
        return got["schema_id"]

    def delete_subject(self, subject: str) -> list[int]:
        gone = self.subject_versions(subject)
        if not gone:
            raise NotFoundError(subject)
        self.versions.update(lambda v: soft_delete(v, subject))
        return gone

    def delete_version(self, subject: str, version: int) -> int:
        self.version(subject, version)
        self.versions.update(lambda v: soft_delete(v, subject, version))
        return version

    def referenced_by(self, subject: str, version: int) -> list[tuple[str, int]]:
        return [(r["subject"], r["version"]) for r in referenced_by(self.versions.read(), self.schemas.read(), subject, version).collect()]

    def _upsert(self, table: Table, column: str, subject: str | None, value: str | None) -> None:
        now = self.clock()

        def change(df: DataFrame) -> DataFrame:
            rest = df.where(~F.col("subject").eqNullSafe(F.lit(subject)))
            if value is None:
                return rest
            return rest.unionByName(self.spark.createDataFrame([(subject, value, now)], df.schema))

        table.update(change)

    def _setting(self, table: Table, column: str, subject: str | None) -> str | None:
        r = table.read().where(F.col("subject").eqNullSafe(F.lit(subject))).select(column).first()
        return r[0] if r else None

    def config(self, subject: str | None = None) -> str:
        return (self._setting(self.configs, "compatibility", subject) if subject is not None else None) or self._setting(self.configs, "compatibility", None) or self.default_level

    def set_config(self, level: str, subject: str | None = None) -> None:
        if level not in avro.LEVELS:
            raise InvalidError(level)
        self._upsert(self.configs, "compatibility", subject, level)

    def delete_config(self, subject: str) -> None:
        self._upsert(self.configs, "compatibility", subject, None)

    def mode(self, subject: str | None = None) -> str:
        return (self._setting(self.modes, "mode", subject) if subject is not None else None) or self._setting(self.modes, "mode", None) or DEFAULT_MODE

    def set_mode(self, mode: str, subject: str | None = None) -> None:
        if mode not in ALL_MODES:
            raise InvalidError(mode)
        self._upsert(self.modes, "mode", subject, mode)

    def delete_mode(self, subject: str) -> None:
        self._upsert(self.modes, "mode", subject, None)

    def check(self, subject: str, version: int | str, schema: str, schema_type: str = "AVRO") -> list[avro.Problem]:
        """Why the schema is not compatible with a version under the subject's level; transitive levels check all up to it."""
        old = self.version(subject, version)
        level = self.config(subject)
        if old.schema_type != schema_type:
            return [avro.Problem("TypeMismatch", "", f"{old.schema_type} and {schema_type}")]
        if schema_type != "AVRO" or level == "NONE":
            return []
        texts = [old.schema]
        if level.endswith("_TRANSITIVE"):
            rows = with_schemas(live(self.versions.read()).where((F.col("subject") == subject) & (F.col("version") <= old.version)), self.schemas.read())
            texts = [r["schema"] for r in rows.orderBy("version").collect()]  # one subject's versions
        return avro.check_level(level, [avro.parse(t) for t in texts], avro.parse(schema))

    def check_latest(self, subject: str, schema: str, schema_type: str = "AVRO") -> list[avro.Problem]:
        try:
            return self.check(subject, "latest", schema, schema_type)
        except NotFoundError:
            return []


def error_response(e: Exception) -> dict[str, object]:
    """Code and message as the registry's callers see them."""
    return {"error_code": getattr(e, "code", 500), "message": str(e)}


def request_json(schema: str, schema_type: str = "AVRO", references: tuple = ()) -> str:
    return json.dumps({"schema": schema, "schemaType": schema_type, "references": list(references)}, sort_keys=True)
