"""Event envelopes, their wire form, offsets, replay and projections."""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ENVELOPE = "event_id string, event_type string, event_version int, event_time timestamp, event_source string, payload string, metadata map<string,string>"
WIRE = ("event_id", "event_type", "event_version", "event_time", "event_source", "payload", "metadata")
SOURCE = "streamcontract"
_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
UUID = r"\A[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\z"


@dataclass(frozen=True)
class StreamConfig:
    group: str
    topics: tuple[str, ...]
    batch_size: int = 100
    poll_ms: int = 5000
    start: str | dt.datetime = "$"  # "0" the beginning, "$" the end, an offset, or a time


@dataclass(frozen=True)
class ReplayConfig:
    topics: tuple[str, ...]
    start: dt.datetime
    end: dt.datetime | None = None
    filters: tuple[tuple[str, str], ...] = ()
    parallelism: int = 1
    group: str = "replay"


@dataclass(frozen=True)
class PublishConfig:
    topic: str
    key: str | None = None
    headers: dict[str, str] = field(default_factory=dict)


def envelope(df: DataFrame, event_type: Column, payload: Column, *, event_id: Column | None = None, event_time: Column | None = None, version: int = 1, source: str = SOURCE, metadata: Column | None = None) -> DataFrame:
    """Envelopes of df's rows: random ids and the present time where none are given."""
    return df.select(
        (F.expr("uuid()") if event_id is None else event_id.cast("string")).alias("event_id"), event_type.alias("event_type"), F.lit(version).cast("int").alias("event_version"),
        (F.current_timestamp() if event_time is None else event_time).alias("event_time"), F.lit(source).alias("event_source"), payload.alias("payload"),
        (F.create_map().cast("map<string,string>") if metadata is None else metadata).alias("metadata"),
    )


def to_wire(events: DataFrame) -> DataFrame:
    """Seven text fields; other columns are kept."""
    return events.withColumns({"event_version": F.col("event_version").cast("string"), "event_time": F.date_format("event_time", _TIME), "metadata": F.to_json("metadata")})


def from_wire(fields: DataFrame) -> DataFrame:
    """Envelopes and an `error` column: id, version and time must be there and valid; bad metadata is empty, other missing fields are ''."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    version, time = F.col("event_version").try_cast("int"), F.to_timestamp(F.col("event_time")) if dict(fields.dtypes)["event_time"] == "timestamp" else F.col("event_time").try_cast("timestamp")
    error = F.when(F.col("event_id").isNull(), "missing event_id").when(~F.col("event_id").rlike(UUID), "invalid event_id").when(F.col("event_version").isNull(), "missing event_version").when(version.isNull(), "invalid event_version").when(F.col("event_time").isNull(), "missing event_time").when(time.isNull(), "invalid event_time")
    meta = F.coalesce(F.from_json("metadata", "map<string,string>"), F.create_map().cast("map<string,string>"))
    return fields.withColumns({"error": error, "event_type": text("event_type"), "event_source": text("event_source"), "payload": text("payload"), "event_version": version, "event_time": time, "metadata": meta})


def typed(events: DataFrame, schema: str) -> DataFrame:
    """Adds data, the payload by a schema, and decode_error where it does not fit."""
    data = F.from_json("payload", schema + ", __bad string", {"columnNameOfCorruptRecord": "__bad"})
    return events.withColumn("__data", data).withColumns({"data": F.col("__data").dropFields("__bad"), "decode_error": F.when(F.col("payload").isNull() | F.col("__data").isNull() | F.col("__data.__bad").isNotNull(), "DeserializationError")}).drop("__data")


def of_type(events: DataFrame, versions: DataFrame, topic: str = "topic") -> DataFrame:
    """Events with the registered schema of their topic and version."""
    return events.join(versions.select(F.col("subject").alias(topic), F.col("version").cast("int").alias("event_version"), "schema_id"), [topic, "event_version"], "left")


# ---------------------------------------------------------------- replay


def in_range(events: DataFrame, start: object, end: object = None, time: str = "event_time") -> DataFrame:
    out = events.where(F.col(time) >= F.lit(start))
    return out if end is None else out.where(F.col(time) < F.lit(end))


def having(events: DataFrame, filters: tuple[tuple[str, str], ...] | list) -> DataFrame:
    """Rows whose fields equal values: a column's, or else an entry of metadata."""
    for name, value in filters:
        c = F.col(name).cast("string") if name in events.columns else F.col("metadata")[name]
        events = events.where(c == value)
    return events


def replay(events: DataFrame, config: ReplayConfig) -> DataFrame:
    """A topic table's rows of the config's topics, time range and filters; predicates reach the scan."""
    out = having(in_range(events.where(F.col("topic").isin(*config.topics)), config.start, config.end), config.filters)
    return out.repartition(config.parallelism, "event_id") if config.parallelism > 1 else out


# ---------------------------------------------------------------- topics and offsets


def with_offsets(events: DataFrame, first: int = 0, order: tuple[str, ...] = ("event_time", "event_id"), topic: str = "topic") -> DataFrame:
    """offset: consecutive by topic in the given order."""
    return events.withColumn("offset", F.row_number().over(Window.partitionBy(topic).orderBy(*order)).cast("long") - 1 + first)


def stream_info(events: DataFrame, groups: DataFrame | None = None, topic: str = "topic") -> DataFrame:
    """Per topic: length, first and last offset with their times, and the groups that have a position."""
    info = events.groupBy(topic).agg(F.count("*").alias("length"), F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"), F.min_by("event_time", "offset").alias("first_time"), F.max_by("event_time", "offset").alias("last_time"))
    if groups is None:
        return info
    return info.join(groups.groupBy(topic).agg(F.sort_array(F.collect_set("group_id")).alias("groups")), topic, "left").withColumn("groups", F.coalesce("groups", F.array().cast("array<string>")))


def latest_offsets(commits: DataFrame) -> DataFrame:
    """The last commit of each group and topic, of an append-only table of commits."""
    return commits.groupBy("group_id", "topic").agg(F.max_by("position", F.struct("committed_at", "seq")).alias("position"))


def start_position(events: DataFrame, start: str | dt.datetime, topic: str = "topic") -> DataFrame:
    """First offset to read of each topic: '0' the beginning, '$' the end, a time, or an offset."""
    by = events.groupBy(topic)
    if start == "0":
        return by.agg(F.min("offset").alias("position"))
    if start == "$":
        return by.agg((F.max("offset") + 1).alias("position"))
    if isinstance(start, dt.datetime):
        return by.agg(F.coalesce(F.min(F.when(F.col("event_time") >= F.lit(start), F.col("offset"))), F.max("offset") + 1).alias("position"))
    return by.agg(F.lit(int(str(start).partition("-")[0])).cast("long").alias("position"))


# ---------------------------------------------------------------- projections


def deduplicated(events: DataFrame) -> DataFrame:
    """The first row of each event id."""
    return events.dropDuplicates(["event_id"]) if "offset" not in events.columns else events.join(events.groupBy("event_id").agg(F.min("offset").alias("offset")), ["event_id", "offset"], "left_semi")


def balances(events: DataFrame, account: Column, amount: Column) -> DataFrame:
    """Sum of signed amounts by account, as decimals, so that the order of addition does not matter."""
    return events.groupBy(account.alias("account")).agg(F.sum(amount.cast("decimal(28,6)")).cast("decimal(38,6)").alias("balance"), F.count("*").alias("n"))


def publish_one(spark: SparkSession, event_type: str, payload: str, **more: object) -> DataFrame:
    """A single envelope."""
    row = (str(more.get("event_id") or uuid.uuid4()), event_type, more.get("version", 1), more.get("event_time") or dt.datetime.now(dt.timezone.utc), more.get("source", SOURCE), payload, more.get("metadata") or {})
    return spark.createDataFrame([row], ENVELOPE)
