"""Transactional outbox: rows wait until they are published, are retried, and end as processed or failed."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamcontract.sources.tables import Table
from streamcontract.sources.topics import TopicStore

OUTBOX = "event_id string, topic string, key string, payload binary, metadata string, created_at timestamp, processed_at timestamp, retries int, error string"
MAX_RETRIES = 3


@dataclass(frozen=True)
class OutboxConfig:
    batch_size: int = 100
    poll_ms: int = 1000
    max_retries: int = MAX_RETRIES
    retry_delay_s: float = 0.0


def new_rows(events: DataFrame, created_at: object = None) -> DataFrame:
    """Outbox rows of envelopes with topic and key: the payload is the whole envelope as JSON."""
    whole = F.to_json(F.struct(*(c for c in ("event_id", "event_type", "event_version", "event_time", "event_source", "payload", "metadata"))))
    return events.select("event_id", "topic", "key", F.encode(whole, "UTF-8").alias("payload"), F.to_json("metadata").alias("metadata"), (F.current_timestamp() if created_at is None else F.lit(created_at)).alias("created_at"), F.lit(None).cast("timestamp").alias("processed_at"), F.lit(0).alias("retries"), F.lit(None).cast("string").alias("error"))


def pending(outbox: DataFrame, limit: int | None = None, max_retries: int = MAX_RETRIES) -> DataFrame:
    """Rows still to publish, oldest first; with a limit this is a top-k, not a sort."""
    rows = outbox.where(F.col("processed_at").isNull() & ((F.col("retries") < max_retries) | F.col("error").isNull()))
    return rows if limit is None else rows.orderBy("created_at", "event_id").limit(limit)


def settle(outbox: DataFrame, done: DataFrame, failed: DataFrame, now: object) -> DataFrame:
    """The outbox after a batch: `done` (event_id) is processed, `failed` (event_id, error) has one more retry and its error."""
    d = done.select("event_id", F.lit(True).alias("__done"))
    f = failed.select("event_id", F.col("error").alias("__error"))
    joined = outbox.join(d, "event_id", "left").join(f, "event_id", "left")
    bad = F.col("__error").isNotNull()
    return joined.withColumns({"processed_at": F.when(F.col("__done"), F.coalesce("processed_at", F.lit(now))).otherwise(F.col("processed_at")), "retries": F.col("retries") + bad.cast("int"), "error": F.coalesce("__error", "error")}).select(*outbox.columns)


def decode(rows: DataFrame, *carry: str) -> DataFrame:
    """Envelopes of outbox rows, with the row's columns carry; decode_error where the payload is no envelope."""
    text = F.decode("payload", "UTF-8")
    e = F.from_json(text, "event_id string, event_type string, event_version int, event_time timestamp, event_source string, payload string, metadata map<string,string>")
    out = rows.select("topic", "key", F.col("event_id").alias("__row"), e.alias("e"), *carry)
    return out.select(F.col("__row").alias("row_id"), "topic", "key", "e.*", *carry, F.when(F.col("e.event_id").isNull(), "DeserializationError").alias("decode_error"))


class Outbox:
    """A stored outbox that publishes to a topic store. One processor at a time."""

    def __init__(self, spark: SparkSession, path: str, topics: TopicStore, config: OutboxConfig | None = None, clock: Callable[[], dt.datetime] | None = None) -> None:
        self.table = Table(spark, path, OUTBOX).create()
        self.spark, self.topics, self.config = spark, topics, config or OutboxConfig()
        self.clock = clock or (lambda: dt.datetime.now(dt.timezone.utc).replace(tzinfo=None))
        self.active = True

    def write(self, events: DataFrame) -> None:
        """Envelopes with topic and key become waiting rows."""
        self.table.append(new_rows(events, self.clock()))

    def mark_processed(self, event_id: str) -> None:
        one = self.spark.createDataFrame([(event_id,)], "event_id string")
        self.table.update(lambda t: settle(t, one, self.spark.createDataFrame([], "event_id string, error string"), self.clock()))

    def update_event(self, event_id: str, retries: int, error: str | None) -> None:
        hit = F.col("event_id") == event_id
        self.table.update(lambda t: t.withColumns({"retries": F.when(hit, F.lit(retries)).otherwise(F.col("retries")), "error": F.when(hit, F.lit(error)).otherwise(F.col("error"))}))

    def process(self, accept: Callable[[DataFrame], DataFrame] | None = None, whole: bool = False) -> tuple[int, int]:
        """Publishes one batch, or with `whole` all that is pending; (published, failed). `accept` may set decode_error on rows that must not go out.

        Rows that the topics hold already (a processor that stopped between publishing
        and marking) are only marked. Without pending rows the table stays as it is.
        """
        c = self.config
        batch = pending(self.table.read(), None if whole else c.batch_size, c.max_retries)
        # one version of the table, so a whole backlog can be read again rather than kept
        batch = batch if whole and not accept else batch.persist()
        try:
            decoded = decode(batch, "created_at")
            decoded = accept(decoded) if accept else decoded
            ok = F.col("decode_error").isNull()
            n = decoded.agg(F.count_if(ok).alias("done"), F.count_if(~ok).alias("failed")).first()
            if n["done"] or n["failed"]:
                good = decoded.where(ok)
                self.topics.publish(good.drop("row_id", "decode_error"), *(["created_at"] if whole else []))
                done, failed = good.select(F.col("row_id").alias("event_id")), decoded.where(~ok).select(F.col("row_id").alias("event_id"), F.col("decode_error").alias("error"))
                self.table.update(lambda t: settle(t, done, failed, self.clock()))
            return n["done"], n["failed"]
        finally:
            batch.unpersist()

    def run(self, stop_when_idle: bool = True, sleep: Callable[[float], None] | None = None) -> int:
        """Turns until stopped, or until nothing is pending.

        A turn rewrites the table, so a backlog of more than one batch goes out in one
        turn, oldest first, and not in as many turns as it has batches.
        """
        import time

        total = 0
        while self.active:
            c = self.config
            backlog = pending(self.table.read(), None, c.max_retries).count()
            done, failed = self.process(whole=backlog > c.batch_size) if backlog else (0, 0)
            total += done
            if not done and not failed:
                if stop_when_idle:
                    break
                (sleep or time.sleep)(c.poll_ms / 1000)
            elif failed and c.retry_delay_s:
                (sleep or time.sleep)(c.retry_delay_s)
        return total

    def stop(self) -> None:
        self.active = False
