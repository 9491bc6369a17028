"""Consumer groups as Structured Streaming queries: one checkpoint a group.

Delivery is at least once: a batch is committed when its handler returns. Rows that a
handler refuses go to dead_letter, rows that can't be decoded to poison; both are
written with the batch's number, so that a batch that runs twice does not add them twice.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from streamcontract.operators import events as E
from streamcontract.sources.topics import LOG, TopicStore

Handler = Callable[[DataFrame, int], DataFrame | None]


def read_stream(store: TopicStore, config: E.StreamConfig, files_per_batch: int | None = None) -> DataFrame:
    """The stream of the config's topics from its start: a group's first run skips what lies before; later runs follow the checkpoint."""
    reader = store.spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_per_batch or config.batch_size)
    rows = reader.parquet(store.log).where(F.col("topic").isin(*config.topics))
    if config.start == "0":
        return rows
    first = {r["topic"]: r["position"] for r in E.start_position(store.read(*config.topics), config.start).collect()}  # one row a topic
    skip = F.lit(False)
    for topic, position in first.items():
        skip = skip | ((F.col("topic") == topic) & (F.col("offset") < position))
    return rows.where(~skip)


class Consumer:
    """Runs a handler over a group's events.

    The handler gets a batch (a DataFrame) and its number. It may return the rows that
    it could not handle, with an `error` column.
    """

    def __init__(self, store: TopicStore, config: E.StreamConfig, handler: Handler, payload_schema: str | None = None, transform: Callable[[DataFrame], DataFrame] | None = None) -> None:
        self.store, self.config, self.handler, self.payload_schema, self.transform = store, config, handler, payload_schema, transform
        self.query: StreamingQuery | None = None
        self.active = True

    def _base(self, what: str) -> str:
        return f"{self.store.path}/{what}/{self.config.group}"

    def _batch(self, df: DataFrame, number: int) -> None:
        df = df.persist()
        try:
            rows = df
            if self.payload_schema is not None:
                decoded = E.typed(df, self.payload_schema)
                self._aside(decoded.where("decode_error IS NOT NULL").select(*df.columns, F.col("decode_error").alias("error")), "poison", number)
                rows = decoded.where("decode_error IS NULL").drop("decode_error")
            refused = self.handler(rows, number)
            if refused is not None:
                self._aside(refused.select(*df.columns, "error"), "dead_letter", number)
            for r in df.groupBy("topic").agg((F.max("offset") + 1).alias("next")).collect():  # one row a topic
                self.store.commit(self.config.group, r["topic"], r["next"])
        finally:
            df.unpersist()

    def _aside(self, rows: DataFrame, what: str, number: int) -> None:
        if rows.limit(1).count():
            rows.write.mode("overwrite").parquet(f"{self._base(what)}/batch={number}")

    def start(self, available_now: bool = True) -> StreamingQuery:
        """Starts the query: over what is there now, or every poll interval."""
        stream = read_stream(self.store, self.config)
        if self.transform is not None:
            stream = self.transform(stream)
        w = stream.writeStream.foreachBatch(self._batch).option("checkpointLocation", self._base("checkpoints"))
        w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=f"{self.config.poll_ms} milliseconds")
        self.query = w.start()
        return self.query

    def run_once(self) -> None:
        self.start().awaitTermination()

    def run_forever(self, wait_s: float = 5.0, sleep: Callable[[float], None] = time.sleep, log: Callable[[str], None] = print) -> None:
        """Restarts after failures until `stop`."""
        while self.active:
            try:
                self.start(available_now=False).awaitTermination()
            except StreamingQueryException as e:
                log(f"consumer {self.config.group}: {e}")
                if self.active:
                    sleep(wait_s)

    def stop(self) -> None:
        self.active = False
        if self.query is not None:
            self.query.stop()


def deduplicated(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Events once by id, with state bounded by the delay."""
    return stream.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["event_id"])


def balance_stream(stream: DataFrame, account: object, amount: object) -> DataFrame:
    """Running balances: a stateful aggregation for update or complete mode."""
    return E.balances(stream, account, amount)
