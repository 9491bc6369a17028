"""Topic logs: append-only Parquet folders partitioned by topic, with consecutive offsets."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamcontract.operators import events as E

LOG = "event_id string, event_type string, event_version int, event_time timestamp, event_source string, payload string, metadata map<string,string>, key string, offset bigint, topic string"
COMMITS = "group_id string, topic string, position bigint, committed_at timestamp, seq bigint"


class TopicStore:
    """<path>/log/topic=<t>/ holds events; <path>/commits positions of groups; <path>/checkpoints those of queries."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.log = spark, path, f"{path}/log"

    def _read(self, path: str, schema: str) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return self.spark.read.schema(schema).parquet(path) if fs.exists(p) else self.spark.createDataFrame([], schema)

    def read(self, *topics: str) -> DataFrame:
        """The rows of topics (all without names); the names prune partitions."""
        log = self._read(self.log, LOG)
        return log.where(F.col("topic").isin(*topics)) if topics else log

    def publish(self, events: DataFrame, *first_by: str) -> int:
        """Appends envelopes with topic (and key) and gives them offsets, by time or by the columns first_by before it; ids that a topic holds already are left out.

        One publisher at a time: offsets follow the greatest one of the topic.
        """
        if "key" not in events.columns:
            events = events.withColumn("key", F.lit(None).cast("string"))
        events = events.dropDuplicates(["topic", "event_id"])
        names = [r[0] for r in events.select("topic").distinct().collect()]  # topics of one batch
        if not names:
            return 0
        log = self.read(*names)
        fresh = events.join(log.select("topic", "event_id"), ["topic", "event_id"], "left_anti")
        ends = log.groupBy("topic").agg((F.max("offset") + 1).alias("__end"))
        rows = E.with_offsets(fresh, order=(*first_by, "event_time", "event_id")).join(ends, "topic", "left").withColumn("offset", F.col("offset") + F.coalesce("__end", F.lit(0)))
        columns = [c.strip().split(" ")[0] for c in LOG.replace("map<string,string>", "map").split(",")]
        rows = rows.select(*columns).persist()
        try:
            n = rows.count()
            if n:
                rows.write.mode("append").partitionBy("topic").parquet(self.log)
            return n
        finally:
            rows.unpersist()

    def publish_one(self, topic: str, event_type: str, payload: str, **more: object) -> str:
        """Publishes an event; its id."""
        e = E.publish_one(self.spark, event_type, payload, **more).withColumn("topic", F.lit(topic)).withColumn("key", F.lit(more.get("key")).cast("string"))
        event_id = e.first()["event_id"]
        self.publish(e if more.get("event_id") else self.spark.createDataFrame([{**e.first().asDict(), "event_id": event_id}], e.schema))
        return event_id

    def info(self, topic: str | None = None) -> DataFrame:
        return E.stream_info(self.read(topic) if topic else self.read(), self.offsets())

    # ------------------------------------------------------------ positions

    def commits(self) -> DataFrame:
        return self._read(f"{self.path}/commits", COMMITS)

    def offsets(self) -> DataFrame:
        return E.latest_offsets(self.commits())

    def commit(self, group: str, topic: str, position: int, at: dt.datetime | None = None) -> None:
        """Notes the next offset that a group reads."""
        at = at or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        seq = (self.commits().agg(F.max("seq")).first()[0] or 0) + 1
        self.spark.createDataFrame([(group, topic, position, at, seq)], COMMITS).write.mode("append").parquet(f"{self.path}/commits")

    def create_group(self, group: str, topics: tuple[str, ...], start: str | dt.datetime = "$") -> None:
        """Notes where a group begins in topics; those that it reads already are left as they are."""
        known = {r["topic"] for r in self.offsets().where(F.col("group_id") == group).collect()}  # one group's topics
        for topic in topics:
            if topic not in known:
                self.reset(group, topic, start)

    def position(self, group: str, topic: str) -> int | str:
        """The group's next offset, or '$' without one."""
        r = self.offsets().where((F.col("group_id") == group) & (F.col("topic") == topic)).first()
        return r["position"] if r else "$"

    def reset(self, group: str, topic: str, start: str | dt.datetime) -> int:
        r = E.start_position(self.read(topic), start).first()
        position = (r["position"] if r else None) or 0
        self.commit(group, topic, position)
        return position

    def replay(self, config: E.ReplayConfig) -> DataFrame:
        return E.replay(self.read(*config.topics), config)

    def replay_into(self, config: E.ReplayConfig, target: str) -> int:
        """Appends the replayed events, with new offsets, to a topic of the config's group."""
        return self.publish(self.replay(config).drop("offset").withColumn("topic", F.lit(target)))
