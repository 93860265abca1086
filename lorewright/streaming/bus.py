"""The event bus: an append-only log, routed to consumers as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import recent_events
from ..schema import EVENT, EVENTS


#: How long an event's id is remembered by a subscription.
REPEAT = "1 hour"


class Bus:
    """Events as Parquet parts in a folder; ids grow with time and never start anew."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.consumers: dict[str, StreamingQuery] = {}

    def publish(self, events: DataFrame) -> None:
        """Append (event, source, payload); ids are content hashes, so feeding a batch again adds no new events on read."""
        stamp = events.withColumn("timestamp", F.current_timestamp()) if "timestamp" not in events.columns else events
        own = F.sha2(F.concat_ws("|", "event", "source", "payload", F.col("timestamp").cast("string")), 256)
        rows = stamp.select(own.alias("event_id"), "event", F.lit("1.0").alias("version"), "timestamp", "source", "payload")
        rows.write.mode("append").parquet(self.folder)

    def log(self) -> DataFrame:
        self._ensure()
        return self.spark.read.schema(EVENT).parquet(self.folder).dropDuplicates(["event_id"])

    def recent(self, limit: int = 50, event: str = "") -> DataFrame:
        return recent_events(self.log(), limit, event)

    def subscribe(self, name: str, event: str, handler: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = "1 second") -> StreamingQuery:
        """A stream of one event type to a handler; handlers fail by themselves, not each other.

        The subscription stays and gets what is published later, looked for
        ``every`` so often; with None it ends after what is there.  An event
        fed twice within ``REPEAT`` reaches the handler once; older ids are
        forgotten, so the state doesn't grow with the log.
        """
        if event not in EVENTS and not event.count("."):
            raise ValueError(f"unknown event: {event}")
        if name in self.consumers and self.consumers[name].isActive:
            raise ValueError(f"{name} is subscribed")
        self._ensure()
        stream = self.spark.readStream.schema(EVENT).parquet(self.folder).where(F.col("event") == event)
        stream = stream.withWatermark("timestamp", REPEAT).dropDuplicatesWithinWatermark(["event_id"])
        trigger = {"processingTime": every} if every else {"availableNow": True}
        query = stream.writeStream.queryName(name).foreachBatch(handler).option("checkpointLocation", checkpoint).trigger(**trigger).start()
        self.consumers[name] = query
        return query

    def _ensure(self) -> None:
        """The log's folder exists, so that a subscription can wait for the first event."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(where)

    def unsubscribe(self, name: str) -> None:
        if query := self.consumers.pop(name, None):
            query.stop()

    def close(self) -> None:
        for name in list(self.consumers):
            self.unsubscribe(name)
