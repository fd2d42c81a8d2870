"""Streams: changes of a graph applied as they come, and windows over events (X10 and an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schema
from ..graph import Graph, keep_newest
from ..sources import store


def apply_changes(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Apply a stream of changes to the graph saved at ``path``: each micro-batch is one difference, written as a new
    version (``path/v<n>``); ``path/v<n>`` of the highest n is the graph. A batch that runs again writes the same version.

    ``changes``: ``seq`` (order), ``op`` (``upsert`` or ``remove``), ``entity`` (``node`` or ``edge``), ``id``, ``body``
    (JSON of the row). The last change of an id in a batch counts.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = store.load_or_empty(spark, f"{path}/v{number - 1}")
        last = keep_newest(batch.withColumn("key", F.concat_ws(":", "entity", "id")), "key", "seq")
        put = last.where("op = 'upsert'")
        nodes = put.where("entity = 'node'").select(F.from_json("body", schema.NODES).alias("n")).select("n.*")
        edges = put.where("entity = 'edge'").select(F.from_json("body", schema.EDGES).alias("e")).select("e.*")
        gone = last.where("op = 'remove'")
        after = before.apply(removed_nodes=gone.where("entity = 'node'").select("id"), updated_nodes=nodes, removed_edges=gone.where("entity = 'edge'").select("id"), updated_edges=edges)
        store.save(Graph(after.nodes, after.edges), f"{path}/v{number}")

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events of each type in tumbling windows; works on a stream and on a table alike."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    counted = timed.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return counted.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """A user's sessions: runs of events without a gap."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    counted = timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
