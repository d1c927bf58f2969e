"""Watches as streams: debounced batches of changed paths, periodic windows, heartbeats, and refreshes applied once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

# How a watch gathers changes, and from where it reconciles the whole tree instead.
DEBOUNCE, RECONCILE, MOST_PATHS, MOST_BYTES = "250 milliseconds", "30 seconds", 10_000, 2 << 20


def batches(changes: DataFrame, gap: str = DEBOUNCE, late: str = RECONCILE, key: str | None = None, most_paths: int = MOST_PATHS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Changes (ts, path) gathered until none came for ``gap``: sorted distinct paths, or none of them and full = true
    where there are too many. Works on streams and on tables alike."""
    source = changes.withWatermark("ts", late) if changes.isStreaming else changes
    # a stream's session windows must have a key besides: without one, an empty prefix of the path
    by = [F.session_window("ts", gap).alias("w"), F.col(key) if key else F.substring("path", 1, 0).alias("_all")]
    found = source.groupBy(*by).agg(F.array_sort(F.collect_set("path")).alias("paths"), F.count(F.lit(1)).alias("n_events"))
    total = F.aggregate("paths", F.lit(0).cast("long"), lambda a, p: a + F.octet_length(p))
    full = (F.size("paths") > most_paths) | (total > most_bytes)
    out = found.withColumn("full", full)
    cols = [F.col("w.start").alias("started"), F.col("w.end").alias("ended"), *([F.col(key)] if key else [])]
    return out.select(*cols, F.when(~F.col("full"), F.col("paths")).otherwise(F.array().cast("array<string>")).alias("paths"), "n_events", F.when(F.col("full"), "overflow").otherwise("changes").alias("reason"), "full")


def tumbling(events: DataFrame, size: str, keys: list[str], late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts and sums of value in event-time windows."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    return source.groupBy(F.window("ts", size, slide).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("started"), *keys, "n", "total")


def heartbeats(beats: DataFrame) -> DataFrame:
    """The last beat of each session: (session_id, last_beat)."""
    return beats.groupBy("session_id").agg(F.max("ts").alias("last_beat"))


def live(last: DataFrame, now: str, expiry_seconds: int = 60) -> DataFrame:
    return last.withColumn("alive", F.col("last_beat") + F.expr(f"INTERVAL {expiry_seconds} SECONDS") >= F.lit(now).cast("timestamp"))


def apply_once(stream: DataFrame, refresh: Callable[[DataFrame, int], None], checkpoint: str, epoch_of: Callable[[], int] | None = None) -> StreamingQuery:
    """Runs refresh for each micro-batch that is there now, then stops. A batch whose epoch was already applied, as after a
    restart, is stale and left out."""

    def each(batch: DataFrame, epoch: int) -> None:
        if epoch_of is None or epoch > epoch_of():
            refresh(batch, epoch)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
