"""Retention: leases, expiry, quarantine with a grace period, and which index segments to merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Segments up to a tier's size merge with others of that tier, so many at once; a segment with more than
# half of its documents dead is rewritten alone.
TIER_BYTES, TIER_RATIO, FAN_IN = 4 << 20, 4, 5


def quarantine(stored: DataFrame, referenced: DataFrame, now: Column, grace_seconds: int) -> DataFrame:
    """Stored blobs (hash, trashed_at) with what becomes of them: a blob that nothing refers to is marked, and collected
    once it was marked for the grace period; one that is referred to again is restored."""
    used = referenced.select("hash", F.lit(True).alias("_used")).distinct()
    found = stored.join(used, "hash", "left")
    due = F.col("trashed_at") + F.make_interval(secs=F.lit(grace_seconds)) <= now
    action = F.when(F.col("_used"), F.when(F.col("trashed_at").isNotNull(), "restore").otherwise("keep")).when(F.col("trashed_at").isNull(), "mark").when(due, "collect").otherwise("wait")
    return found.select("hash", action.alias("action"))


def live_leases(leases: DataFrame, now: Column) -> DataFrame:
    """Leases that hold, one for each owner: the one that expires last."""
    return leases.where(F.col("expires_at") > now).groupBy("owner_ref").agg(F.max("expires_at").alias("expires_at"))


def tier(size: Column) -> Column:
    """0 up to TIER_BYTES, then one more for each TIER_RATIO times that."""
    return F.greatest(F.ceil(F.log(size / TIER_BYTES) / F.log(F.lit(float(TIER_RATIO)))), F.lit(0)).cast("int")


def compaction(segments: DataFrame) -> DataFrame:
    """(id, action, tier) of segments (id, bytes, docs, dead) that are rewritten: alone if mostly dead, else the smallest
    FAN_IN of the lowest tier that holds more than FAN_IN - 1."""
    alone = F.col("dead") * 2 > F.col("docs")
    rest = segments.where(~alone).withColumn("tier", tier(F.col("bytes")))
    full = rest.groupBy("tier").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FAN_IN).agg(F.min("tier").alias("tier"))
    w = Window.partitionBy("tier").orderBy("bytes", "id")
    merged = rest.join(F.broadcast(full), "tier").withColumn("k", F.row_number().over(w)).where(F.col("k") <= FAN_IN)  # one row
    return segments.where(alone).select("id", F.lit("rewrite").alias("action"), tier(F.col("bytes")).alias("tier")).unionByName(merged.select("id", F.lit("merge").alias("action"), "tier"))


def need_models(known: DataFrame, seen: DataFrame) -> DataFrame:
    """(class, observations, peak, overruns): counters of each size class with what was seen added."""
    added = seen.groupBy("class").agg(F.count(F.lit(1)).alias("observations"), F.max("peak").alias("peak"), F.count_if(F.col("peak") > F.col("granted")).alias("overruns"))
    return known.select("class", "observations", "peak", "overruns").unionByName(added).groupBy("class").agg(F.sum("observations").alias("observations"), F.max("peak").alias("peak"), F.sum("overruns").alias("overruns"))
