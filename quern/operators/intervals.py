"""Byte intervals: coalescing, containment, coverage and readiness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def coalesce(ranges: DataFrame, keys: list[str], start: str = "start_byte", end: str = "end_byte") -> DataFrame:
    """Disjoint intervals of each key: those that overlap or touch become one. Empty intervals are left out."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    furthest = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.where(F.col(start) < F.col(end)).withColumn("_new", (F.col(start) > F.coalesce(furthest, F.lit(-1))).cast("int"))
    island = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("_island", island).groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def contained(queries: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Queries (keys, s, e) that lie whole within one range of their key."""
    r = ranges.select(*keys, F.col("start_byte").alias("_s"), F.col("end_byte").alias("_e"))
    q = queries.alias("q")
    return q.join(r, [F.col(f"q.{k}") == r[k] for k in keys] + [r._s <= F.col("q.s"), r._e >= F.col("q.e")], "left_semi")


def innermost(spans: DataFrame, owners: DataFrame) -> DataFrame:
    """For each span (id, file_id, s, e), the shortest declaration of its file that encloses it, by node id if several do."""
    o = owners.select("file_id", "node_id", F.col("start_byte").alias("_s"), F.col("end_byte").alias("_e"))
    found = spans.join(o, (spans.file_id == o.file_id) & (o._s <= spans.s) & (o._e >= spans.e)).drop(o.file_id)
    return found.groupBy("id").agg(F.min(F.struct((F.col("_e") - F.col("_s")).alias("size"), "node_id")).alias("b")).select("id", F.col("b.node_id").alias("owner"), F.col("b.size").alias("size"))


def coverage(required: DataFrame, merged: DataFrame, keys: list[str]) -> DataFrame:
    """Per required file (keys, size_bytes), the bytes read and whether that is all, some or none of it."""
    read = merged.groupBy(*keys).agg(F.sum(F.col("end_byte") - F.col("start_byte")).alias("_r"))
    out = required.join(read, keys, "left").withColumn("read_bytes", F.coalesce("_r", F.lit(0)).cast("long")).drop("_r")
    state = F.when(F.col("read_bytes") >= F.col("size_bytes"), "full").when(F.col("read_bytes") > 0, "partial").otherwise("unserved")
    return out.withColumn("state", state)
