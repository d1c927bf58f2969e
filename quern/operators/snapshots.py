"""Snapshots, blobs and generations: capture, content-addressed storage, reuse, carry-over and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def capture(index: DataFrame, walked: DataFrame) -> DataFrame:
    """(path, status, content_hash) of index and walked (path, content_hash, staged): tracked, modified, added, deleted or
    untracked. A walked file that the index lacks is added if staged, else untracked."""
    i = index.select("path", F.col("content_hash").alias("_i"))
    w = walked.select("path", F.col("content_hash").alias("_w"), "staged")
    status = F.when(F.col("_w").isNull(), "deleted").when(F.col("_i").isNull(), F.when(F.col("staged"), "added").otherwise("untracked")).when(F.col("_i") == F.col("_w"), "tracked").otherwise("modified")
    return i.join(w, "path", "full").select("path", status.alias("status"), F.coalesce("_w", "_i").alias("content_hash"))


def blobs(files: DataFrame, content: str = "content") -> DataFrame:
    """(hash, content, size_bytes, refs): each content once, under its SHA-256."""
    hashed = files.withColumn("hash", F.sha2(F.col(content), 256))
    return hashed.groupBy("hash").agg(F.min(content).alias("content"), F.min(F.octet_length(content)).cast("long").alias("size_bytes"), F.count(F.lit(1)).alias("refs"))


def unreferenced(stored: DataFrame, referenced: DataFrame, key: str = "hash") -> DataFrame:
    return stored.join(referenced.select(key), key, "left_anti")


def blocks(content: Column, size: int = 65_536) -> Column:
    """The SHA-256 of every block of a binary column."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.octet_length(content) / size) - 1, F.lit(0)).cast("int")), lambda k: F.sha2(F.substring(content, k * size + 1, F.lit(size)), 256))


def reusable(planned: DataFrame, sealed: DataFrame) -> DataFrame:
    """Planned units (scope_key, unit_key) with what to do: reuse a sealed unit of the same key, rebuild, or build anew."""
    same = sealed.select("scope_key", F.col("unit_key").alias("old_key"))
    action = F.when(F.col("old_key") == F.col("unit_key"), "reuse").when(F.col("old_key").isNotNull(), "delta").otherwise("build")
    return planned.join(same, "scope_key", "left").select("scope_key", "unit_key", action.alias("action"))


def carry_over(old: DataFrame, replaced: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Old facts whose key isn't replaced, with the fresh ones."""
    return old.join(replaced.select(key), key, "left_anti").unionByName(fresh)


def supported(relations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Relations with a piece of evidence left."""
    return relations.join(evidence.select("relation_id"), "relation_id", "left_semi")


def members_with_fallback(wanted: DataFrame, current: DataFrame, previous: DataFrame) -> DataFrame:
    """(scope_key, unit_id, carried, distance): the current unit of a scope, else the previous one, one generation older."""
    c = current.select("scope_key", F.col("unit_id").alias("_c"))
    p = previous.select("scope_key", F.col("unit_id").alias("_p"), "distance")
    found = wanted.select("scope_key").join(c, "scope_key", "left").join(p, "scope_key", "left")
    return found.select("scope_key", F.coalesce("_c", "_p").alias("unit_id"), F.col("_c").isNull().alias("carried"), F.when(F.col("_c").isNull(), F.col("distance") + 1).otherwise(0).alias("distance")).where("unit_id IS NOT NULL")
