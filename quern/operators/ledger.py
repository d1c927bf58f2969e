"""The run ledger: spans with their parents, latest runs, peaks and outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_parents(spans: DataFrame, seq: str = "seq", parent: str = "parent_seq") -> DataFrame:
    """Spans with their parent's stage; roots keep none."""
    up = spans.select("run_id", F.col(seq).alias(parent), F.col("stage").alias("parent_stage"))
    return spans.join(up, ["run_id", parent], "left")


def latest(rows: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """The last row of each key by time, then by tie."""
    row = F.struct(*(F.col(c) for c in rows.columns))
    return rows.groupBy(*keys).agg(F.max_by(row, F.struct(at, tie)).alias("_r")).select("_r.*")


def raise_peaks(known: DataFrame, seen: DataFrame, scope: str = "scope", peak: str = "peak") -> DataFrame:
    """The larger of what was known and what was seen, for each scope."""
    return known.select(scope, peak).unionByName(seen.select(scope, peak)).groupBy(scope).agg(F.max(peak).alias(peak))


def outcome(runs: DataFrame, now: str) -> DataFrame:
    """A run that didn't finish before it expired reads as interrupted."""
    return runs.withColumn("state", F.when(F.col("finished_at").isNotNull(), "finished").when(F.col("expires_at") < F.lit(now).cast("timestamp"), "interrupted").otherwise("running"))
