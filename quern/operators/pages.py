"""Paging: keyset pages, batch reads, pages that keep groups whole, and signed cursors."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import time

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.model import PAGE_CEILING


def clamp(requested: int, configured: int = PAGE_CEILING) -> tuple[int, str | None]:
    """The page size to use and a notice if it isn't what was asked for. 0 means the configured size; a request may
    only narrow it."""
    if requested < 0:
        raise ValueError("a page can't be negative")
    effective = min(requested or configured, configured, PAGE_CEILING)
    return effective, None if requested in (0, effective) else f"requested {requested}, effective {effective}"


def keyset(df: DataFrame, keys: list[str], after: list | None, limit: int) -> DataFrame:
    """The next page in order of the keys: a filter the scan can use, and a top-k without a full sort."""
    if after is not None:
        if len(keys) == 1:
            df = df.where(F.col(keys[0]) > F.lit(after[0]))
        else:
            df = df.where(F.struct(*keys) > F.struct(*(F.lit(v).alias(k) for k, v in zip(keys, after))))
    return df.orderBy(*keys).limit(limit)


def batch(df: DataFrame, key: str, values: list) -> DataFrame:
    """Rows of the given keys; unknown keys give none, repeated ones count once."""
    return df.where(F.col(key).isin(*dict.fromkeys(values)))


def whole_groups(counts: DataFrame, key: str, size: str, per_page: int) -> DataFrame:
    """(key, page, first_in_page): a group is never split; it starts on the page that its first row falls on.

    The running sum is over groups, not rows. Ranges of keys are summed apart and shifted by the sums before them, so
    the order isn't made in one task.
    """
    spread = counts.select(key, F.col(size).alias("_n")).repartitionByRange(key).sortWithinPartitions(key).withColumn("_part", F.spark_partition_id())
    totals = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = spread.groupBy("_part").agg(F.sum("_n").alias("_t")).select("_part", F.coalesce(F.sum("_t").over(totals), F.lit(0)).alias("_before"))  # a row for each partition
    own = Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    at = spread.withColumn("_own", F.coalesce(F.sum("_n").over(own), F.lit(0))).join(F.broadcast(before), "_part")
    paged = at.select(key, F.floor((F.col("_own") + F.col("_before")) / per_page).cast("long").alias("page"))
    return paged.withColumn("first_in_page", F.col(key) == F.min(key).over(Window.partitionBy("page")))


def sign(secret: bytes, payload: dict) -> str:
    """A cursor: its payload with a signature over it."""
    body = json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()
    return base64.urlsafe_b64encode(hmac.digest(secret, body, "sha256") + body).decode().rstrip("=")


def opened(secret: bytes, cursor: str, **expected: object) -> dict:
    """The payload of a cursor, if its signature, its expiry and all expected fields hold."""
    try:
        raw = base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4))
        payload = json.loads(raw[32:])
    except ValueError:
        raise ValueError("invalid cursor") from None
    if not hmac.compare_digest(raw[:32], hmac.digest(secret, raw[32:], "sha256")) or payload.get("expires", 0) < time.time() or any(payload.get(k) != v for k, v in expected.items()):
        raise ValueError("invalid cursor")
    return payload


def query_hash(**request: object) -> str:
    return hashlib.sha256(json.dumps(request, sort_keys=True).encode()).hexdigest()
