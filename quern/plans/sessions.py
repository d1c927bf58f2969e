"""Queries over read sessions, run ledgers and watches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators import intervals as op
from quern.operators import ledger
from quern.plans.catalog import query
from quern.plans.fixture import Fixture

_MERGED = """p AS (SELECT *, max(end_byte) OVER (PARTITION BY conv_id ORDER BY start_byte, end_byte ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f FROM receipts WHERE start_byte < end_byte),
i AS (SELECT conv_id, start_byte, end_byte, sum(CASE WHEN start_byte > coalesce(f, -1) THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY start_byte, end_byte ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM p),
m AS (SELECT conv_id, min(start_byte) AS start_byte, max(end_byte) AS end_byte FROM i GROUP BY conv_id, island),
z AS (SELECT conv_id, sum(coalesce(length(text), 0))::BIGINT AS size_bytes FROM conversations GROUP BY conv_id),
g AS (SELECT z.conv_id, size_bytes, coalesce(sum(end_byte - start_byte), 0)::BIGINT AS read_bytes FROM z LEFT JOIN m USING (conv_id) GROUP BY z.conv_id, size_bytes),
s AS (SELECT *, CASE WHEN read_bytes >= size_bytes THEN 'full' WHEN read_bytes > 0 THEN 'partial' ELSE 'unserved' END AS state FROM g)"""


def merged(x: Fixture) -> DataFrame:
    return op.coalesce(x.receipts, ["conv_id"])


def covered(x: Fixture) -> DataFrame:
    sizes = x.conversations.groupBy("conv_id").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("long").alias("size_bytes"))
    return op.coverage(sizes, merged(x), ["conv_id"])


@query(f"WITH {_MERGED} SELECT conv_id, start_byte, end_byte FROM m")
def interval_merge(x: Fixture) -> DataFrame:
    return merged(x)


@query(f"WITH {_MERGED} SELECT conv_id, size_bytes, read_bytes, state FROM s")
def coverage_status(x: Fixture) -> DataFrame:
    return covered(x)


@query(f"WITH {_MERGED} SELECT count(*) AS required, count(*) FILTER (WHERE state = 'full') AS fully_read, count(*) FILTER (WHERE state = 'partial') AS in_part, count(*) FILTER (WHERE state <> 'full' AND conv_id % 10 = 0) AS waived FROM s")
def coverage_summary(x: Fixture) -> DataFrame:
    return covered(x).agg(F.count(F.lit(1)).alias("required"), F.count_if(F.col("state") == "full").alias("fully_read"), F.count_if(F.col("state") == "partial").alias("in_part"), F.count_if(F.expr("state <> 'full' AND conv_id % 10 = 0")).alias("waived"))


@query(f"WITH {_MERGED} SELECT r.conv_id, r.turn FROM receipts r WHERE EXISTS (SELECT 1 FROM m WHERE m.conv_id = r.conv_id AND m.start_byte <= r.start_byte AND m.end_byte >= r.end_byte + 10)")
def range_containment(x: Fixture) -> DataFrame:
    q = x.receipts.select("conv_id", "turn", F.col("start_byte").alias("s"), (F.col("end_byte") + 10).alias("e"))
    return op.contained(q, merged(x), ["conv_id"]).select("conv_id", "turn")


@query("""SELECT e.id, arg_min(n.node_id, struct_pack(size := n.end_byte - n.start_byte, node_id := n.node_id)) AS owner, min(n.end_byte - n.start_byte) AS size FROM evidence e JOIN nodes n ON n.file_id = e.file_id AND n.start_byte <= e.start_byte AND n.end_byte >= e.end_byte GROUP BY e.id""")
def innermost_owner(x: Fixture) -> DataFrame:
    spans = x.evidence.select("id", "file_id", F.col("start_byte").alias("s"), F.col("end_byte").alias("e"))
    return op.innermost(spans, x.nodes)


@query("""SELECT conv_id, min(CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END)::INT AS requirement FROM (SELECT conv_id, role FROM conversations WHERE turn < 2 UNION ALL SELECT conv_id, role FROM conversations WHERE turn >= 2) GROUP BY conv_id""")
def scope_union(x: Fixture) -> DataFrame:
    """A scope only grows, and each file keeps the strongest requirement it ever had."""
    rank = F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).otherwise(2)
    old, new = x.conversations.where("turn < 2"), x.conversations.where("turn >= 2")
    return old.unionByName(new).groupBy("conv_id").agg(F.min(rank).alias("requirement"))


@query("""SELECT a.run_id, a.seq, a.stage, b.stage AS parent_stage, a.seq // 4 * 4 AS parent_seq FROM spans a LEFT JOIN spans b ON b.run_id = a.run_id AND b.seq = a.seq // 4 * 4 AND a.seq % 4 <> 0""".replace("a.seq // 4 * 4 AS parent_seq", "CASE WHEN a.seq % 4 <> 0 THEN a.seq // 4 * 4 ELSE -1 END AS parent_seq"))
def span_parents(x: Fixture) -> DataFrame:
    s = x.spans.select("run_id", "seq", "stage", F.when(F.expr("seq % 4 <> 0"), F.expr("(seq DIV 4) * 4")).alias("parent_seq"))
    return ledger.with_parents(s).select("run_id", "seq", "stage", "parent_stage", F.coalesce("parent_seq", F.lit(-1)).alias("parent_seq"))


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_run(x: Fixture) -> DataFrame:
    return ledger.latest(x.events.select("user_id", "event_type", "event_id", "value", "ts"), ["user_id"], "ts", "event_id").select("user_id", "event_type", "event_id", "value")


@query("SELECT event_type AS scope, max(value) AS peak FROM events GROUP BY event_type")
def peak_high_water(x: Fixture) -> DataFrame:
    e = x.events.select(F.col("event_type").alias("scope"), F.col("value").alias("peak"), "event_id")
    return ledger.raise_peaks(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"))


@query("""WITH g AS (SELECT user_id, ts, event_id, event_type, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS batch FROM g)
SELECT user_id, min(ts) AS started, count(*) AS n, count(DISTINCT event_type) AS kinds FROM b GROUP BY user_id, batch""")
def debounce_sessions(x: Fixture) -> DataFrame:
    """Events of one user less than half an hour apart are one batch. A stream runs the same grouping (see streaming)."""
    w = F.session_window("ts", "30 minutes")
    return x.events.groupBy("user_id", w).agg(F.count(F.lit(1)).alias("n"), F.size(F.collect_set("event_type")).cast("long").alias("kinds")).select("user_id", F.col("session_window.start").alias("started"), "n", "kinds")


@query("""SELECT event_type AS provider, CASE max(CASE WHEN value > 90 THEN 3 WHEN value > 60 THEN 2 WHEN value > 30 THEN 1 ELSE 0 END) WHEN 3 THEN 'failed' WHEN 2 THEN 'stale' WHEN 1 THEN 'partial' ELSE 'fresh' END AS state, count(*) AS n, arg_max(event_id, struct_pack(r := CASE WHEN value > 90 THEN 3 WHEN value > 60 THEN 2 WHEN value > 30 THEN 1 ELSE 0 END, e := event_id)) AS exemplar FROM events GROUP BY event_type""")
def capability_fold(x: Fixture) -> DataFrame:
    rank = F.when(F.col("value") > 90, 3).when(F.col("value") > 60, 2).when(F.col("value") > 30, 1).otherwise(0)
    worst = x.events.groupBy(F.col("event_type").alias("provider")).agg(F.max(rank).alias("r"), F.count(F.lit(1)).alias("n"), F.max_by("event_id", F.struct(rank.alias("r"), "event_id")).alias("exemplar"))
    name = F.when(F.col("r") == 3, "failed").when(F.col("r") == 2, "stale").when(F.col("r") == 1, "partial").otherwise("fresh")
    return worst.select("provider", name.alias("state"), "n", "exemplar")


@query("SELECT event_type AS ref, max(ts) AS activated_at, max(event_id) AS last_id FROM events GROUP BY event_type ORDER BY activated_at DESC, last_id DESC")
def ref_lru(x: Fixture) -> DataFrame:
    return x.events.groupBy(F.col("event_type").alias("ref")).agg(F.max("ts").alias("activated_at"), F.max("event_id").alias("last_id")).orderBy(F.desc("activated_at"), F.desc("last_id"))


@query("SELECT conv_id, count(*) AS unconfirmed, max(end_byte) AS furthest FROM receipts WHERE role = 'user' AND end_byte > 100 GROUP BY conv_id")
def unconfirmed_chunks(x: Fixture) -> DataFrame:
    return x.receipts.where("role = 'user' AND end_byte > 100").groupBy("conv_id").agg(F.count(F.lit(1)).alias("unconfirmed"), F.max("end_byte").alias("furthest"))


@query("SELECT event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::BIGINT AS ordinal, user_id FROM events")
def ordinals(x: Fixture) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return x.events.select("event_id", (F.row_number().over(w) - 1).cast("long").alias("ordinal"), "user_id")


@query("SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL AND CAST(json_extract_string(props, '$.k') AS BIGINT) > 50")
def metadata_filter(x: Fixture) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return x.events.select("event_id", "user_id", k.alias("k")).where("k > 50")
