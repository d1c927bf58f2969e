"""Queries over retention, index segments and need models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import retention as op
from quern.plans.catalog import query
from quern.plans.fixture import Fixture
from quern.sources.classify import language


@query("""WITH b AS (SELECT sha256(body) AS hash, max(doc_id) AS d FROM docs GROUP BY 1), s AS (SELECT hash, CASE WHEN d % 3 > 0 THEN TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (d % 48) END AS trashed_at FROM b),
u AS (SELECT DISTINCT sha256(body) AS hash FROM docs WHERE doc_id % 5 = 0)
SELECT hash, CASE WHEN u.hash IS NOT NULL THEN CASE WHEN trashed_at IS NOT NULL THEN 'restore' ELSE 'keep' END WHEN trashed_at IS NULL THEN 'mark' WHEN trashed_at + INTERVAL 1 DAY <= TIMESTAMP '2024-01-02 12:00:00' THEN 'collect' ELSE 'wait' END AS action FROM s LEFT JOIN u USING (hash)""")
def blob_quarantine(x: Fixture) -> DataFrame:
    day = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01").cast("timestamp")) + F.col("d") % 48 * 3600)
    stored = x.docs.groupBy(F.sha2("body", 256).alias("hash")).agg(F.max("doc_id").alias("d")).select("hash", F.when(F.col("d") % 3 > 0, day).alias("trashed_at"))
    used = x.docs.where("doc_id % 5 = 0").select(F.sha2("body", 256).alias("hash"))
    return op.quarantine(stored, used, F.lit("2024-01-02 12:00:00").cast("timestamp"), 86_400)


@query("SELECT user_id AS owner_ref, max(ts + INTERVAL 1 HOUR) AS expires_at FROM events WHERE ts + INTERVAL 1 HOUR > (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY user_id")
def retention_leases(x: Fixture) -> DataFrame:
    now = x.events.agg(F.max("ts")).first()[0]
    leases = x.events.select(F.col("user_id").alias("owner_ref"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("expires_at"))
    return op.live_leases(leases, F.lit(now) - F.expr("INTERVAL 1 DAY"))


@query("""WITH s AS (SELECT 'file:' || name || '.' || language AS id, sum(strlen(body))::BIGINT * 100 AS bytes, count(*) AS docs, count(*) FILTER (WHERE doc_id % 3 = 0 OR name = 'src2') AS dead FROM docs GROUP BY name, language),
t AS (SELECT *, greatest(ceil(ln(bytes / 4194304.0::DOUBLE) / ln(4.0::DOUBLE)), 0)::INT AS tier, dead * 2 > docs AS alone FROM s),
f AS (SELECT min(tier) AS tier FROM (SELECT tier FROM t WHERE NOT alone GROUP BY tier HAVING count(*) >= 5))
SELECT id, 'rewrite' AS action, tier FROM t WHERE alone UNION ALL SELECT id, 'merge', tier FROM (SELECT id, tier, row_number() OVER (ORDER BY bytes, id) AS k FROM t WHERE NOT alone AND tier = (SELECT tier FROM f)) WHERE k <= 5""")
def segment_compaction(x: Fixture) -> DataFrame:
    segments = x.docs.groupBy(F.concat(F.lit("file:"), "name", F.lit("."), "language").alias("id")).agg((F.sum(F.octet_length("body")).cast("long") * 100).alias("bytes"), F.count(F.lit(1)).alias("docs"), F.count_if(F.expr("doc_id % 3 = 0 OR name = 'src2'")).alias("dead"))
    return op.compaction(segments)


@query("""WITH s AS (SELECT event_type AS class, value AS peak, event_id FROM events), k AS (SELECT class, count(*) AS observations, max(peak) AS peak, count(*) FILTER (WHERE peak > 80) AS overruns FROM s WHERE event_id % 2 = 0 GROUP BY class),
n AS (SELECT class, count(*) AS observations, max(peak) AS peak, count(*) FILTER (WHERE peak > 50) AS overruns FROM s WHERE event_id % 2 = 1 GROUP BY class)
SELECT class, sum(observations)::BIGINT AS observations, max(peak) AS peak, sum(overruns)::BIGINT AS overruns FROM (SELECT * FROM k UNION ALL SELECT * FROM n) GROUP BY class""")
def need_models(x: Fixture) -> DataFrame:
    s = x.events.select(F.col("event_type").alias("class"), F.col("value").alias("peak"), "event_id")
    known = s.where("event_id % 2 = 0").groupBy("class").agg(F.count(F.lit(1)).alias("observations"), F.max("peak").alias("peak"), F.count_if(F.expr("peak > 80")).alias("overruns"))
    return op.need_models(known, s.where("event_id % 2 = 1").withColumn("granted", F.lit(50)))


@query("""WITH p AS (SELECT doc_id, path || ['.h', '.py', '.cc', '.unknown', ''][doc_id % 5 + 1] AS path FROM docs)
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'cpp' WHEN 1 THEN 'python' WHEN 2 THEN 'cpp' ELSE '' END AS language FROM p""")
def language_tags(x: Fixture) -> DataFrame:
    ends = F.array(*map(F.lit, (".h", ".py", ".cc", ".unknown", "")))
    path = F.concat("path", F.element_at(ends, (F.col("doc_id") % 5 + 1).cast("int")))
    return x.docs.select("doc_id", F.coalesce(language(path, 3, 5), F.lit("")).alias("language"))
