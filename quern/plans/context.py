"""Queries over context plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.text import mul_scaled
from quern.operators import context as op
from quern.operators import facts, graph
from quern.plans.catalog import query
from quern.plans.fixture import Fixture


@query("SELECT o_orderkey, (CAST(round(o_totalprice) AS BIGINT) * (o_orderkey % 1000003) + 500000) // 1000000 AS scaled FROM orders")
def scaled_product(x: Fixture) -> DataFrame:
    return x.orders.select("o_orderkey", mul_scaled(F.round("o_totalprice").cast("long"), F.col("o_orderkey") % 1000003).alias("scaled"))


_STEP = "(CASE kind WHEN 'calls' THEN 900000::BIGINT WHEN 'references' THEN 780000 ELSE 350000 END * trust + 500000) // 1000000"


@query(f"""WITH t AS (SELECT relation_id, max(CASE precision_name WHEN 'compiler' THEN 1000000 WHEN 'static_analysis' THEN 950000 ELSE 720000 END) AS trust FROM evidence GROUP BY relation_id),
e AS (SELECT from_node_id, to_node_id, kind, relation_id, {_STEP} AS step FROM relations JOIN t USING (relation_id))
SELECT b.to_node_id AS node_id, max((((((1000000 * a.step + 500000) // 1000000) * b.step + 500000) // 1000000) * 650000 + 500000) // 1000000)::BIGINT AS contribution FROM e a JOIN e b ON a.to_node_id = b.from_node_id WHERE a.kind = 'calls' AND b.kind = 'references' AND a.from_node_id IN ('method:1', 'method:2', 'method:3') GROUP BY 1""")
def path_contribution(x: Fixture) -> DataFrame:
    """Two-hop routes from three methods: a module keeps its best route, never a sum."""
    trust = x.evidence.groupBy("relation_id").agg(F.max(facts.trust(F.col("precision_name"))).alias("trust"))
    e = x.relations.join(trust, "relation_id").select("from_node_id", "to_node_id", "kind", F.struct("kind", "trust").alias("hop"))
    a = e.where(F.col("from_node_id").isin("method:1", "method:2", "method:3") & (F.col("kind") == "calls")).select(F.col("to_node_id").alias("mid"), F.col("hop").alias("h1"))
    b = e.where("kind = 'references'").select(F.col("from_node_id").alias("mid"), F.col("to_node_id").alias("node_id"), F.col("hop").alias("h2"))
    return a.join(b, "mid").groupBy("node_id").agg(F.max(op.route_score(F.array("h1", "h2"))).cast("long").alias("contribution"))


@query("""WITH d AS (SELECT node, count(*) AS edges FROM (SELECT from_node_id AS node FROM relations UNION ALL SELECT to_node_id FROM relations) GROUP BY node)
SELECT node_id, least(500000 + CASE WHEN name LIKE '%ring%' THEN 200000 ELSE 0 END + CASE WHEN end_byte > 3000 THEN 120000 ELSE 0 END + least(coalesce(edges, 0) * 5000, 50000), 1470000)::BIGINT AS score FROM nodes LEFT JOIN d ON d.node = node_id WHERE kind = 'function'""")
def context_boosts(x: Fixture) -> DataFrame:
    d = facts.adjacency(x.relations).groupBy(F.col("node").alias("node_id")).agg(F.count(F.lit(1)).alias("edges"))
    n = x.nodes.where("kind = 'function'").join(d, "node_id", "left")
    return n.select("node_id", op.boosted(F.lit(500_000), F.col("name").contains("ring"), F.col("end_byte") > 3000, F.lit(False), F.col("edges")).alias("score"))


_PLAN = """WITH e AS (SELECT from_node_id, to_node_id, relation_id FROM relations WHERE kind = 'calls'),
d AS (SELECT node, count(*) AS edges FROM (SELECT from_node_id AS node FROM relations UNION ALL SELECT to_node_id FROM relations) GROUP BY node),
l0 AS (SELECT unnest(['function:3', 'function:4']) AS node_id), l1 AS (SELECT DISTINCT from_node_id AS node_id FROM e WHERE to_node_id IN (SELECT node_id FROM l0)),
l2 AS (SELECT DISTINCT to_node_id AS node_id FROM e WHERE from_node_id IN (SELECT node_id FROM l1) AND to_node_id NOT IN (SELECT node_id FROM l0)),
l AS (SELECT node_id, 0 AS depth FROM l0 UNION ALL SELECT node_id, 1 FROM l1 UNION ALL SELECT node_id, 2 FROM l2)
SELECT node_id, kind, depth::INT AS depth, CASE WHEN depth < 2 THEN 1 ELSE 2 END::INT AS requirement_rank,
(CASE depth WHEN 0 THEN 1000000 WHEN 1 THEN 980000 ELSE 960000 END + CASE WHEN name LIKE '%ring%' THEN 200000 ELSE 0 END + CASE WHEN end_byte % 1000 = 0 THEN 120000 ELSE 0 END + least(edges * 5000, 50000))::BIGINT AS score_micros,
coalesce(end_byte - start_byte, 0)::BIGINT AS bytes, (4 * ceil(coalesce(end_byte - start_byte, 0) / 3.0))::BIGINT AS encoded_bytes FROM l JOIN nodes USING (node_id) JOIN d ON d.node = node_id"""


@query(_PLAN)
def context_plan(x: Fixture) -> DataFrame:
    seeds = x.spark.createDataFrame([("function:3",), ("function:4",)], "node string")
    reached = graph.walk(x.relations, seeds, ["calls"], "both", 2).reached.select("node", "depth", "cost")
    edges = facts.adjacency(x.relations).groupBy("node").agg(F.count(F.lit(1)).alias("edges"))
    named = x.nodes.select("node_id", F.col("name").contains("ring").alias("t"), (F.col("end_byte") % 1000 == 0).alias("c"))
    flagged = reached.join(named.withColumnRenamed("node_id", "node"), "node")
    return op.plan(flagged, x.nodes, edges, F.coalesce("c", F.lit(False)), F.col("t")).drop("path")


@query()
def context_packing(x: Fixture) -> DataFrame:
    """Each file's evidence as the entries of one plan, packed in order."""
    entries = x.evidence.select("file_id", "id", (F.length("relation_id") * 3).cast("long").alias("bytes"), F.length("relation_id").cast("long").alias("tokens"))
    return op.slices(entries, "file_id", ["id"], 400, 120)
