"""Queries over the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.model import DEFAULT_KINDS
from quern.operators import graph as op
from quern.plans.catalog import query
from quern.plans.fixture import Fixture


def some(x: Fixture, *nodes: str) -> DataFrame:
    return x.spark.createDataFrame([(n,) for n in nodes], "node string")


@query("""SELECT r.from_node_id AS caller, r.relation_id, n.qualified_name, c.n AS evidence_count FROM relations r JOIN nodes n ON n.node_id = r.from_node_id
JOIN (SELECT relation_id, count(*) AS n FROM evidence GROUP BY relation_id) c USING (relation_id)
WHERE r.kind = 'calls' AND r.to_node_id = 'function:7' AND r.unit_id IN (SELECT unit_id FROM generation_units WHERE generation_id = 2)""")
def callers(x: Fixture) -> DataFrame:
    from quern.operators import facts

    edges = facts.visible(x.relations.where("kind = 'calls' AND to_node_id = 'function:7'"), x.generation_units, 2)
    counts = facts.evidence_counts(x.evidence.join(edges, "relation_id", "left_semi"))
    names = x.nodes.select(F.col("node_id").alias("from_node_id"), "qualified_name")
    return edges.join(names, "from_node_id").join(counts, "relation_id").select(F.col("from_node_id").alias("caller"), "relation_id", "qualified_name", F.col("evidence_count").cast("long"))


_OUT = "WITH RECURSIVE w(node, depth) AS (SELECT unnest({seeds}), 0 UNION SELECT r.{to}, w.depth + 1 FROM w JOIN relations r ON r.{frm} = w.node WHERE w.depth < {k} AND r.kind IN ({kinds})) SELECT node, min(depth)::INT AS depth FROM w GROUP BY node"


@query(_OUT.format(seeds="['package:3', 'class:5']", to="to_node_id", frm="from_node_id", k=3, kinds="'contains', 'defines', 'calls', 'references'"))
def bfs_callees_k(x: Fixture) -> DataFrame:
    return op.walk(x.relations, some(x, "package:3", "class:5"), list(DEFAULT_KINDS), "outgoing", 3).reached.select("node", "depth")


@query(_OUT.format(seeds="['module:2']", to="from_node_id", frm="to_node_id", k=2, kinds="'calls', 'references'"))
def bfs_callers_k(x: Fixture) -> DataFrame:
    return op.walk(x.relations, some(x, "module:2"), ["calls", "references"], "incoming", 2).reached.select("node", "depth")


_LEVELS = """WITH adj AS MATERIALIZED (SELECT from_node_id AS node, to_node_id AS neighbour, relation_id, kind, false AS incoming FROM relations WHERE kind IN ('calls') UNION ALL SELECT to_node_id, from_node_id, relation_id, kind, true FROM relations WHERE kind IN ('calls')),
s AS (SELECT unnest(['function:1', 'function:2', 'method:5']) AS node, 0::BIGINT AS cost),
e1 AS MATERIALIZED (SELECT a.*, s.cost + 1 AS cost, 1 AS depth FROM adj a JOIN s USING (node) LEFT JOIN s AS n ON n.node = a.neighbour WHERE n.node IS NULL OR NOT a.incoming),
l1 AS MATERIALIZED (SELECT e1.neighbour AS node, min(e1.cost) AS cost FROM e1 ANTI JOIN s ON s.node = e1.neighbour GROUP BY e1.neighbour),
e2 AS MATERIALIZED (SELECT a.*, l1.cost + 1 AS cost, 2 AS depth FROM adj a JOIN l1 USING (node) LEFT JOIN s ON s.node = a.neighbour LEFT JOIN l1 AS n ON n.node = a.neighbour WHERE s.node IS NULL AND (n.node IS NULL OR NOT a.incoming)),
e AS (SELECT * FROM e1 UNION ALL SELECT * FROM e2)"""


@query(_LEVELS + " SELECT relation_id, node AS owner, neighbour, incoming, depth::INT AS depth, cost FROM e")
def both_walk(x: Fixture) -> DataFrame:
    return op.walk(x.relations, some(x, "function:1", "function:2", "method:5"), ["calls"], "both", 2).edges.select("relation_id", "owner", "neighbour", "incoming", "depth", "cost")


@query(_LEVELS + """, f AS (SELECT neighbour AS node_id, min(struct_pack(cost, depth, relation_id, owner := node)) AS b, bool_or(incoming) AS incoming, string_agg(DISTINCT kind || CASE WHEN incoming THEN '<' ELSE '>' END, ' ' ORDER BY kind || CASE WHEN incoming THEN '<' ELSE '>' END) AS reasons FROM e WHERE neighbour NOT IN (SELECT node FROM s) GROUP BY neighbour)
SELECT node_id, 1000000 // (1 + b.cost) AS score_micros, b.cost AS cost, b.depth::INT AS depth, b.relation_id AS via, incoming, reasons FROM f""")
def impact_rank(x: Fixture) -> DataFrame:
    return op.impact(x.relations, some(x, "function:1", "function:2", "method:5"), ["calls"], 2)


_DIST = """WITH RECURSIVE d(node, dist, hops) AS (SELECT 'package:3', 0::BIGINT, 0 UNION SELECT r.to_node_id, d.dist + CASE r.kind WHEN 'calls' THEN 1 WHEN 'references' THEN 2 ELSE 6 END, d.hops + 1 FROM d JOIN relations r ON r.from_node_id = d.node WHERE d.hops < 8),
b AS (SELECT node, min(struct_pack(dist, hops)) AS m FROM d GROUP BY node)"""


@query(_DIST + " SELECT node, m.dist AS dist, m.hops::INT AS hops FROM b")
def shortest_path_dist(x: Fixture) -> DataFrame:
    return op.distances(x.relations, some(x, "package:3"), list(DEFAULT_KINDS))


@query(_DIST + """, p AS (SELECT r.to_node_id AS node, r.from_node_id AS up, r.relation_id FROM relations r JOIN b v ON v.node = r.to_node_id JOIN b u ON u.node = r.from_node_id WHERE u.m.dist + CASE r.kind WHEN 'calls' THEN 1 WHEN 'references' THEN 2 ELSE 6 END = v.m.dist),
t(node, route) AS (SELECT 'function:11', []::VARCHAR[] UNION ALL SELECT p.up, list_prepend(p.relation_id, t.route) FROM t JOIN p ON p.node = t.node)
SELECT array_to_string(route, ' ') AS route, (SELECT m.dist FROM b WHERE node = 'function:11') AS cost FROM t WHERE node = 'package:3' ORDER BY route LIMIT 8""")
def route_enumeration(x: Fixture) -> DataFrame:
    found = op.routes(x.relations, some(x, "package:3"), "function:11", list(DEFAULT_KINDS), 8)
    return found.select(F.array_join("route", " ").alias("route"), "cost")


@query("""WITH RECURSIVE e AS (SELECT from_node_id AS a, to_node_id AS b FROM relations WHERE kind IN ('contains', 'defines')),
c(a, b) AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON e.a = c.b) SELECT a, b FROM c""")
def transitive_closure(x: Fixture) -> DataFrame:
    held = x.relations.where(F.col("kind").isin("contains", "defines"))
    return op.closure(held.select(F.col("from_node_id").alias("a"), F.col("to_node_id").alias("b")))


@query("""SELECT r.relation_id, e.id AS evidence_id, r.kind, r.from_node_id, r.to_node_id, e.file_id, e.start_byte, e.end_byte FROM relations r JOIN evidence e USING (relation_id) WHERE r.kind IN ('references', 'calls') AND r.to_node_id IN ('module:1', 'function:7')""")
def references(x: Fixture) -> DataFrame:
    return op.occurrences(x.relations, x.evidence, some(x, "module:1", "function:7"), ["references", "calls"], "incoming")


@query("""WITH h AS (SELECT node_id, kind, name FROM nodes WHERE kind IN ('repository', 'package', 'module')),
p AS (SELECT to_node_id AS node_id, min(from_node_id) AS parent FROM relations WHERE kind = 'contains' AND from_node_id IN (SELECT node_id FROM h) GROUP BY 1),
c AS (SELECT from_node_id AS node_id, count(*) AS children FROM relations WHERE kind IN ('contains', 'defines') GROUP BY 1)
SELECT node_id, kind, name, parent, CASE kind WHEN 'repository' THEN 0 WHEN 'package' THEN 1 ELSE 2 END AS depth, coalesce(children, 0) AS children FROM h LEFT JOIN p USING (node_id) LEFT JOIN c USING (node_id)""")
def repo_overview(x: Fixture) -> DataFrame:
    return op.overview(x.nodes, x.relations)
