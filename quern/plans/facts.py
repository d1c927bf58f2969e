"""Queries over facts: scans, filters, joins, aggregates, windows and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.hashing import framed
from quern.model import edge_cost
from quern.operators import facts as op
from quern.operators import pages
from quern.plans.catalog import query
from quern.plans.fixture import Fixture

PINNED = 2


def pinned_nodes(x: Fixture) -> DataFrame:
    return op.visible(x.nodes, x.generation_units, PINNED)


def pinned_relations(x: Fixture) -> DataFrame:
    return op.visible(x.relations, x.generation_units, PINNED)


VISIBLE = "unit_id IN (SELECT unit_id FROM generation_units WHERE generation_id = 2)"


@query(f"SELECT kind, unit_id, count(*) AS n, sum(length(qualified_name))::BIGINT AS name_chars FROM nodes WHERE {VISIBLE} GROUP BY kind, unit_id")
def visible_nodes(x: Fixture) -> DataFrame:
    return pinned_nodes(x).groupBy("kind", "unit_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("qualified_name")).cast("long").alias("name_chars"))


@query("SELECT kind, max(node_id) AS last, count(*) AS n FROM relations r SEMI JOIN (SELECT DISTINCT unit_id AS u, relation_id AS node_id FROM evidence) e ON r.relation_id = e.node_id GROUP BY kind".replace("max(node_id)", "max(relation_id)"))
def evidenced_relations(x: Fixture) -> DataFrame:
    return x.relations.join(x.evidence, "relation_id", "left_semi").groupBy("kind").agg(F.max("relation_id").alias("last"), F.count(F.lit(1)).alias("n"))


@query("SELECT relation_id, kind FROM relations r ANTI JOIN evidence e USING (relation_id)")
def unevidenced_relations(x: Fixture) -> DataFrame:
    return x.relations.join(x.evidence, "relation_id", "left_anti").select("relation_id", "kind")


@query("""WITH p AS (SELECT relation_id, precision_name, file_id, unit_id, row_number() OVER (PARTITION BY relation_id ORDER BY CASE precision_name WHEN 'compiler' THEN 0 WHEN 'static_analysis' THEN 1 ELSE 2 END, unit_id, id) AS n, id FROM evidence)
SELECT relation_id, precision_name, file_id, unit_id, id FROM p WHERE n = 1""")
def node_precedence(x: Fixture) -> DataFrame:
    rank = F.when(F.col("precision_name") == "compiler", 0).when(F.col("precision_name") == "static_analysis", 1).otherwise(2)
    return op.prefer(x.evidence, ["relation_id"], [rank, F.col("unit_id"), F.col("id")]).select("relation_id", "precision_name", "file_id", "unit_id", "id")


@query("SELECT node_id, name, qualified_name FROM nodes WHERE (name = 'small ring' OR qualified_name = 'EUROPE/FRANCE') AND kind IN ('function', 'package')")
def name_filter(x: Fixture) -> DataFrame:
    return x.nodes.where((F.col("name") == "small ring") | (F.col("qualified_name") == "EUROPE/FRANCE")).where(op.in_kinds("kind", ["function", "package"])).select("node_id", "name", "qualified_name")


@query("SELECT node_id, qualified_name FROM nodes WHERE starts_with(qualified_name, 'Brand#1.')")
def prefix_range(x: Fixture) -> DataFrame:
    return x.nodes.where(op.prefix("qualified_name", "Brand#1.")).select("node_id", "qualified_name")


@query("SELECT doc_id, path FROM docs WHERE (path = 'en' OR starts_with(path, 'en/') OR starts_with(path, 'de/src1/')) AND language IN ('en', 'de')")
def path_language_filter(x: Fixture) -> DataFrame:
    return x.docs.where(op.under_paths("path", ["en", "de/src1"]) & F.col("language").isin("en", "de")).select("doc_id", "path")


@query(f"SELECT kind, count(*) AS n, sum(end_byte - start_byte)::BIGINT AS bytes FROM nodes WHERE {VISIBLE} AND file_id IS NOT NULL AND start_byte IS NOT NULL GROUP BY kind")
def declaration_filter(x: Fixture) -> DataFrame:
    return op.declarations(pinned_nodes(x)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end_byte") - F.col("start_byte")).cast("long").alias("bytes"))


@query("SELECT kind, CASE kind WHEN 'calls' THEN 1 WHEN 'references' THEN 2 ELSE 6 END AS cost, count(*) AS n FROM relations WHERE kind IN ('calls', 'references', 'contains') GROUP BY kind")
def relation_costs(x: Fixture) -> DataFrame:
    return x.relations.where(op.in_kinds("kind", ["calls", "references", "contains"])).groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select("kind", edge_cost(F.col("kind")).alias("cost"), "n")


@query("""SELECT n.kind, e.precision_name, count(*) AS n, count(DISTINCT e.relation_id) AS relations FROM evidence e JOIN relations r USING (relation_id) JOIN nodes n ON n.node_id = r.from_node_id
JOIN (SELECT unit_id FROM generation_units WHERE generation_id = 2) g ON g.unit_id = e.unit_id GROUP BY n.kind, e.precision_name""")
def fact_identity_join(x: Fixture) -> DataFrame:
    e = op.visible(x.evidence, x.generation_units, PINNED)
    r = x.relations.select("relation_id", F.col("from_node_id").alias("node_id"))
    return e.join(r, "relation_id").join(x.nodes.select("node_id", "kind"), "node_id").groupBy("kind", "precision_name").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("relation_id").alias("relations"))


@query("SELECT doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic, n_chars FROM documents LEFT JOIN labels USING (doc_id)")
def optional_inputs(x: Fixture) -> DataFrame:
    return x.documents.join(x.labels, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(-1)).alias("toxic"), "n_chars")


@query("WITH s AS (SELECT 'package:' || n_nationkey AS node_id FROM nation WHERE n_regionkey = 1) SELECT DISTINCT relation_id, kind FROM relations WHERE from_node_id IN (SELECT node_id FROM s) OR to_node_id IN (SELECT node_id FROM s)")
def touching_edges(x: Fixture) -> DataFrame:
    seeds = x.nation.where("n_regionkey = 1").select(F.concat(F.lit("package:"), "n_nationkey").alias("node_id"))
    return op.touching(x.relations, seeds).select("relation_id", "kind")


@query("""SELECT node, count(*) AS degree, count(*) FILTER (WHERE incoming) AS incoming_edges FROM (SELECT from_node_id AS node, false AS incoming FROM relations UNION ALL SELECT to_node_id, true FROM relations) GROUP BY node""")
def node_degrees(x: Fixture) -> DataFrame:
    return op.adjacency(x.relations).groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.count_if("incoming").alias("incoming_edges"))


@query("SELECT relation_id, least(count(*), 4294967295)::BIGINT AS evidence_count FROM evidence GROUP BY relation_id")
def evidence_count(x: Fixture) -> DataFrame:
    return op.evidence_counts(x.evidence).withColumn("evidence_count", F.col("evidence_count").cast("long"))


@query("SELECT relation_id, id, n FROM (SELECT relation_id, id, row_number() OVER (PARTITION BY relation_id ORDER BY id)::INT AS n FROM evidence) WHERE n <= 3")
def evidence_topn(x: Fixture) -> DataFrame:
    return op.first_evidence(x.evidence, 3).select("relation_id", "id", "n")


@query("SELECT relation_id, count(*) AS dropped FROM (SELECT relation_id, row_number() OVER (PARTITION BY relation_id ORDER BY id) AS n FROM evidence) WHERE n > 2 GROUP BY relation_id")
def evidence_clip(x: Fixture) -> DataFrame:
    w = Window.partitionBy("relation_id").orderBy("id")
    return x.evidence.withColumn("n", F.row_number().over(w)).where("n > 2").groupBy("relation_id").agg(F.count(F.lit(1)).alias("dropped"))


_CONTAINERS = """
holders AS (SELECT node_id AS container_id, file_id FROM nodes WHERE kind IN ('package', 'module')),
claims AS (SELECT to_node_id AS node_id, min(container_id) AS claim FROM relations JOIN holders ON from_node_id = container_id WHERE kind = 'contains' GROUP BY to_node_id),
owners AS (SELECT file_id, min(container_id) AS owner FROM holders WHERE file_id IS NOT NULL GROUP BY file_id),
held AS (SELECT n.node_id, coalesce(CASE WHEN n.kind IN ('package', 'module') THEN n.node_id END, claim, owner) AS container_id FROM nodes n LEFT JOIN claims USING (node_id) LEFT JOIN owners USING (file_id)),
direct AS (SELECT * FROM held WHERE container_id IS NOT NULL),
up AS (SELECT r.to_node_id AS node_id, min(d.container_id) AS container_id FROM relations r JOIN direct d ON d.node_id = r.from_node_id WHERE r.kind = 'defines' AND r.to_node_id NOT IN (SELECT node_id FROM direct) GROUP BY r.to_node_id),
inherited AS (SELECT * FROM direct UNION ALL SELECT * FROM up)"""


@query(f"WITH {_CONTAINERS} SELECT node_id, container_id FROM direct")
def container_assignment(x: Fixture) -> DataFrame:
    return op.containers(x.nodes, x.relations)


@query("SELECT kind, (dense_rank() OVER (ORDER BY kind))::INT AS code FROM (SELECT DISTINCT kind FROM relations)")
def kind_dictionary(x: Fixture) -> DataFrame:
    return x.relations.select("kind").distinct().withColumn("code", F.dense_rank().over(Window.orderBy("kind")))  # a vocabulary's few rows


@query(f"""WITH {_CONTAINERS}, functions AS (SELECT r.from_node_id AS node_id, min(r.to_node_id) AS container_id FROM relations r WHERE r.kind = 'references' GROUP BY r.from_node_id),
everyone AS (SELECT * FROM inherited UNION ALL SELECT * FROM functions),
e AS (SELECT r.from_node_id, r.to_node_id, c.n FROM relations r JOIN (SELECT relation_id, count(*) AS n FROM evidence GROUP BY relation_id) c USING (relation_id) WHERE r.kind = 'calls')
SELECT a.container_id AS from_container, b.container_id AS to_container, count(*) AS pair_count, sum(n)::BIGINT AS evidence_count
FROM e JOIN everyone a ON a.node_id = e.from_node_id JOIN everyone b ON b.node_id = e.to_node_id WHERE a.container_id <> b.container_id GROUP BY 1, 2""")
def package_rollup(x: Fixture) -> DataFrame:
    calls = x.relations.where("kind = 'calls'").join(op.evidence_counts(x.evidence), "relation_id")
    functions = x.relations.where("kind = 'references'").groupBy(F.col("from_node_id").alias("node_id")).agg(F.min("to_node_id").alias("container_id"))
    return op.rollup(calls, op.inherited_containers(x.nodes, x.relations).unionByName(functions))


@query("""SELECT r.from_node_id AS parent, count(*) FILTER (WHERE n.kind = 'package') AS packages, count(*) FILTER (WHERE n.kind IN ('method', 'function', 'class')) AS symbols,
sum(CASE WHEN n.kind IN ('method', 'function', 'class') THEN coalesce(n.end_byte - n.start_byte, 0) ELSE 0 END)::BIGINT AS symbol_bytes
FROM relations r JOIN nodes n ON n.node_id = r.to_node_id WHERE r.kind IN ('contains', 'defines') GROUP BY 1""")
def direct_contents(x: Fixture) -> DataFrame:
    return op.direct_contents(x.nodes, x.relations)


@query(f"WITH {_CONTAINERS} SELECT i.container_id, count(DISTINCT r.relation_id) AS centrality FROM inherited i JOIN relations r ON r.from_node_id = i.node_id OR r.to_node_id = i.node_id GROUP BY 1")
def package_centrality(x: Fixture) -> DataFrame:
    held = op.inherited_containers(x.nodes, x.relations)
    seen = op.adjacency(x.relations).select(F.col("node").alias("node_id"), "relation_id")
    return held.join(seen, "node_id").groupBy("container_id").agg(F.countDistinct("relation_id").alias("centrality"))


@query("SELECT relation_id, greatest(max(CASE precision_name WHEN 'compiler' THEN 1000000 WHEN 'static_analysis' THEN 950000 ELSE 720000 END), 450000)::INT AS trust FROM evidence GROUP BY relation_id")
def precise_evidence(x: Fixture) -> DataFrame:
    return x.evidence.groupBy("relation_id").agg(F.greatest(F.max(op.trust(F.col("precision_name"))), F.lit(450_000)).cast("int").alias("trust"))


@query("SELECT file_id, count(*) AS entries, sum(end_byte - start_byte)::BIGINT AS bytes, bool_or(precision_name = 'compiler') AS required, min(id) AS first_id FROM evidence GROUP BY file_id")
def file_groups(x: Fixture) -> DataFrame:
    return x.evidence.groupBy("file_id").agg(F.count(F.lit(1)).alias("entries"), F.sum(F.col("end_byte") - F.col("start_byte")).cast("long").alias("bytes"), F.bool_or(F.col("precision_name") == "compiler").alias("required"), F.min("id").alias("first_id"))


@query("SELECT user_id, arg_min(event_id, struct_pack(ts, event_id)) AS first_event, arg_min(event_type, struct_pack(ts, event_id)) AS first_type FROM events GROUP BY user_id")
def first_arrival(x: Fixture) -> DataFrame:
    first = op.prefer(x.events.select("user_id", "event_id", "event_type", "ts"), ["user_id"], [F.col("ts"), F.col("event_id")])
    return first.select("user_id", F.col("event_id").alias("first_event"), F.col("event_type").alias("first_type"))


@query("SELECT string_agg(kind, ' ' ORDER BY kind) AS kinds, to_id FROM (SELECT DISTINCT kind, to_node_id AS to_id FROM relations) GROUP BY to_id HAVING count(*) > 1")
def ambiguous_targets(x: Fixture) -> DataFrame:
    seen = x.relations.groupBy(F.col("to_node_id").alias("to_id")).agg(F.array_sort(F.collect_set("kind")).alias("k"))
    return seen.where(F.size("k") > 1).select(F.array_join("k", " ").alias("kinds"), "to_id")


@query("SELECT (SELECT count(*) FROM nodes) AS nodes_n, (SELECT count(*) FROM relations) AS relations_n, (SELECT count(*) FROM evidence) AS evidence_n, (SELECT count(*) FROM docs) AS docs_n, (SELECT count(*) FROM generation_units) AS members_n")
def store_stats(x: Fixture) -> DataFrame:
    parts = [getattr(x, t).agg(F.count(F.lit(1)).alias(n)) for t, n in (("nodes", "nodes_n"), ("relations", "relations_n"), ("evidence", "evidence_n"), ("docs", "docs_n"), ("generation_units", "members_n"))]
    rows = parts[0].select(F.lit("nodes_n").alias("k"), F.col("nodes_n").alias("n"))
    for p in parts[1:]:
        rows = rows.union(p.select(F.lit(p.columns[0]), F.col(p.columns[0])))
    return rows.groupBy().pivot("k", [p.columns[0] for p in parts]).agg(F.first("n"))


@query("SELECT unit_id, sum(strlen(body))::BIGINT + 64 * count(*) AS retained FROM docs GROUP BY unit_id")
def retained_bytes(x: Fixture) -> DataFrame:
    return x.docs.groupBy("unit_id").agg((F.sum(F.octet_length("body")).cast("long") + 64 * F.count(F.lit(1))).alias("retained"))


@query("SELECT kind, sum(CASE WHEN unit_id IN (SELECT unit_id FROM generation_units WHERE generation_id = 1) THEN 0 ELSE 1 END)::BIGINT AS exclusive FROM nodes WHERE unit_id IN (SELECT unit_id FROM generation_units WHERE generation_id = 2) GROUP BY kind")
def exclusive_facts(x: Fixture) -> DataFrame:
    """Facts of the pinned generation that another one doesn't hold too."""
    only = pinned_nodes(x).join(op.members(x.generation_units, 1).withColumn("shared", F.lit(True)), "unit_id", "left")
    return only.groupBy("kind").agg(F.sum(F.when(F.col("shared"), 0).otherwise(1)).cast("long").alias("exclusive"))


@query("SELECT unit_id, sum(CASE WHEN carried THEN distance_generations ELSE 0 END) OVER (PARTITION BY unit_id ORDER BY generation_id)::BIGINT AS distance, generation_id FROM generation_units")
def carry_distance(x: Fixture) -> DataFrame:
    w = Window.partitionBy("unit_id").orderBy("generation_id").rowsBetween(Window.unboundedPreceding, 0)
    return x.generation_units.select("unit_id", F.sum(F.when(F.col("carried"), F.col("distance_generations")).otherwise(0)).over(w).cast("long").alias("distance"), "generation_id")


@query("""SELECT key, CASE WHEN b IS NULL THEN 'added' WHEN a IS NULL THEN 'removed' ELSE 'changed' END AS change FROM (SELECT doc_id AS key, md5(text) AS b FROM documents WHERE doc_id % 7 <> 0)
FULL JOIN (SELECT doc_id AS key, CASE WHEN doc_id % 5 = 0 THEN md5(text || '!') ELSE md5(text) END AS a FROM documents WHERE doc_id % 11 <> 0) USING (key) WHERE b IS DISTINCT FROM a""")
def keyset_diff(x: Fixture) -> DataFrame:
    before = x.documents.where("doc_id % 7 <> 0").select(F.col("doc_id").alias("key"), F.md5("text").alias("v"))
    after = x.documents.where("doc_id % 11 <> 0").select(F.col("doc_id").alias("key"), F.when(F.col("doc_id") % 5 == 0, F.md5(F.concat("text", F.lit("!")))).otherwise(F.md5("text")).alias("v"))
    return op.key_diff(before, after, "key", "v")


@query("""WITH a AS (SELECT lang AS scope_key, source AS native_key, source || ':' || (doc_id % 3) AS canonical_key, doc_id FROM documents WHERE doc_id % 2 = 0),
best AS (SELECT scope_key, native_key, min(canonical_key) AS k, count(DISTINCT canonical_key) AS n FROM a GROUP BY 1, 2),
c AS (SELECT doc_id AS id, lang AS scope_key, CASE WHEN doc_id % 4 = 1 THEN 'none' ELSE source END AS strong_key, source AS native_key FROM documents)
SELECT c.id, coalesce(s.k, w.k, c.scope_key || '#' || c.strong_key) AS canonical_key, coalesce(s.n, w.n, 0) > 1 AS ambiguous FROM c
LEFT JOIN best s ON s.scope_key = c.scope_key AND s.native_key = c.strong_key LEFT JOIN best w ON w.scope_key = c.scope_key AND w.native_key = c.native_key""")
def alias_resolution(x: Fixture) -> DataFrame:
    d = x.documents
    aliases = d.where("doc_id % 2 = 0").select(F.col("lang").alias("scope_key"), F.col("source").alias("native_key"), F.concat("source", F.lit(":"), F.col("doc_id") % 3).alias("canonical_key"), F.concat(F.lit("doc:"), "doc_id").alias("node_id"))
    seen = d.select(F.col("doc_id").alias("id"), F.col("lang").alias("scope_key"), F.when(F.col("doc_id") % 4 == 1, "none").otherwise(F.col("source")).alias("strong_key"), F.col("source").alias("native_key"))
    return op.resolve_aliases(seen, aliases).select("id", "canonical_key", "ambiguous")


@query("SELECT node_id, name, kind FROM nodes WHERE node_id > 'function:1' ORDER BY node_id LIMIT 50")
def keyset_page(x: Fixture) -> DataFrame:
    return pages.keyset(x.nodes.select("node_id", "name", "kind"), ["node_id"], ["function:1"], 50)


@query("SELECT * FROM (VALUES ('class:1'), ('class:2'), ('nobody')) AS v(node_id) JOIN (SELECT node_id, name, qualified_name FROM nodes) USING (node_id)")
def batch_read(x: Fixture) -> DataFrame:
    return pages.batch(x.nodes.select("node_id", "name", "qualified_name"), "node_id", ["class:1", "class:2", "class:2", "nobody"])


@query("SELECT relation_id, page, first_in_page FROM (SELECT relation_id, page, (row_number() OVER (PARTITION BY page ORDER BY relation_id))::INT = 1 AS first_in_page FROM (SELECT relation_id, ((sum(n) OVER (ORDER BY relation_id ROWS UNBOUNDED PRECEDING) - n) // 200)::BIGINT AS page FROM (SELECT relation_id, count(*) AS n FROM evidence GROUP BY relation_id)))")
def reference_pages(x: Fixture) -> DataFrame:
    counts = op.evidence_counts(x.evidence)
    return pages.whole_groups(counts, "relation_id", "evidence_count", 200)


@query("WITH a AS (SELECT DISTINCT to_node_id AS id FROM relations WHERE kind = 'calls'), b AS (SELECT DISTINCT from_node_id AS id FROM relations WHERE kind = 'references') SELECT (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS either, (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS both_sides, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS only_b")
def set_operations(x: Fixture) -> DataFrame:
    a = x.relations.where("kind = 'calls'").select(F.col("to_node_id").alias("id"), F.lit(1).alias("in_a"), F.lit(0).alias("in_b"))
    b = x.relations.where("kind = 'references'").select("from_node_id", F.lit(0), F.lit(1))
    per = a.union(b).groupBy("id").agg(F.max("in_a").alias("a"), F.max("in_b").alias("b"))  # one pass for all three sets
    return per.agg(F.count(F.lit(1)).alias("either"), F.count_if(F.expr("a = 1 AND b = 1")).alias("both_sides"), F.count_if(F.expr("a = 0 AND b = 1")).alias("only_b"))


@query("SELECT node_id, sha256(unhex(lpad(to_hex(strlen('node-v1')), 16, '0')) || encode('node-v1') || unhex(lpad(to_hex(strlen(kind)), 16, '0')) || encode(kind) || unhex(lpad(to_hex(strlen(qualified_name)), 16, '0')) || encode(qualified_name)) AS id FROM nodes")
def framed_ids(x: Fixture) -> DataFrame:
    return x.nodes.select("node_id", framed("node-v1", F.col("kind"), F.col("qualified_name")).alias("id"))


@query("SELECT from_node_id, sha256(string_agg(to_node_id, chr(10) ORDER BY to_node_id)) AS digest, count(*) AS n FROM relations WHERE kind = 'references' GROUP BY from_node_id")
def hash_fold(x: Fixture) -> DataFrame:
    """An order-sensitive digest of each group. Groups are a node's own edges; the whole graph's digest folds these."""
    per = x.relations.where("kind = 'references'").groupBy("from_node_id").agg(F.array_sort(F.collect_list("to_node_id")).alias("t"))
    return per.select("from_node_id", F.sha2(F.array_join("t", "\n"), 256).alias("digest"), F.size("t").cast("long").alias("n"))


@query("SELECT 'orphan' AS problem, count(*) AS n FROM relations r WHERE NOT EXISTS (SELECT 1 FROM nodes WHERE node_id = r.from_node_id) UNION ALL SELECT 'dangling', count(*) FROM relations r WHERE NOT EXISTS (SELECT 1 FROM nodes WHERE node_id = r.to_node_id) UNION ALL SELECT 'evidence_without_relation', count(*) FROM evidence e WHERE NOT EXISTS (SELECT 1 FROM relations WHERE relation_id = e.relation_id) UNION ALL SELECT 'empty_range', count(*) FROM evidence WHERE end_byte <= start_byte")
def integrity_checks(x: Fixture) -> DataFrame:
    ids = x.nodes.select("node_id")
    one = F.count(F.lit(1)).alias("n")
    checks = {
        "orphan": x.relations.join(ids, F.col("from_node_id") == ids.node_id, "left_anti"),
        "dangling": x.relations.join(ids, F.col("to_node_id") == ids.node_id, "left_anti"),
        "evidence_without_relation": x.evidence.join(x.relations, "relation_id", "left_anti"),
        "empty_range": x.evidence.where("end_byte <= start_byte"),
    }
    rows = [d.agg(one).select(F.lit(k).alias("problem"), "n") for k, d in checks.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out
