"""The star schema as a code graph.

Regions are repositories, nations packages, suppliers modules, customers classes, orders methods and parts functions.
Each text is plain SQL that Spark and DuckDB read alike; ``sql`` puts the ones a query needs before it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

NODES = """
SELECT 'geo' AS unit_id, 'repository:' || r_regionkey AS node_id, 'repository' AS kind, r_name AS name, r_name AS qualified_name, NULL AS file_id, CAST(NULL AS BIGINT) AS start_byte, CAST(NULL AS BIGINT) AS end_byte, r_name AS path FROM region
UNION ALL SELECT 'geo', 'package:' || n_nationkey, 'package', n_name, r_name || '/' || n_name, NULL, NULL, NULL, r_name || '/' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'suppliers', 'module:' || s_suppkey, 'module', s_name, n_name || '/' || s_name, 'file:s' || s_suppkey, 0, 1000000, n_name || '/' || s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT 'customers', 'class:' || c_custkey, 'class', c_name, n_name || '/' || c_name, 'file:c' || c_custkey, 0, 1000000000, n_name || '/' || c_name FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'orders-' || year(o_orderdate), 'method:' || o_orderkey, 'method', 'order' || o_orderkey, c_name || '.order' || o_orderkey, 'file:c' || o_custkey, o_orderkey * 64, o_orderkey * 64 + 64, n_name || '/' || c_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'parts', 'function:' || p_partkey, 'function', p_name, p_brand || '.' || p_name, 'file:p' || p_partkey, 0, p_size * 100, p_brand || '/' || p_name FROM part
"""

CALLS = "SELECT DISTINCT l_orderkey, l_partkey FROM lineitem"
REFERS = "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem"

RELATIONS = f"""
SELECT 'geo' AS unit_id, 'contains:' || n_regionkey || '>p' || n_nationkey AS relation_id, 'repository:' || n_regionkey AS from_node_id, 'contains' AS kind, 'package:' || n_nationkey AS to_node_id FROM nation
UNION ALL SELECT 'suppliers', 'contains:' || s_nationkey || '>m' || s_suppkey, 'package:' || s_nationkey, 'contains', 'module:' || s_suppkey FROM supplier
UNION ALL SELECT 'customers', 'contains:' || c_nationkey || '>c' || c_custkey, 'package:' || c_nationkey, 'contains', 'class:' || c_custkey FROM customer
UNION ALL SELECT 'orders-' || year(o_orderdate), 'defines:' || o_custkey || '>' || o_orderkey, 'class:' || o_custkey, 'defines', 'method:' || o_orderkey FROM orders
UNION ALL SELECT 'orders-' || year(o_orderdate), 'calls:' || l_orderkey || '>' || l_partkey, 'method:' || l_orderkey, 'calls', 'function:' || l_partkey FROM ({CALLS}) AS c JOIN orders ON o_orderkey = l_orderkey
UNION ALL SELECT 'parts', 'references:' || l_partkey || '>' || l_suppkey, 'function:' || l_partkey, 'references', 'module:' || l_suppkey FROM ({REFERS}) AS r
"""

_PRECISION = "CASE l_returnflag WHEN 'A' THEN 'compiler' WHEN 'R' THEN 'static_analysis' ELSE 'syntax' END"
EVIDENCE = f"""
SELECT 'c' || l_orderkey || '.' || l_linenumber AS id, 'orders-' || year(o_orderdate) AS unit_id, 'calls:' || l_orderkey || '>' || l_partkey AS relation_id, {_PRECISION} AS precision_name, 'file:c' || o_custkey AS file_id, CAST(o_orderkey * 64 + l_linenumber * 4 AS BIGINT) AS start_byte, CAST(o_orderkey * 64 + l_linenumber * 4 + 3 AS BIGINT) AS end_byte FROM lineitem JOIN orders ON o_orderkey = l_orderkey
UNION ALL SELECT 'r' || l_orderkey || '.' || l_linenumber, 'parts', 'references:' || l_partkey || '>' || l_suppkey, {_PRECISION}, 'file:p' || l_partkey, CAST(l_linenumber * 10 AS BIGINT), CAST(l_linenumber * 10 + 9 AS BIGINT) FROM lineitem
"""

#: Generation 2 is pinned; the units of two years are carried from generation 1, and those of another are gone.
GENERATION_UNITS = """
SELECT 2 AS generation_id, unit_id, unit_id IN ('orders-1996', 'orders-1997') AS carried, CASE WHEN unit_id IN ('orders-1996', 'orders-1997') THEN 1 ELSE 0 END AS distance_generations
FROM (SELECT DISTINCT 'orders-' || year(o_orderdate) AS unit_id FROM orders UNION ALL SELECT 'geo' UNION ALL SELECT 'suppliers' UNION ALL SELECT 'customers' UNION ALL SELECT 'parts' UNION ALL SELECT DISTINCT lang FROM documents) AS u WHERE unit_id <> 'orders-1995'
UNION ALL SELECT 1, unit_id, false, 0 FROM (SELECT DISTINCT 'orders-' || year(o_orderdate) AS unit_id FROM orders UNION ALL SELECT 'geo' UNION ALL SELECT 'suppliers' UNION ALL SELECT 'customers' UNION ALL SELECT DISTINCT lang FROM documents WHERE lang <> 'fr') AS u
"""

DOCS = "SELECT doc_id, 'doc:' || doc_id AS node_id, lang AS unit_id, lang || '/' || source || '/' || doc_id AS path, lang AS language, source AS name, source || '.' || lang || '.' || doc_id AS qualified_name, text AS body, n_chars FROM documents"

#: Spans of runs, from events: a user is a run, an event a span, its parent the event before the last multiple of 4.
SPANS = """
SELECT user_id AS run_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS seq, event_type AS stage, ts, value FROM events
"""

#: Receipts: each turn of a conversation confirms a range of its session's characters; odd turns overlap the one before.
RECEIPTS = """
SELECT conv_id, turn, CAST(sum(coalesce(length(text), 0)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - coalesce(length(text), 0) - CASE WHEN turn % 2 = 1 THEN 5 ELSE 0 END + CASE WHEN turn % 3 = 2 THEN 40 ELSE 0 END AS BIGINT) AS start_byte,
CAST(sum(coalesce(length(text), 0)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + CASE WHEN turn % 3 = 2 THEN 40 ELSE 0 END AS BIGINT) AS end_byte, role FROM conversations
"""

PARTS = {"nodes": NODES, "relations": RELATIONS, "evidence": EVIDENCE, "generation_units": GENERATION_UNITS, "docs": DOCS, "spans": SPANS, "receipts": RECEIPTS}


def sql(text: str) -> str:
    """text with the fixture's tables it names defined before it, for DuckDB."""
    used = [n for n in PARTS if n in text]
    ctes = [f"{n} AS ({PARTS[n]})" for n in used]
    body = text.strip()
    for word in ("WITH RECURSIVE", "WITH"):
        if body.startswith(word):
            return f"{word} " + ",\n".join([*ctes, body[len(word) :].strip()])
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body


class Fixture:
    """The graph's tables as DataFrames over one folder of driver tables."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _built(self, name: str) -> DataFrame:
        text, used = PARTS[name], {}
        for t in TABLES:
            marked = reduce(lambda s, k: s.replace(f"{k} {t}", f"{k} {{{t}}}"), ("FROM", "JOIN"), text)
            if marked != text:
                text, used[t] = marked, self.table(t)
        return self.spark.sql(text, **used)

    def __getattr__(self, name: str) -> DataFrame:
        if name in PARTS:
            return self._built(name)
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)
