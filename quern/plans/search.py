"""Queries over documents and symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import search as op
from quern.plans.catalog import query
from quern.plans.fixture import Fixture

_TOKENS = r"""
t AS (SELECT doc_id, node_id, path, name, qualified_name, regexp_extract_all(lower(strip_accents(coalesce(body, ''))), '[\p{L}\p{N}]+') AS tb, regexp_extract_all(lower(strip_accents(name)), '[\p{L}\p{N}]+') AS tn, regexp_extract_all(lower(strip_accents(path)), '[\p{L}\p{N}]+') AS tp, regexp_extract_all(lower(strip_accents(qualified_name)), '[\p{L}\p{N}]+') AS tq FROM docs),
c AS (SELECT *, len(tb) + len(tn) + len(tp) + len(tq) AS dl FROM t)"""


def _bm25(units: list[str]) -> str:
    names = "[" + ", ".join(f"'{u}'" for u in units) + "]"
    return f"""{_TOKENS},
u AS (SELECT unnest({names}) AS term, unnest(range({len(units)})) AS unit),
h AS (SELECT doc_id, unit, dl, len(list_filter(tb, lambda x: x = term)) AS b, len(list_filter(tn, lambda x: x = term)) AS n, len(list_filter(tp, lambda x: x = term)) AS p, len(list_filter(tq, lambda x: x = term)) AS q FROM c, u),
f AS (SELECT *, 1.0::DOUBLE * b + 5 * n + 2 * p + 5 * q AS w FROM h WHERE b + n + p + q > 0),
k AS (SELECT count(*) AS nd, sum(dl) / count(*) AS avgdl FROM c), d AS (SELECT unit, count(*) AS df FROM f GROUP BY unit),
s AS (SELECT doc_id, round(1000000 * sum(ln(1 + (nd - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (w * 2.2::DOUBLE / (w + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)))))::BIGINT AS score_micros, sum(b + n + p + q)::BIGINT AS occurrences FROM f JOIN d USING (unit), k GROUP BY doc_id)"""


@query(f"WITH {_bm25(['the', 'worthless', 'src8'])} SELECT doc_id, score_micros, occurrences FROM s")
def bm25_docs(x: Fixture) -> DataFrame:
    return op.bm25(x.docs, op.parse("the worthless SRC8 the")).select("doc_id", "score_micros", F.col("occurrences").cast("long"))


@query(f"""WITH {_TOKENS} SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(tb || tn || tp || tq) AS term FROM c) GROUP BY term""")
def doc_frequency(x: Fixture) -> DataFrame:
    p = op.postings(x.docs)
    return p.groupBy("term").agg(F.countDistinct("doc_id").alias("df"))


@query(f"WITH {_TOKENS} SELECT count(*) AS n_docs, sum(dl)::BIGINT AS n_tokens, max(dl)::BIGINT AS longest FROM c")
def corpus_stats(x: Fixture) -> DataFrame:
    return op.with_tokens(x.docs).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("token_count").alias("n_tokens"), F.max("token_count").alias("longest"))


@query(f"WITH {_TOKENS}, a AS (SELECT doc_id, 'body' AS col, unnest(tb) AS term FROM c UNION ALL SELECT doc_id, 'name', unnest(tn) FROM c UNION ALL SELECT doc_id, 'path', unnest(tp) FROM c UNION ALL SELECT doc_id, 'qualified_name', unnest(tq) FROM c) SELECT term, col, count(*) AS tf, count(DISTINCT doc_id) AS docs_with FROM a GROUP BY term, col")
def term_frequency(x: Fixture) -> DataFrame:
    return op.postings(x.docs).groupBy("term", "col").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("docs_with"))


@query(f"WITH {_TOKENS} SELECT doc_id, n FROM (SELECT doc_id, len(list_filter(range(1, len(tb)), lambda i: tb[i] = 'of' AND tb[i + 1] = 'the')) AS n FROM c) WHERE n > 0")
def phrase_tf(x: Fixture) -> DataFrame:
    return op.hits(x.docs, op.parse('"of the"')).where("tf_body > 0").select("doc_id", F.col("tf_body").cast("long").alias("n"))


@query(f"""WITH {_bm25(['src8', 'en', '28'])},
e AS (SELECT node_id, path, CASE WHEN path = 'src8.en.28' THEN 0 WHEN qualified_name = 'src8.en.28' THEN 1 WHEN starts_with(qualified_name, 'src8.en.28') THEN 2 WHEN name = 'src8.en.28' THEN 3 END AS tier, 0::BIGINT AS score_micros, 0::BIGINT AS occurrences FROM docs),
a AS (SELECT node_id, path, tier, score_micros, occurrences FROM e WHERE tier IS NOT NULL UNION ALL SELECT c.node_id, c.path, 4, score_micros, occurrences FROM s JOIN c USING (doc_id))
SELECT node_id, min(tier)::INT AS tier, max(score_micros) AS score_micros, sum(occurrences)::BIGINT AS occurrences, min(path) AS path FROM a GROUP BY node_id ORDER BY tier, score_micros DESC, path, node_id LIMIT 200""")
def five_tier_search(x: Fixture) -> DataFrame:
    return op.search(x.docs, "src8.en.28")


@query("""SELECT node_id, name, qualified_name, CASE WHEN qualified_name = 'Brand#1' THEN 1 WHEN starts_with(qualified_name, 'Brand#1') THEN 2 WHEN name = 'Brand#1' THEN 3 END::INT AS tier FROM nodes
WHERE starts_with(qualified_name, 'Brand#1') OR name = 'Brand#1' ORDER BY tier, node_id LIMIT 200""")
def symbol_tiers(x: Fixture) -> DataFrame:
    return op.resolve(x.nodes, "Brand#1").select("node_id", "name", "qualified_name", "tier")


@query("SELECT node_id, kind, name, start_byte, end_byte FROM nodes WHERE file_id = 'file:c7' ORDER BY start_byte, node_id")
def document_symbols(x: Fixture) -> DataFrame:
    return x.nodes.where("file_id = 'file:c7'").select("node_id", "kind", "name", "start_byte", "end_byte").orderBy("start_byte", "node_id")


@query("""WITH d AS (SELECT doc_id, coalesce(body, '') AS body, substr(coalesce(body, ''), 1, 500) AS head FROM docs)
SELECT doc_id, len(string_split(body, chr(10)))::BIGINT AS line_count, (length(head) - length(string_split(head, chr(10))[-1]))::BIGINT AS line_start, len(string_split(head, chr(10)))::BIGINT AS line_at_500 FROM d""")
def line_lookup(x: Fixture) -> DataFrame:
    """Lines of each document, and the line that character 500 is on (the nearest line start at or before it). A null or
    empty document has one empty line; in a shorter one its end stands for character 500."""
    d = x.docs.select("doc_id", F.coalesce("body", F.lit("")).alias("body"))
    head = F.substring("body", 1, 500)
    before = F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))
    start = F.when(before > 0, F.length(head) - F.length(F.substring_index(head, "\n", -1))).otherwise(0)
    return d.select("doc_id", (F.size(F.split("body", "\n", -1))).cast("long").alias("line_count"), start.cast("long").alias("line_start"), (before + 1).cast("long").alias("line_at_500"))
