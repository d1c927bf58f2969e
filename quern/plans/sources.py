"""Queries over files, snapshots, blobs and generations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.operators import snapshots as op
from quern.plans.catalog import query
from quern.plans.fixture import Fixture
from quern.sources import files
from quern.sources.classify import classify


def _index(x: Fixture) -> DataFrame:
    return x.docs.where("doc_id % 7 <> 0").select("path", F.sha2("body", 256).alias("content_hash"))


def _walked(x: Fixture) -> DataFrame:
    changed = F.when(F.expr("doc_id % 5 = 0"), F.concat("body", F.lit("!"))).otherwise(F.col("body"))
    return x.docs.where("doc_id % 11 <> 0").select("path", F.sha2(changed, 256).alias("content_hash"), (F.col("doc_id") % 2 == 0).alias("staged"))


_CAPTURE = """i AS (SELECT path, sha256(body) AS a FROM docs WHERE doc_id % 7 <> 0), w AS (SELECT path, sha256(CASE WHEN doc_id % 5 = 0 THEN body || '!' ELSE body END) AS b, doc_id % 2 = 0 AS staged FROM docs WHERE doc_id % 11 <> 0),
cap AS (SELECT path, CASE WHEN b IS NULL THEN 'deleted' WHEN a IS NULL THEN CASE WHEN staged THEN 'added' ELSE 'untracked' END WHEN a = b THEN 'tracked' ELSE 'modified' END AS status, coalesce(b, a) AS content_hash FROM i FULL JOIN w USING (path))"""


@query(f"WITH {_CAPTURE} SELECT path, status, content_hash FROM cap")
def snapshot_capture(x: Fixture) -> DataFrame:
    return op.capture(_index(x), _walked(x))


@query(f"WITH {_CAPTURE} SELECT status, count(*) AS n, min(path) AS first_path FROM cap WHERE status IN ('modified', 'added') GROUP BY status")
def changed_files(x: Fixture) -> DataFrame:
    found = op.capture(_index(x), _walked(x)).where(F.col("status").isin("modified", "added"))
    return found.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path"))


@query("SELECT path FROM docs WHERE doc_id % 7 <> 0 AND path NOT IN (SELECT path FROM docs WHERE doc_id % 11 <> 0)")
def manifest_unseen(x: Fixture) -> DataFrame:
    return _index(x).join(_walked(x), "path", "left_anti").select("path")


@query("SELECT sha256(body) AS hash, min(strlen(body))::BIGINT AS size_bytes, count(*) AS refs FROM docs GROUP BY 1")
def blob_store(x: Fixture) -> DataFrame:
    return op.blobs(x.docs, "body").drop("content")


@query("SELECT hash, size_bytes FROM (SELECT sha256(body) AS hash, min(strlen(body))::BIGINT AS size_bytes FROM docs GROUP BY 1) WHERE hash NOT IN (SELECT sha256(body) FROM docs WHERE doc_id % 3 = 0)")
def gc_unreferenced(x: Fixture) -> DataFrame:
    used = x.docs.where("doc_id % 3 = 0").select(F.sha2("body", 256).alias("hash"))
    return op.unreferenced(op.blobs(x.docs, "body").select("hash", "size_bytes"), used)


@query("SELECT doc_id, substr(body, 11, 20) AS part, strlen(body)::BIGINT AS size_bytes FROM docs WHERE language = 'en' AND starts_with(path, 'en/src1/')")
def snapshot_view(x: Fixture) -> DataFrame:
    return x.docs.where(F.col("language").isin("en") & F.col("path").startswith("en/src1/")).select("doc_id", F.substring("body", 11, 20).alias("part"), F.octet_length("body").cast("long").alias("size_bytes"))


@query("SELECT doc_id, sha256(body) AS digest, len(string_split(body, chr(10)))::BIGINT AS line_count, array_to_string(list_transform(range(0, greatest(1, (strlen(body) + 4095) // 4096)), lambda i: sha256(encode(body)[i * 4096 + 1 : (i + 1) * 4096])), ',') AS blocks FROM docs")
def line_index(x: Fixture) -> DataFrame:
    body = F.encode("body", "UTF-8")
    return x.docs.select("doc_id", F.sha2("body", 256).alias("digest"), F.size(F.split("body", "\n", -1)).cast("long").alias("line_count"), F.array_join(op.blocks(body, 4096), ",").alias("blocks"))


@query("""WITH f AS (SELECT language || '/' || name || '/' || doc_id AS path, language, name FROM docs),
n AS (SELECT path, 'file' AS kind, 2 AS depth FROM f UNION ALL SELECT DISTINCT language || '/' || name, 'directory', 1 FROM f UNION ALL SELECT DISTINCT language, 'directory', 0 FROM f)
SELECT kind, count(*) AS n, count(*) FILTER (WHERE depth > 0) AS contained FROM n GROUP BY kind""")
def filesystem_nodes(x: Fixture) -> DataFrame:
    nodes, contains = files.tree(x.docs.select("path"))
    return nodes.join(contains.select(F.col("child").alias("path"), "parent"), "path", "left").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("parent").alias("contained"))


# Paths, and the format and kind that each must have.
_PATHS = [
    ("go.mod", "gomod", "file"), ("sub/Cargo.toml", "cargo", "file"), ("Dockerfile", "dockerfile", "build_target"), ("Dockerfile.dev", "dockerfile", "build_target"), ("x.dockerfile", "dockerfile", "build_target"),
    ("dockerfile", "", "file"), ("src/a.py", "", "file"), ("a.tsx", "", "file"), ("api/openapi.v3.yaml", "openapi", "document"), ("myopenapi.yaml", "", "file"), ("swagger.json", "openapi", "document"),
    ("compose.yaml", "compose", "configuration"), ("docker-compose.prod.yml", "compose", "configuration"), (".github/workflows/ci.yml", "github-actions", "configuration"), ("x/.github/workflows/ci.yml", "", "file"),
    (".circleci/config.yml", "circleci", "configuration"), (".travis.yml", "travis", "configuration"), ("Jenkinsfile", "jenkins", "configuration"), ("k/kustomization.yaml", "kustomize", "configuration"), ("Chart.yaml", "helm", "configuration"),
    ("build.gradle.kts", "gradle", "build_target"), ("BUILD.bazel", "bazel", "build_target"), ("rules.bzl", "bazel", "build_target"), ("CMakeLists.txt", "cmake", "build_target"), ("x.cmake", "cmake", "build_target"), ("GNUmakefile", "make", "build_target"),
    ("README", "text", "document"), ("Readme.md", "markdown", "document"), ("docs/ADR/0001.md", "adr", "document"), ("docs/adrs/x/y.markdown", "adr", "document"), ("adr.md", "markdown", "document"), ("LICENSE-MIT", "text", "document"),
    ("notes.txt", "text", "document"), ("m.proto", "protobuf", "document"), ("q.SQL", "sql", "document"), ("main.tf", "terraform", "configuration"), ("s.graphqls", "graphql", "document"), ("noext", "", "file"),
]


@query(f"""SELECT doc_id, ({[f for _, f, _ in _PATHS]})[doc_id % {len(_PATHS)} + 1] AS format, ({[k for _, _, k in _PATHS]})[doc_id % {len(_PATHS)} + 1] AS kind FROM docs""")
def path_classify(x: Fixture) -> DataFrame:
    form, kind = classify(F.col("p"))
    path = F.element_at(F.array(*(F.lit(p) for p, _, _ in _PATHS)), (F.col("doc_id") % len(_PATHS) + 1).cast("int"))
    return x.docs.select("doc_id", path.alias("p")).select("doc_id", form.alias("format"), kind.alias("kind"))


@query("""SELECT scope_key, CASE WHEN old_key = unit_key THEN 'reuse' WHEN old_key IS NOT NULL THEN 'delta' ELSE 'build' END AS action FROM (SELECT name AS scope_key, md5(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id)) AS unit_key FROM docs GROUP BY name)
LEFT JOIN (SELECT name AS scope_key, md5(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id)) AS old_key FROM docs WHERE name NOT IN ('src1', 'src2') AND NOT (name = 'src3' AND doc_id > 100) GROUP BY name) USING (scope_key)""")
def plan_reuse(x: Fixture) -> DataFrame:
    key = F.md5(F.array_join(F.array_sort(F.collect_list("doc_id")).cast("array<string>"), ",")).alias("unit_key")
    planned = x.docs.groupBy(F.col("name").alias("scope_key")).agg(key)
    sealed = x.docs.where("name NOT IN ('src1', 'src2') AND NOT (name = 'src3' AND doc_id > 100)").groupBy(F.col("name").alias("scope_key")).agg(key)
    return op.reusable(planned, sealed).select("scope_key", "action")


@query("SELECT relation_id, kind FROM relations SEMI JOIN (SELECT relation_id FROM evidence ANTI JOIN (SELECT id FROM evidence WHERE precision_name = 'syntax') USING (id) UNION ALL SELECT relation_id FROM evidence WHERE precision_name = 'syntax' AND end_byte > 30) USING (relation_id)")
def carry_over(x: Fixture) -> DataFrame:
    """Old evidence of one precision is replaced by fresh evidence; relations without any left go."""
    old = x.evidence
    stale = old.where("precision_name = 'syntax'").select("id")
    left = op.carry_over(old, stale, old.where("precision_name = 'syntax' AND end_byte > 30"), "id")
    return op.supported(x.relations, left).select("relation_id", "kind")


@query("""WITH c AS (SELECT unit_id AS scope_key, unit_id || '@2' AS u FROM generation_units WHERE generation_id = 2 AND NOT carried), p AS (SELECT unit_id AS scope_key, unit_id || '@1' AS u, 0 AS distance FROM generation_units WHERE generation_id = 1)
SELECT scope_key, coalesce(c.u, p.u) AS unit_id, c.u IS NULL AS carried, CASE WHEN c.u IS NULL THEN distance + 1 ELSE 0 END AS distance FROM (SELECT DISTINCT unit_id AS scope_key FROM generation_units) LEFT JOIN c USING (scope_key) LEFT JOIN p USING (scope_key) WHERE coalesce(c.u, p.u) IS NOT NULL""")
def stale_members(x: Fixture) -> DataFrame:
    g = x.generation_units
    current = g.where("generation_id = 2 AND NOT carried").select(F.col("unit_id").alias("scope_key"), F.concat("unit_id", F.lit("@2")).alias("unit_id"))
    previous = g.where("generation_id = 1").select(F.col("unit_id").alias("scope_key"), F.concat("unit_id", F.lit("@1")).alias("unit_id"), F.lit(0).alias("distance"))
    return op.members_with_fallback(g.select(F.col("unit_id").alias("scope_key")).distinct(), current, previous)


@query(r"SELECT doc_id, trim(regexp_replace(body, '\s+', ' ', 'g')) AS clean, string_split(path, '/')[-1] AS last, string_split(path, '/')[1] || '/' || string_split(path, '/')[2] AS parent FROM docs")
def text_projection(x: Fixture) -> DataFrame:
    return x.docs.select("doc_id", tx.collapse(F.col("body")).alias("clean"), tx.last_segment(F.col("path")).alias("last"), tx.parent_path(F.col("path")).alias("parent"))


@query()
def chunk_plan(x: Fixture) -> DataFrame:
    return files.chunks(x.docs.unionByName(x.docs.select(*(F.concat("body", F.lit("\n"), "body").alias(c) if c == "body" else F.col(c) for c in x.docs.columns))), "doc_id", "body")
