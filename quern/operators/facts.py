"""Relational operators over facts: visibility, precedence, joins by identity, evidence, containers, diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.model import CONTAINER_KINDS, PRECISION_WEIGHT, case_map


def members(generation_units: DataFrame, generation: int) -> DataFrame:
    """The units of one generation. One row a unit: its size follows the number of units, not of facts."""
    return generation_units.where(F.col("generation_id") == generation).select("unit_id")


def visible(facts: DataFrame, generation_units: DataFrame, generation: int) -> DataFrame:
    """Facts whose unit belongs to the pinned generation."""
    return facts.join(members(generation_units, generation), "unit_id", "left_semi")


def prefer(facts: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first by a total order. A partial aggregate, so hot keys shrink before the shuffle."""
    rank = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)))
    row = F.struct(*(F.col(c) for c in facts.columns))
    return facts.groupBy(*keys).agg(F.min_by(row, rank).alias("_row")).select("_row.*")


def prefix(column: str, value: str) -> Column:
    """column starts with value; pushed down to the scan as such."""
    return F.col(column).startswith(value)


def in_kinds(column: str, kinds: list[str]) -> Column:
    """An empty list means every kind."""
    return F.col(column).isin(*kinds) if kinds else F.lit(True)


def under_paths(column: str, paths: list[str]) -> Column:
    """The path itself or below it, for any of the paths; no path means every path."""
    out = F.lit(not paths)
    for p in paths:
        out = out | (F.col(column) == p) | F.col(column).startswith(p.rstrip("/") + "/")
    return out


def declarations(nodes: DataFrame) -> DataFrame:
    return nodes.where("file_id IS NOT NULL AND start_byte IS NOT NULL AND end_byte IS NOT NULL")


def touching(relations: DataFrame, nodes: DataFrame, key: str = "node_id") -> DataFrame:
    """Relations with either end among nodes: two equi-joins, for a disjunction would be a nested loop."""
    ends = nodes.select(F.col(key).alias("_n")).distinct()
    out = relations.join(ends, relations.from_node_id == ends._n, "left_semi")
    into = relations.join(ends, relations.to_node_id == ends._n, "left_semi")
    return out.union(into).distinct()


def adjacency(relations: DataFrame, direction: str = "both") -> DataFrame:
    """(node, neighbour, relation_id, kind, incoming): edges as seen from a node."""
    out = relations.select(F.col("from_node_id").alias("node"), F.col("to_node_id").alias("neighbour"), "relation_id", "kind", F.lit(False).alias("incoming"))
    into = relations.select(F.col("to_node_id").alias("node"), F.col("from_node_id").alias("neighbour"), "relation_id", "kind", F.lit(True).alias("incoming"))
    return {"outgoing": out, "incoming": into, "both": out.unionByName(into)}[direction]


def evidence_counts(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("relation_id").agg(F.least(F.count(F.lit(1)), F.lit(2**32 - 1)).alias("evidence_count"))


def first_evidence(evidence: DataFrame, per_relation: int) -> DataFrame:
    """At most per_relation pieces of evidence a relation, by id; Spark limits groups before the shuffle's sort."""
    w = Window.partitionBy("relation_id").orderBy("id")
    return evidence.withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_relation)


def trust(precision: Column) -> Column:
    return case_map(precision, PRECISION_WEIGHT, PRECISION_WEIGHT["heuristic"])


def containers(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """(node_id, container_id): a container holds itself; else the least package or module that claims a node by
    contains; else the least one in the node's file. Nodes without any are left out."""
    holders = nodes.where(F.col("kind").isin(*CONTAINER_KINDS)).select(F.col("node_id").alias("container_id"), "file_id")
    claims = relations.where("kind = 'contains'").join(holders, relations.from_node_id == holders.container_id).groupBy(F.col("to_node_id").alias("node_id")).agg(F.min("container_id").alias("claim"))
    owners = holders.where("file_id IS NOT NULL").groupBy("file_id").agg(F.min("container_id").alias("owner"))
    own = F.when(F.col("kind").isin(*CONTAINER_KINDS), F.col("node_id"))
    found = nodes.join(claims, "node_id", "left").join(owners, "file_id", "left")
    return found.select("node_id", F.coalesce(own, "claim", "owner").alias("container_id")).where("container_id IS NOT NULL")


def inherited_containers(nodes: DataFrame, relations: DataFrame, levels: int = 2) -> DataFrame:
    """containers(), and for nodes without one that of the node that defines them, level by level."""
    known = containers(nodes, relations)
    owned = relations.where("kind = 'defines'").select(F.col("to_node_id").alias("node_id"), F.col("from_node_id").alias("container_of"))
    for _ in range(levels - 1):
        up = owned.join(known.withColumnRenamed("node_id", "container_of"), "container_of").groupBy("node_id").agg(F.min("container_id").alias("container_id"))
        known = known.unionByName(up.join(known, "node_id", "left_anti"))
    return known


def rollup(edges: DataFrame, held: DataFrame) -> DataFrame:
    """Edges between containers: (from_container, to_container, pair_count, evidence_count), without those within one."""
    a = held.select(F.col("node_id").alias("from_node_id"), F.col("container_id").alias("from_container"))
    b = held.select(F.col("node_id").alias("to_node_id"), F.col("container_id").alias("to_container"))
    return (
        edges.join(a, "from_node_id")
        .join(b, "to_node_id")
        .where("from_container <> to_container")
        .groupBy("from_container", "to_container")
        .agg(F.count(F.lit(1)).alias("pair_count"), F.sum("evidence_count").cast("long").alias("evidence_count"))
    )


def direct_contents(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """Per parent, its direct children by contains or defines."""
    children = relations.where(F.col("kind").isin("contains", "defines")).join(nodes.select(F.col("node_id").alias("to_node_id"), F.col("kind").alias("child_kind"), "start_byte", "end_byte"), "to_node_id")
    symbol = F.col("child_kind").isin("method", "function", "class")
    return children.groupBy(F.col("from_node_id").alias("parent")).agg(
        F.count_if(F.col("child_kind") == "package").alias("packages"),
        F.count_if(symbol).alias("symbols"),
        F.sum(F.when(symbol, F.coalesce(F.col("end_byte") - F.col("start_byte"), F.lit(0))).otherwise(0)).cast("long").alias("symbol_bytes"),
    )


def key_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change): added, removed or changed."""
    b = before.select(F.col(key), F.col(value).alias("_b"), F.lit(True).alias("_in_b"))
    a = after.select(F.col(key), F.col(value).alias("_a"), F.lit(True).alias("_in_a"))
    change = F.when(F.col("_in_b").isNull(), "added").when(F.col("_in_a").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return b.join(a, key, "full").select(key, change.alias("change")).where("change IS NOT NULL")


def resolve_aliases(candidates: DataFrame, aliases: DataFrame) -> DataFrame:
    """Candidates (id, scope_key, strong_key, native_key) by aliases (scope_key, native_key, canonical_key, node_id).

    The strong key decides where it is known, else the native key; the least canonical key wins, the others are kept as
    ambiguous; a candidate without any is minted from its own keys.
    """
    best = aliases.groupBy("scope_key", "native_key").agg(F.min(F.struct("canonical_key", "node_id")).alias("best"), F.array_sort(F.collect_set("canonical_key")).alias("all_keys"))
    strong = best.select("scope_key", F.col("native_key").alias("strong_key"), F.col("best").alias("sb"), F.col("all_keys").alias("sk"))
    weak = best.select("scope_key", "native_key", F.col("best").alias("wb"), F.col("all_keys").alias("wk"))
    found = candidates.join(strong, ["scope_key", "strong_key"], "left").join(weak, ["scope_key", "native_key"], "left")
    minted = F.concat_ws("#", "scope_key", F.coalesce("strong_key", "native_key"))
    chosen = F.coalesce("sb.canonical_key", "wb.canonical_key", minted)
    return found.select(
        "id",
        chosen.alias("canonical_key"),
        F.coalesce("sb.node_id", "wb.node_id").alias("node_id"),
        (F.size(F.coalesce("sk", "wk", F.array().cast("array<string>"))) > 1).alias("ambiguous"),
    )
