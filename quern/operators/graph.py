"""Graph operators: level-synchronous walks, impact, cheapest paths and their routes, closures, overviews.

Each level is one join of the frontier with the edges and one anti-join with what was visited; levels are written to the
shared folder, so plans stay short. Only frontiers move: the edge table is read, filtered by kind, and joined.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.model import MICROS, edge_cost
from quern.operators.facts import adjacency, in_kinds
from quern.scratch import cut


@dataclass
class Walk:
    """reached (node, depth, cost, via, owner): nodes in the order of their levels, seeds at depth 0.
    edges (relation_id, kind, owner, neighbour, incoming, depth, cost): every edge served."""

    reached: DataFrame
    edges: DataFrame


def walk(relations: DataFrame, seeds: DataFrame, kinds: list[str], direction: str, max_depth: int) -> Walk:
    """From seeds (node), breadth first.

    A newly reached node is admitted by its cheapest edge of that level (cost, then relation, then owner) and keeps that
    cost, even if a later level would be cheaper. In both directions a relation is served once: to a node not visited
    yet, or as its outgoing copy to a node of the same level.
    """
    edges = adjacency(relations.where(in_kinds("kind", kinds)), direction).withColumn("step", edge_cost(F.col("kind")))
    none = F.lit(None).cast("string")
    frontier = cut(seeds.select("node").distinct().select("node", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("cost"), none.alias("via"), none.alias("owner")))
    reached, served = frontier, None
    for depth in range(1, max_depth + 1):
        out = edges.join(frontier.select("node", "cost"), "node")
        out = out.select("relation_id", "kind", F.col("node").alias("owner"), "neighbour", "incoming", F.lit(depth).alias("depth"), (F.col("cost") + F.col("step")).alias("cost"))
        if direction == "both":
            seen = reached.select(F.col("node").alias("neighbour"), (F.col("depth") == depth - 1).alias("level"))
            out = out.join(seen, "neighbour", "left").where("level IS NULL OR (level AND NOT incoming)").drop("level")
        out = cut(out.select("relation_id", "kind", "owner", "neighbour", "incoming", "depth", "cost"))
        served = out if served is None else served.unionByName(out)
        new = out.join(reached.select(F.col("node").alias("neighbour")), "neighbour", "left_anti")
        best = new.groupBy("neighbour").agg(F.min(F.struct("cost", "relation_id", "owner")).alias("b"))
        frontier = cut(best.select(F.col("neighbour").alias("node"), F.lit(depth).alias("depth"), "b.cost", F.col("b.relation_id").alias("via"), "b.owner"))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    if served is None:
        served = edges.select("relation_id", "kind", F.col("node").alias("owner"), "neighbour", "incoming", F.lit(0).alias("depth"), F.col("step").cast("long").alias("cost")).limit(0)
    return Walk(reached, served)


def impact(relations: DataFrame, seeds: DataFrame, kinds: list[str], max_depth: int, most_reasons: int = 8) -> DataFrame:
    """Nodes that a change of the seeds may reach, folded over all edges that reach them and scored by their cheapest."""
    found = walk(relations, seeds, kinds, "both", max_depth).edges
    found = found.join(seeds.select(F.col("node").alias("neighbour")), "neighbour", "left_anti")
    folded = found.groupBy(F.col("neighbour").alias("node_id")).agg(
        F.min(F.struct("cost", "depth", "relation_id", "owner")).alias("b"), F.bool_or("incoming").alias("incoming"), F.slice(F.array_sort(F.collect_set(F.concat("kind", F.when(F.col("incoming"), F.lit("<")).otherwise(F.lit(">"))))), 1, most_reasons).alias("reasons")
    )
    score = F.expr(f"{MICROS} DIV (1 + b.cost)")
    return folded.select("node_id", score.alias("score_micros"), "b.cost", "b.depth", F.col("b.relation_id").alias("via"), "incoming", F.array_join("reasons", " ").alias("reasons"))


class Truncated(RuntimeError):
    """A bound that the caller asked for was reached before the search had ended."""


def _rounds(most: int | None, what: str) -> Iterator[int]:
    """1, 2, ... as long as the loop goes on; with a bound, an error if it goes on beyond that."""
    for n in itertools.count(1):
        if most is not None and n > most:
            raise Truncated(f"{what}: more than {most}")
        yield n


def distances(relations: DataFrame, source: DataFrame, kinds: list[str], direction: str = "outgoing", max_hops: int | None = None) -> DataFrame:
    """(node, dist, hops): the cheapest way from any source, and the fewest relations among the cheapest.

    Only nodes that got better in a round are relaxed in the next, until none did. A bound that cuts this short raises
    Truncated: a node that wasn't reached is never taken for one without a way.
    """
    edges = adjacency(relations.where(in_kinds("kind", kinds)), direction).select("node", "neighbour", edge_cost(F.col("kind")).alias("step"))
    settled = cut(source.select("node").distinct().select("node", F.lit(0).cast("long").alias("dist"), F.lit(0).alias("hops")))
    active = settled
    for _ in _rounds(None if max_hops is None else max_hops + 1, "hops"):
        out = edges.join(active, "node").groupBy(F.col("neighbour").alias("node")).agg(F.min(F.struct((F.col("dist") + F.col("step")).alias("dist"), (F.col("hops") + 1).alias("hops"))).alias("n"))
        old = settled.select("node", F.struct("dist", "hops").alias("o"))
        active = cut(out.join(old, "node", "left").where("o IS NULL OR n < o").select("node", "n.dist", "n.hops"))
        if active.isEmpty():
            break
        settled = cut(settled.join(active.select("node"), "node", "left_anti").unionByName(active))
    return settled


def routes(relations: DataFrame, source: DataFrame, target: str, kinds: list[str], most: int = 8, max_hops: int | None = None) -> DataFrame:
    """(route, cost): the cheapest routes to the target, as relation ids from the source, the first ``most`` in order.

    Routes grow from the target. Of those that come to the same node only the ``most`` least go on, for what is put
    before them is the same; so a grid of equal routes isn't listed.
    """
    least = Window.partitionBy("node").orderBy("route")
    dist = cut(distances(relations, source, kinds, "outgoing", max_hops))
    edges = relations.where(in_kinds("kind", kinds)).select("relation_id", F.col("from_node_id").alias("up"), F.col("to_node_id").alias("node"), edge_cost(F.col("kind")).alias("step"))
    up = dist.select(F.col("node").alias("up"), F.col("dist").alias("up_dist"))
    parents = edges.join(dist.select("node", "dist"), "node").join(up, "up").where("up_dist + step = dist").select("node", "up", "relation_id")
    goal = dist.where(F.col("node") == target)
    open_ = goal.select("node", F.array().cast("array<string>").alias("route"), F.col("dist").alias("cost"))
    starts, done = source.select("node").distinct(), None
    while True:  # a step back is a step nearer to the source
        ended = open_.join(starts, "node", "left_semi").select("route", "cost")
        done = ended if done is None else done.unionByName(ended)
        grown = open_.join(starts, "node", "left_anti").join(parents, "node").select(F.col("up").alias("node"), F.concat(F.array("relation_id"), "route").alias("route"), "cost")
        open_ = cut(grown.withColumn("n", F.row_number().over(least)).where(F.col("n") <= most).drop("n"))
        if open_.isEmpty():
            break
    return done.orderBy("route").limit(most)


def closure(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """All (a, b) with a way from a to b over edges (a, b), by semi-naive rounds: only new pairs are extended, until
    there are none. A bound that cuts this short raises Truncated."""
    known = new = cut(edges.select("a", "b").distinct())
    step = edges.select(F.col("a").alias("m"), F.col("b").alias("c")).distinct()
    for _ in _rounds(None if max_rounds is None else max_rounds + 1, "rounds"):
        more = new.join(step, new.b == step.m).select("a", F.col("c").alias("b")).distinct()
        new = cut(more.join(known, ["a", "b"], "left_anti"))
        if new.isEmpty():
            break
        known = known.unionByName(new)
    return known


def overview(nodes: DataFrame, relations: DataFrame, kinds: tuple[str, ...] = ("repository", "directory", "package", "module", "namespace")) -> DataFrame:
    """(node_id, kind, name, parent, depth, children): containers under their least claimant, roots at depth 0.

    Chains that never come to a root, as in a cycle, are left out.
    """
    held = nodes.where(F.col("kind").isin(*kinds)).select("node_id", "kind", "name")
    inner = held.select("node_id")
    claims = relations.where("kind = 'contains'").join(inner, F.col("from_node_id") == inner.node_id, "left_semi").groupBy(F.col("to_node_id").alias("node_id")).agg(F.min("from_node_id").alias("parent"))
    with_parent = cut(held.join(claims, "node_id", "left"))
    level = with_parent.where("parent IS NULL").select("node_id", F.lit(0).alias("depth"))
    depths = level = cut(level)
    for depth in itertools.count(1):
        level = cut(with_parent.join(level.select(F.col("node_id").alias("parent")), "parent").select("node_id", F.lit(depth).alias("depth")))
        if level.isEmpty():
            break
        depths = depths.unionByName(level)
    children = relations.where(F.col("kind").isin("contains", "defines")).groupBy(F.col("from_node_id").alias("node_id")).agg(F.count(F.lit(1)).alias("children"))
    return with_parent.join(depths, "node_id").join(children, "node_id", "left").select("node_id", "kind", "name", "parent", "depth", F.coalesce("children", F.lit(0)).alias("children"))


def occurrences(relations: DataFrame, evidence: DataFrame, nodes: DataFrame, kinds: list[str], direction: str) -> DataFrame:
    """One row a piece of evidence of the nodes' edges; relations without evidence have none."""
    end = "to_node_id" if direction == "incoming" else "from_node_id"
    edges = relations.where(in_kinds("kind", kinds)).join(nodes.select(F.col("node").alias(end)).distinct(), end, "left_semi")
    return edges.join(evidence.drop("unit_id"), "relation_id").select("relation_id", F.col("id").alias("evidence_id"), "kind", "from_node_id", "to_node_id", "file_id", "start_byte", "end_byte")
