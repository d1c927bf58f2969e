"""Walks, paths and roll-ups against plain Python over small graphs with cycles, ties and dead ends."""

import heapq
import random
from collections import defaultdict

import pytest

from quern.model import DEFAULT_KINDS, EDGE_COST
from quern.operators import facts, graph

KINDS = ["calls", "references", "contains", "reads"]


def made(seed, n=25, m=60):
    rng = random.Random(seed)
    pairs = {(rng.randrange(n), rng.choice(KINDS), rng.randrange(n)) for _ in range(m)}
    return [(f"r{i:03d}", f"n{a}", k, f"n{b}") for i, (a, k, b) in enumerate(sorted(pairs))]


def frame(spark, rows):
    return spark.createDataFrame([("u", *r) for r in rows], "unit_id string, relation_id string, from_node_id string, kind string, to_node_id string")


def plain_walk(rows, seeds, kinds, direction, depth):
    reached = dict.fromkeys(seeds, (0, 0))
    frontier, edges = set(seeds), set()
    for level in range(1, depth + 1):
        new = defaultdict(list)
        for r, a, k, b in rows:
            if k not in kinds:
                continue
            sides = [(a, b, False)] if direction in ("outgoing", "both") else []
            sides += [(b, a, True)] if direction in ("incoming", "both") else []
            for u, v, incoming in sides:
                if u not in frontier:
                    continue
                if direction == "both" and v in reached and (incoming or v not in frontier):
                    continue
                cost = reached[u][1] + EDGE_COST[k]
                edges.add((r, u, v, incoming, level, cost))
                if v not in reached:
                    new[v].append((cost, r, u))
        if not new:
            break
        frontier = set(new)
        for v, found in new.items():
            reached[v] = (level, min(found)[0])
    return reached, edges


@pytest.mark.parametrize("direction", ["outgoing", "incoming", "both"])
@pytest.mark.parametrize("seed", [1, 2])
def test_walk(spark, direction, seed):
    rows = made(seed)
    seeds = ["n0", "n7"]
    w = graph.walk(frame(spark, rows), spark.createDataFrame([(s,) for s in seeds], "node string"), KINDS, direction, 4)
    reached, edges = plain_walk(rows, seeds, KINDS, direction, 4)
    assert {r.node: (r.depth, r.cost) for r in w.reached.collect()} == reached
    assert {(r.relation_id, r.owner, r.neighbour, r.incoming, r.depth, r.cost) for r in w.edges.collect()} == edges


@pytest.mark.parametrize("seed", [3, 4])
def test_cheapest_paths_and_routes(spark, seed):
    rows = made(seed)
    out = defaultdict(list)
    for r, a, k, b in rows:
        out[a].append((EDGE_COST[k], b, r))
    dist, heap = {"n0": (0, 0)}, [(0, 0, "n0")]
    while heap:
        d, h, u = heapq.heappop(heap)
        if dist[u] < (d, h):
            continue
        for c, v, _ in out[u]:
            if (d + c, h + 1) < dist.get(v, (1 << 30, 0)):
                dist[v] = (d + c, h + 1)
                heapq.heappush(heap, (d + c, h + 1, v))
    source, relations = spark.createDataFrame([("n0",)], "node string"), frame(spark, rows)
    assert {r.node: (r.dist, r.hops) for r in graph.distances(relations, source, list(DEFAULT_KINDS)).collect()} == dist
    target = max((n for n in dist if n != "n0"), key=lambda n: dist[n])

    def ways(node, route):
        if node == target and dist[node][0] == dist[target][0]:
            yield route
        for c, v, r in out[node]:
            if v in dist and dist[node][0] + c == dist[v][0]:
                yield from ways(v, [*route, r])

    got = [r.route for r in graph.routes(relations, source, target, list(DEFAULT_KINDS), 4).collect()]
    assert got == sorted(ways("n0", []))[:4]


def test_walk_without_edges(spark):
    w = graph.walk(frame(spark, made(5)).limit(0), spark.createDataFrame([("n0",)], "node string"), KINDS, "both", 3)
    assert w.reached.count() == 1 and w.edges.count() == 0


def test_closure_of_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "a string, b string")
    assert {(r.a, r.b) for r in graph.closure(edges).collect()} == {(x, y) for x in "abc" for y in "abcd"}


def test_overview_leaves_cycles_out(spark):
    nodes = spark.createDataFrame([(n, "package", n) for n in ("p1", "p2", "p3", "p4")], "node_id string, kind string, name string")
    rel = frame(spark, [("r1", "p1", "contains", "p2"), ("r2", "p3", "contains", "p4"), ("r3", "p4", "contains", "p3")])
    assert {(r.node_id, r.parent, r.depth, r.children) for r in graph.overview(nodes, rel).collect()} == {("p1", None, 0, 1), ("p2", "p1", 1, 0)}


def test_container_precedence(spark):
    """The least package that claims a node holds it; a directory never does; a file's module does where none claims."""
    nodes = spark.createDataFrame([("a", "package", None), ("b", "package", None), ("d", "directory", None), ("m", "module", "f"), ("hub", "class", "f"), ("leaf", "class", "f"), ("lone", "class", None)], "node_id string, kind string, file_id string")
    rel = frame(spark, [("1", "b", "contains", "hub"), ("2", "a", "contains", "hub"), ("3", "d", "contains", "hub"), ("4", "d", "contains", "lone")])
    assert {(r.node_id, r.container_id) for r in facts.containers(nodes, rel).collect()} == {("a", "a"), ("b", "b"), ("m", "m"), ("hub", "a"), ("leaf", "m")}


def test_impact_excludes_seeds_and_keeps_incoming(spark):
    rel = frame(spark, [("1", "a", "calls", "s"), ("2", "s", "calls", "a"), ("3", "b", "calls", "a"), ("4", "a", "calls", "a")])
    got = {r.node_id: r for r in graph.impact(rel, spark.createDataFrame([("s",)], "node string"), ["calls"], 3).collect()}
    assert set(got) == {"a", "b"} and got["a"].incoming and got["a"].score_micros == 500_000 and got["b"].score_micros == 333_333


def test_long_ways_and_bounds(spark):
    """A bound that cuts a search short is told; without one, it goes on to the end."""
    chain = spark.createDataFrame([(f"r{i}", f"n{i:03d}", "calls", f"n{i + 1:03d}") for i in range(7)], "relation_id string, from_node_id string, kind string, to_node_id string")
    start = spark.createDataFrame([("n000",)], "node string")
    assert graph.distances(chain, start, ["calls"]).agg({"dist": "max"}).first()[0] == 7
    assert graph.distances(chain, start, ["calls"], max_hops=7).count() == 8
    with pytest.raises(graph.Truncated):
        graph.distances(chain, start, ["calls"], max_hops=6)
    with pytest.raises(graph.Truncated):
        graph.closure(chain.selectExpr("from_node_id AS a", "to_node_id AS b"), max_rounds=3)


def test_routes_of_a_grid(spark):
    """Of the many equal ways through a grid, the least are given without listing the others."""
    n = 9
    edges = [(f"{x}{y}{d}", f"{x}{y}", "calls", f"{x + (d == 'r')}{y + (d == 'd')}") for x in range(n) for y in range(n) for d in "dr" if x + (d == "r") < n and y + (d == "d") < n]
    rows = spark.createDataFrame(edges, "relation_id string, from_node_id string, kind string, to_node_id string")
    got = [r.route for r in graph.routes(rows, spark.createDataFrame([("00",)], "node string"), "44", ["calls"], 5).collect()]

    def ways(x, y):
        return [[]] if (x, y) == (4, 4) else [[f"{x}{y}d", *w] for w in (ways(x, y + 1) if y < 4 else [])] + [[f"{x}{y}r", *w] for w in (ways(x + 1, y) if x < 4 else [])]

    assert got == sorted(ways(0, 0))[:5]
