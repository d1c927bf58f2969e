"""Program analysis of one function at a time: control-flow graphs, dominators, control dependence, def-use pairs."""

from __future__ import annotations

import ast
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Flow:
    """A function's control-flow graph over nodes 0..n-1: 0 is the entry, 1 the exit."""

    def __init__(self, edges: Iterable[tuple[int, int]], n: int | None = None) -> None:
        pairs = sorted(set(edges))
        self.n = max([1, *(max(p) for p in pairs)]) + 1 if n is None else n
        self.out: list[list[int]] = [[] for _ in range(self.n)]
        self.into: list[list[int]] = [[] for _ in range(self.n)]
        for a, b in pairs:
            self.out[a].append(b)
            self.into[b].append(a)

    def order(self, root: int, out: list[list[int]]) -> list[int]:
        """Reverse post-order from root."""
        seen, done, stack = {root}, [], [(root, iter(out[root]))]
        while stack:
            at, rest = stack[-1]
            nxt = next((b for b in rest if b not in seen), None)
            if nxt is None:
                done.append(at)
                stack.pop()
            else:
                seen.add(nxt)
                stack.append((nxt, iter(out[nxt])))
        return done[::-1]

    def _dominators(self, root: int, out: list[list[int]], into: list[list[int]]) -> list[int]:
        rank = {v: i for i, v in enumerate(self.order(root, out))}
        idom = [-1] * len(out)
        idom[root] = root
        changed = True
        while changed:
            changed = False
            for v in rank:
                if v == root:
                    continue
                new = -1
                for p in into[v]:
                    if p in rank and idom[p] >= 0:
                        a, b = new, p
                        while a >= 0 and a != b:
                            if rank[a] > rank[b]:
                                a = idom[a]
                            else:
                                b = idom[b]
                        new = b
                if new != idom[v]:
                    idom[v], changed = new, True
        idom[root] = -1
        return idom

    def dominators(self) -> list[int]:
        """Each node's immediate dominator; -1 for the entry and what it doesn't reach."""
        return self._dominators(0, self.out, self.into)

    def with_exits(self) -> Flow:
        """The graph with an edge to the exit from every dead end, and from the first node of each loop without a way out."""
        edges = [(a, b) for a in range(self.n) for b in self.out[a]]
        order = self.order(0, self.out)
        edges += [(v, 1) for v in order if not self.out[v] and v != 1]
        while True:
            g = Flow(edges, self.n)
            back = set(g.order(1, g.into))
            stuck = next((v for v in order if v not in back), None)
            if stuck is None:
                return g
            edges.append((stuck, 1))

    def post_dominators(self) -> list[int]:
        g = self.with_exits()
        return g._dominators(1, g.into, g.out)

    def control_dependence(self) -> list[tuple[int, int]]:
        """(node, branch): the node runs or not as the branch decides."""
        g, found = self.with_exits(), set()
        ipdom = self.post_dominators()
        for a in self.order(0, g.out):
            if len(g.out[a]) > 1:
                for b in g.out[a]:
                    while b >= 0 and b != ipdom[a]:
                        found.add((b, a))
                        b = ipdom[b]
        return sorted(found)

    def def_use(self, defs: dict[int, list[str]], uses: dict[int, list[str]]) -> list[tuple[str, int, int]]:
        """(variable, definition, use): definitions that may reach a use."""
        live: list[set[tuple[str, int]]] = [set() for _ in range(self.n)]
        todo = self.order(0, self.out)
        queued = set(todo)
        while todo:
            v = todo.pop(0)
            queued.discard(v)
            own = set(defs.get(v, ()))
            after = {d for d in live[v] if d[0] not in own} | {(x, v) for x in own}
            for b in self.out[v]:
                if not after <= live[b]:
                    live[b] |= after
                    if b not in queued:
                        todo.append(b)
                        queued.add(b)
        return sorted((x, d, v) for v in range(self.n) for x in set(uses.get(v, ())) for y, d in live[v] if y == x)


class Lowering(ast.NodeVisitor):
    """A Python function's statements as a graph, with what each defines and uses."""

    def __init__(self, function: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        self.edges: list[tuple[int, int]] = []
        self.defs: dict[int, list[str]] = defaultdict(list)
        self.uses: dict[int, list[str]] = defaultdict(list)
        self.line: dict[int, int] = {0: function.lineno}
        self.count, self.loops, self.finals = 2, [], []
        a = function.args
        self.defs[0] = [p.arg for p in [*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg))]]
        for v in self._body(function.body, [0]):
            self.edges.append((v, 1))

    def _node(self, at: ast.AST, parts: list[ast.AST], ins: list[int]) -> int:
        v, self.count = self.count, self.count + 1
        self.line[v] = at.lineno
        for part in parts:
            for x in ast.walk(part):
                if isinstance(x, ast.Name):
                    (self.uses if isinstance(x.ctx, ast.Load) else self.defs)[v].append(x.id)
                elif isinstance(x, ast.ExceptHandler) and x.name:
                    self.defs[v].append(x.name)
        if isinstance(at, ast.AugAssign) and isinstance(at.target, ast.Name):
            self.uses[v].append(at.target.id)
        self.edges += [(i, v) for i in ins]
        return v

    def _body(self, body: list[ast.stmt], ins: list[int]) -> list[int]:
        for s in body:
            if not ins:  # what nothing reaches has no edges in
                ins = []
            ins = self._statement(s, ins)
        return ins

    def _statement(self, s: ast.stmt, ins: list[int]) -> list[int]:
        if isinstance(s, ast.If):
            v = self._node(s, [s.test], ins)
            return self._body(s.body, [v]) + (self._body(s.orelse, [v]) if s.orelse else [v])
        if isinstance(s, (ast.While, ast.For, ast.AsyncFor)):
            v = self._node(s, [s.test] if isinstance(s, ast.While) else [s.target, s.iter], ins)
            self.loops.append((v, []))
            for e in self._body(s.body, [v]):
                self.edges.append((e, v))
            _, breaks = self.loops.pop()
            forever = isinstance(s, ast.While) and isinstance(s.test, ast.Constant) and bool(s.test.value)
            after = [] if forever else [v]
            return (self._body(s.orelse, after) if s.orelse else after) + breaks
        if isinstance(s, (ast.With, ast.AsyncWith)):
            return self._body(s.body, [self._node(s, list(s.items), ins)])
        if isinstance(s, ast.Try):
            first = self.count
            ends = self._body(s.body, ins)
            inside = list(range(first, self.count)) or ins
            for h in s.handlers:
                v = self._node(h, [x for x in (h.type,) if x], inside)
                if h.name:
                    self.defs[v].append(h.name)
                ends = ends + self._body(h.body, [v])
            if s.orelse:
                ends = self._body(s.orelse, ends)
            return self._body(s.finalbody, ends) if s.finalbody else ends
        if isinstance(s, ast.Match):
            v = self._node(s, [s.subject], ins)
            ends = [v]
            for case in s.cases:
                ends += self._body(case.body, [v])
            return ends
        if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            v = self._node(s, list(s.decorator_list), ins)
            self.defs[v].append(s.name)
            return [v]
        v = self._node(s, [s], ins)
        if isinstance(s, (ast.Return, ast.Raise)):
            self.edges.append((v, 1))
            return []
        if isinstance(s, ast.Break) and self.loops:
            self.loops[-1][1].append(v)
            return []
        if isinstance(s, ast.Continue) and self.loops:
            self.edges.append((v, self.loops[-1][0]))
            return []
        return [v]

    def flow(self) -> Flow:
        return Flow(self.edges, self.count)


def _per_function(rows: DataFrame, lists: dict[str, Column], find: Callable[..., list[tuple]], schema: str) -> DataFrame:
    """find's rows for each function, given its lists: a function is a row, so a batch holds many of them."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by work, which is larger than the rows' size tells
    per = rows.repartition(parts, "function").groupBy("function").agg(*(F.collect_list(c).alias(k) for k, c in lists.items()))
    flat = per.select("function", *(F.col(f"{k}.{f}").alias(f"{k}_{f}") for k in lists for f in per.schema[k].dataType.elementType.names))

    def make(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            columns = [[v.tolist() for v in pdf[c]] for c in pdf.columns[1:]]
            found = [(f, *r) for f, *own in zip(pdf["function"], *columns) for r in find(*own)]
            yield pd.DataFrame(found, columns=names).astype({n: object for n in names if n in ("function", "variable")})

    names = [field.split()[0] for field in schema.split(", ")]
    return flat.mapInPandas(make, schema)


def dominators(edges: DataFrame) -> DataFrame:
    """(function, node, idom, ipdom) of edges (function, a, b)."""

    def find(a: list[int], b: list[int]) -> list[tuple]:
        g = Flow(zip(a, b))
        return list(zip(range(g.n), g.dominators(), g.post_dominators()))

    return _per_function(edges, {"edge": F.struct("a", "b")}, find, "function string, node int, idom int, ipdom int")


def control_dependence(edges: DataFrame) -> DataFrame:
    """(function, node, branch) of edges (function, a, b)."""

    def find(a: list[int], b: list[int]) -> list[tuple]:
        return Flow(zip(a, b)).control_dependence()

    return _per_function(edges, {"edge": F.struct("a", "b")}, find, "function string, node int, branch int")


def def_use(edges: DataFrame, accesses: DataFrame) -> DataFrame:
    """(function, variable, definition, use) of edges and accesses (function, node, variable, is_def)."""
    both = edges.select("function", "a", "b", F.lit(None).cast("string").alias("variable"), F.lit(None).cast("boolean").alias("is_def")).unionByName(accesses.select("function", F.col("node").alias("a"), F.lit(None).cast("int").alias("b"), "variable", "is_def"))
    access, is_def = F.struct("a", "variable"), F.coalesce("is_def", F.lit(False))
    lists = {"edge": F.when(F.col("b").isNotNull(), F.struct("a", "b")), "def": F.when(F.col("b").isNull() & is_def, access), "use": F.when(F.col("b").isNull() & ~is_def, access)}

    def find(a: list[int], b: list[int], *of: list) -> list[tuple]:
        by: tuple[dict, dict] = (defaultdict(list), defaultdict(list))
        for names, at, variables in zip(by, of[::2], of[1::2]):
            for node, name in zip(at, variables):
                names[node].append(name)
        n = max([1, *a, *b, *of[0], *of[2]]) + 1
        return Flow(zip(a, b), n).def_use(*by)

    return _per_function(both, lists, find, "function string, variable string, definition int, use int")
