"""The flow queries against brute force over every order of a small table."""

import random

import pytest

from quern.plans import catalog

ORDERS = range(1, 24)


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    rng = random.Random(5)
    rows = [(o, k, rng.randrange(40), rng.randrange(9), rng.choice("ANR")) for o in ORDERS for k in range(1, rng.randrange(1, 8) + 1)]
    folder = str(tmp_path_factory.mktemp("flow"))
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string").write.parquet(f"{folder}/lineitem.parquet")
    return folder, rows


def graph(rows, order):
    own = {k: (part, flag) for o, k, part, _, flag in rows if o == order}
    last = max(own)
    to = lambda k: 1 if k > last else k + 1
    found = {(0, min(own) + 1)}
    for k, (part, flag) in own.items():
        found.add((k + 1, to(k + 1)))
        if flag == "R":
            found.add((k + 1, to(k + 2)))
        if part % 2:
            found.add((k + 1, k + 1))
    return found, last + 2


def reach(edges, root, without=None):
    seen, todo = set(), [root] if root != without else []
    while todo:
        v = todo.pop()
        if v not in seen:
            seen.add(v)
            todo += [b for a, b in edges if a == v and b != without]
    return seen


def dominating(edges, n, root):
    """Each reached node's dominators, itself among them: those without which nothing leads to it."""
    return {v: {d for d in range(n) if v not in reach(edges, root, d)} for v in reach(edges, root)}


def immediate(dom, v, root):
    return next((d for d in dom[v] - {v} if dom[v] - {v} <= dom[d]), -1) if v in dom and v != root else -1


def test_dominators(spark, lines):
    folder, rows = lines
    want = set()
    for o in ORDERS:
        e, n = graph(rows, o)
        dom, post = dominating(e, n, 0), dominating({(b, a) for a, b in e}, n, 1)
        want |= {(f"order{o}", v, immediate(dom, v, 0), immediate(post, v, 1)) for v in range(n)}
    got = [tuple(r) for r in catalog.queries()["flow_dominators"](spark, folder).collect()]
    assert len(got) == len(want) and set(got) == want


def test_control_dependence(spark, lines):
    folder, rows = lines
    want = set()
    for o in ORDERS:
        e, n = graph(rows, o)
        post = dominating({(b, a) for a, b in e}, n, 1)
        want |= {(f"order{o}", v, a) for a, s in e if len([b for x, b in e if x == a]) > 1 for v in post[s] if v not in post[a] - {a}}
    got = [tuple(r) for r in catalog.queries()["flow_control_dependence"](spark, folder).collect()]
    assert len(got) == len(want) and set(got) == want


def test_def_use(spark, lines):
    folder, rows = lines
    want = set()
    for o in ORDERS:
        e, _ = graph(rows, o)
        defs = {k + 1: f"v{supp % 3}" for x, k, _, supp, _ in rows if x == o}
        uses = {k + 1: f"v{part % 3}" for x, k, part, _, _ in rows if x == o}
        for d, name in defs.items():
            seen, todo = set(), [b for a, b in e if a == d]
            while todo:
                v = todo.pop()
                if v not in seen:
                    seen.add(v)
                    if defs.get(v) != name:
                        todo += [b for a, b in e if a == v]
            want |= {(f"order{o}", name, d, v) for v in seen if uses.get(v) == name}
    got = [tuple(r) for r in catalog.queries()["flow_def_use"](spark, folder).collect()]
    assert len(got) == len(want) and set(got) == want
