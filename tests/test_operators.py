"""Operators and sources that SQL can't hold against: plain Python versions, properties and small cases."""

import ast
import random
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import hashing, text
from quern.operators import context, flow, intervals, pages, search, snapshots, workflow
from quern.sources import classify, files, graphcsv, manifests, python_code
from quern.streaming import receipts

# --- flow


def reach(out, start, without):
    seen, todo = set(), [start] if start != without else []
    while todo:
        v = todo.pop()
        if v not in seen:
            seen.add(v)
            todo += [b for b in out[v] if b != without]
    return seen


def dominated(out, root):
    all_ = reach(out, root, None)
    return {v: {d for d in all_ if d == v or v not in reach(out, root, d)} for v in all_}


@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=25))
@settings(max_examples=150, deadline=None)
def test_dominators(edges):
    g = flow.Flow(edges, 10)
    doms = dominated(g.out, 0)
    idom = g.dominators()
    for v in range(10):
        if v == 0 or v not in doms:
            assert idom[v] == -1
        else:
            assert idom[v] == max(doms[v] - {v}, key=lambda d: len(doms[d]))


@given(st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7)), max_size=18))
@settings(max_examples=150, deadline=None)
def test_control_dependence(edges):
    edges = [e for e in edges if e[0] != 1]  # nothing follows the exit
    g = flow.Flow(edges, 8).with_exits()
    post = dominated(g.into, 1)
    want = {(n, a) for a in reach(g.out, 0, None) for b in g.out[a] for n in post.get(b, ()) if len(g.out[a]) > 1 and a in post and not (n in post[a] and n != a)}
    assert set(flow.Flow(edges, 8).control_dependence()) == want


@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), max_size=14), st.lists(st.tuples(st.integers(0, 6), st.sampled_from("xy")), max_size=6), st.lists(st.tuples(st.integers(0, 6), st.sampled_from("xy")), max_size=6))
@settings(max_examples=150, deadline=None)
def test_def_use(edges, defs, uses):
    g = flow.Flow(edges, 7)
    by = lambda pairs: {v: [x for w, x in pairs if w == v] for v, _ in pairs}
    live, want = reach(g.out, 0, None), set()
    for d, x in defs:
        if d not in live:
            continue
        seen, todo = set(), list(g.out[d])
        while todo:
            v = todo.pop()
            if v not in seen:
                seen.add(v)
                if (v, x) in uses:
                    want.add((x, d, v))
                if (v, x) not in defs:
                    todo += g.out[v]
    assert set(g.def_use(by(defs), by(uses))) == want


def test_lowering():
    code = "def f(a):\n    x = 1\n    while a:\n        if x:\n            break\n        x += a\n    else:\n        return 0\n    return x\n"
    low = flow.Lowering(ast.parse(code).body[0])
    line = low.line
    pairs = {(v, line[d], line[u]) for v, d, u in low.flow().def_use(low.defs, low.uses)}
    assert pairs == {("a", 1, 3), ("a", 1, 6), ("x", 2, 4), ("x", 6, 4), ("x", 2, 6), ("x", 6, 6), ("x", 2, 9), ("x", 6, 9)}
    control = {(line.get(n, "exit"), line[b]) for n, b in low.flow().control_dependence()}
    assert {(6, 4), (4, 3), (3, 4)} <= control


# --- intervals


@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40))))
def test_merged_ranges_cover_the_same(ranges):
    merged = receipts.merge(ranges)
    cells = lambda rs: {i for s, e in rs for i in range(s, e)}
    assert cells(merged) == cells(ranges) and all(a[1] < b[0] for a, b in zip(merged, merged[1:]))


def test_coalesce_equals_merge(spark):
    rng = random.Random(1)
    rows = [(k, s := rng.randrange(100), s + rng.randrange(12)) for k in range(5) for _ in range(20)]
    got = intervals.coalesce(spark.createDataFrame(rows, "k int, start_byte long, end_byte long"), ["k"]).collect()
    for k in range(5):
        assert sorted((r.start_byte, r.end_byte) for r in got if r.k == k) == receipts.merge([r[1:] for r in rows if r[0] == k])


# --- pages


def test_clamp():
    assert pages.clamp(0) == (200, None) and pages.clamp(5) == (5, None)
    assert pages.clamp(500) == (200, "requested 500, effective 200")
    with pytest.raises(ValueError):
        pages.clamp(-1)


def test_cursors():
    c = pages.sign(b"k", {"generation": 2, "after": ["x"], "expires": 1 << 40})
    assert pages.opened(b"k", c, generation=2)["after"] == ["x"]
    for bad in (lambda: pages.opened(b"other", c), lambda: pages.opened(b"k", c, generation=3), lambda: pages.opened(b"k", c[:-2]), lambda: pages.opened(b"k", pages.sign(b"k", {"expires": 1}))):
        with pytest.raises(ValueError):
            bad()


def test_keyset_over_two_keys(spark):
    df = spark.createDataFrame([(a, b) for a, b in product(range(4), "xyz")], "a int, b string")
    seen, after = [], None
    while rows := pages.keyset(df, ["a", "b"], after, 5).collect():
        seen += [tuple(r) for r in rows]
        after = list(rows[-1])
    assert seen == sorted(product(range(4), "xyz"))


# --- search


def test_query_parser():
    assert search.parse('Foo "bar  Baz" foo "x') == [["foo"], ["bar", "baz"], ["x"]]
    assert search.parse("Éa_b") == [["ea"], ["b"]]
    assert search.parse('""') == []


def test_paths():
    assert search.normal_path(" ./a\\b ") == "a/b"
    assert [search.normal_path(p) for p in ("/a", "a/../b", "a//b", "", "C:/x")] == [None] * 5


def test_search_folds_tiers(spark):
    docs = spark.createDataFrame([(1, "d1", "en", "a/b", "en", "b", "a.b", "alpha beta"), (2, "d2", "en", "a/c", "en", "a.b", "x", "beta a b"), (3, "d3", "en", "q", "en", "z", "a.bc", "none")], "doc_id long, node_id string, unit_id string, path string, language string, name string, qualified_name string, body string")
    got = search.search(docs, "a.b").collect()
    assert [(r.node_id, r.tier) for r in got] == [("d1", 1), ("d3", 2), ("d2", 3)] and got[0].occurrences > 0
    assert [r.node_id for r in search.search(docs, "nothing").collect()] == []
    assert [(r.node_id, r.tier) for r in search.search(docs, "q").collect()] == [("d3", 0)]


# --- functions


def test_identities(spark):
    row = spark.range(1).select(hashing.framed("node-v1", F.lit("a"), F.lit("é")).alias("x"), hashing.framed("node-v1", F.lit("aé"), F.lit("")).alias("y")).first()
    assert row.x == hashing.framed_id("node-v1", "a", "é") and row.y == hashing.framed_id("node-v1", "aé", "") and row.x != row.y


def test_text_functions(spark):
    rows = spark.createDataFrame([("aé日b",), ("",), ("plain",), (None,)], "t string")
    for n in range(9):
        for r in rows.select("t", text.clip_bytes(F.col("t"), n).alias("c")).collect():
            assert r.c == (None if r.t is None else r.t.encode()[:n].decode("utf-8", "ignore"))
    out = spark.range(1).select(text.ancestors(F.lit("a/b/c")).alias("a"), text.parent_path(F.lit("a")).alias("p"), text.tokens(F.lit("Crème_brûlée, 9x!")).alias("t")).first()
    assert out.a == ["a", "a/b", "a/b/c"] and out.p is None and out.t == ["creme", "brulee", "9x"]


def test_scaled_product(spark):
    pairs = [(1_000_000, 650_000), (3, 500_000), (-3, 500_000), (999_999, 999_999), (-7, 900_000), (0, 5)]
    got = spark.createDataFrame([(*p,) for p in pairs], "a long, b long").select(text.mul_scaled(F.col("a"), F.col("b")).alias("m")).collect()
    assert [r.m for r in got] == [650_000, 2, -2, 999_998, -6, 0]


# --- context


def test_seed_extraction():
    got = context.seeds_of("Fix `Foo.bar` in src/a.py near pkg.mod, please", ["id1"])
    assert got[:4] == [("explicit", "id1"), ("quoted", "Foo.bar"), ("term", "fix"), ("path", "src/a.py")]
    assert ("qualified", "pkg.mod") in got and ("term", "please") in got


@given(st.lists(st.tuples(st.integers(0, 10), st.integers(0, 10)), max_size=30))
def test_next_fit(sizes):
    got = context.next_fit(iter(sizes), 10, 10)
    assert got == sorted(got)
    for s in set(got):
        assert sum(b for (b, _), g in zip(sizes, got) if g == s) <= 10 and sum(t for (_, t), g in zip(sizes, got) if g == s) <= 10


def test_next_fit_budget():
    with pytest.raises(context.BudgetError):
        context.next_fit(iter([(11, 1)]), 10, 10)
    assert context.next_fit(iter([(6, 1)] * 4), 10, 10, most_slices=2) == [0, 1, -1, -1]


# --- sessions


def test_session_states(spark):
    files_ = spark.createDataFrame([("a", "full", "full", False, True), ("b", "symbol", "partial", True, False), ("c", "optional", "unserved", False, False)], "path string, requirement string, state string, waived boolean, acknowledged boolean")
    counts = workflow.readiness(files_)
    assert counts == {"required": 2, "unserved": 0, "partial": 0, "unacknowledged": 0}
    s = workflow.Session("s")
    for k, state in enumerate(("verify", "consolidate", "complete")):
        s = workflow.advance(s, k, counts, 1)
        assert (s.state, s.version) == (state, k + 1)
    with pytest.raises(workflow.Conflict):
        workflow.advance(s, 0, counts, 1)
    with pytest.raises(workflow.NotReady):
        workflow.advance(workflow.Session("s"), 0, counts | {"partial": 1}, 1)
    assert workflow.next_item(files_.withColumn("waived", F.lit(False))).first().path == "b"


def test_capture(spark):
    index = spark.createDataFrame([("same", "1"), ("edited", "1"), ("gone", "1")], "path string, content_hash string")
    walked = spark.createDataFrame([("same", "1", False), ("edited", "2", False), ("new", "3", False), ("staged", "4", True)], "path string, content_hash string, staged boolean")
    assert {r.path: r.status for r in snapshots.capture(index, walked).collect()} == {"same": "tracked", "edited": "modified", "gone": "deleted", "new": "untracked", "staged": "added"}


# --- files


@given(st.binary(max_size=400), st.integers(8, 64))
def test_chunks_cover_the_file(data, most):
    got = files.plan_chunks(data, most, 2, 6)
    assert (not data and not got) or (got[0][0] == 0 and got[-1][1] == len(data))
    for (s, e), (s2, e2) in zip(got, got[1:]):
        assert s < s2 <= e < e2 and e2 - s2 <= most and e - s2 <= 6


@given(st.binary(max_size=200))
def test_sanitise_keeps_length(data):
    out = files.sanitise(data)
    assert len(out) == len(data) and b"\0" not in out and out.decode() is not None
    if b"\0" not in data:
        try:
            assert data.decode() == out.decode()
        except UnicodeDecodeError:
            pass


def test_positions():
    data = "a\né😀b".encode()
    assert files.position(data, len(data), "utf-8") == (1, 7)
    assert files.position(data, len(data), "utf-16") == (1, 4)
    assert files.position(data, len(data), "utf-32") == (1, 3)


def test_binary_sniff():
    assert files.looks_binary(b"ab\0\0\0\0") and files.looks_binary(bytes(range(1, 9)) * 4) and not files.looks_binary(b"text\n")


def test_walk_and_tree(spark, tmp_path):
    for p in ("a/b/x.py", "a/y.md", ".git/config", "a/node_modules/z.js"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("1")
    found = files.walk(spark, str(tmp_path))
    assert {r.path for r in found.select("path").collect()} == {"a/b/x.py", "a/y.md"}
    nodes, contains = files.tree(found)
    assert {(r.path, r.kind) for r in nodes.collect()} == {("a", "directory"), ("a/b", "directory"), ("a/b/x.py", "file"), ("a/y.md", "file")}
    assert {(r.parent, r.child) for r in contains.collect()} == {("a", "a/b"), ("a/b", "a/b/x.py"), ("a", "a/y.md")}


def test_classify(spark):
    paths = {"x/go.mod": ("gomod", "file"), ".github/workflows/a.yml": ("github-actions", "configuration"), "t/test_a.py": ("", "file"), "b.unknown": ("", "file"), "Makefile": ("make", "build_target"), "docs/adr/1.md": ("adr", "document")}
    form, kind = classify.classify(F.col("p"))
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", form.alias("f"), kind.alias("k")).collect()
    assert {r.p: (r.f, r.k) for r in got} == paths


# --- manifests and code


MANIFESTS = {
    "go.mod": ("module a.b/c // x\nrequire (\n  d.e/f v1.2.3\n  g/h v0.1 // indirect\n)\nrequire i/j v2\n", {("module", "a.b/c"), ("dependency", "d.e/f"), ("dependency", "g/h"), ("dependency", "i/j")}),
    "package.json": ('{"name": "n", "version": "1", "dependencies": {"a": "^1"}, "devDependencies": {"b": "2"}}', {("package", "n"), ("dependency", "a"), ("dependency", "b")}),
    "Cargo.toml": ('[package]\nname = "c"\nversion = "1"\n[dependencies]\nx = "1"\ny = { version = "2", package = "z" }\n', {("package", "c"), ("dependency", "x"), ("dependency", "z")}),
    "pyproject.toml": ('[project]\nname = "p"\ndependencies = ["Req_A>=1; python_version>\'3\'", "b[x]"]\n', {("package", "p"), ("dependency", "req-a"), ("dependency", "b")}),
    "pom.xml": ('<project xmlns="http://x"><groupId>g</groupId><artifactId>a</artifactId><version>1</version><dependencies><dependency><groupId>h</groupId><artifactId>b</artifactId><version>${v}</version></dependency></dependencies></project>', {("package", "g:a"), ("dependency", "h:b")}),
    "README.md": ("# T\n```\n# not\n```\n## S\n[l](http://x) ![i](y)\n", {("section", "T"), ("section", "S"), ("link", "http://x")}),
}


def test_manifests(spark):
    rows = [(f"d/{n}", t) for n, (t, _) in MANIFESTS.items()] + [("bad/package.json", "{"), ("bad/pom.xml", "<a>"), ("other.txt", "x")]
    got = manifests.manifest_facts(spark.createDataFrame(rows, "path string, text string")).collect()
    for n, (_, want) in MANIFESTS.items():
        assert {(r.fact, r.name) for r in got if r.path == f"d/{n}"} == want
    assert {r.path for r in got if r.fact == "failed"} == {"bad/package.json", "bad/pom.xml"} and not any(r.path == "other.txt" for r in got)
    assert {(r.name, r.scope) for r in got if r.path == "d/README.md" and r.fact == "section"} == {("T", None), ("S", "T")}


def test_python_facts(spark):
    code = "import os\nfrom a.b import c as d\nclass K:\n    def m(self):\n        return f()\ndef f():\n    return K\ndef g():\n    def f(): pass\n    f()\n"
    got = python_code.python_facts(spark.createDataFrame([("x.py", code), ("bad.py", "def")], "path string, text string")).collect()
    facts_ = {(r.fact, r.name, r.target or r.qualified_name) for r in got if r.path == "x.py"}
    assert {("class", "K", "K"), ("method", "m", "K.m"), ("function", "f", "f"), ("function", "f", "g.f"), ("import", "os", None), ("import", "a.b.c", "d"), ("references", "K", "K"), ("may_refer_to", "f", "f"), ("may_refer_to", "f", "g.f")} <= facts_
    assert [r.fact for r in got if r.path == "bad.py"] == ["failed"]


def test_graph_csv(spark, tmp_path):
    put = lambda n, t: (tmp_path / n).write_text(t)
    put("nodes_METHOD_header.csv", ":ID,:LABEL,FULL_NAME,LINE_NUMBER:int\n")
    put("nodes_METHOD_data.csv", '1,METHOD,"a.f, g",3\n2,METHOD,b,4\n3,METHOD,c,\n')
    put("nodes_CALL_header.csv", ":ID,:LABEL,NAME\n")
    put("nodes_CALL_data.csv", "10,CALL,b\n11,CALL,x\n")
    for kind, data in (("CALL", "10,2,CALL\n11,2,CALL\n11,3,CALL\n"), ("CONTAINS", "1,10,CONTAINS\n1,11,CONTAINS\n")):
        put(f"edges_{kind}_header.csv", ":START_ID,:END_ID,:TYPE\n")
        put(f"edges_{kind}_data.csv", data)
    nodes, edges = graphcsv.load(spark, str(tmp_path))
    assert nodes.count() == 5 and edges.count() == 5
    assert {(r.caller, r.callee, r.kind) for r in graphcsv.calls(nodes, edges).collect()} == {("a.f, g", "b", "calls"), ("a.f, g", "b", "may_refer_to"), ("a.f, g", "c", "may_refer_to")}
