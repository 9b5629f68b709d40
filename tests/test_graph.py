"""Hand-made graphs and source texts with worked-out results."""

import random

import pytest
from pyspark.sql import functions as F

from weftgraph.model import ITEMS, RELATIONSHIPS, CodeGraph
from weftgraph.errors import QueryError
from weftgraph.operators import extract, queries, relate, traverse
from weftgraph.operators.catalog import Ask
from weftgraph.plans.build import build


def graph(spark, functions, calls):
    """functions: path -> item id; calls: pairs of ids."""
    files = spark.createDataFrame([(p, "", 0, 0) for p in functions], "path string, content string, mtime bigint, len bigint")
    items = spark.createDataFrame([(p, 0, i, "Function", i.split(":")[1], "Public", None, 1, 1, None) for p, i in functions.items()], ITEMS)
    edges = spark.createDataFrame([(a, b, "Calls", "test", 1.0, "") for a, b in calls], RELATIONSHIPS)
    return CodeGraph(files, items, spark.createDataFrame([], "path string, ordinal int, import_path string, alias string"), edges)


CHAIN = {"src/a.rs": "fn:fa:1", "src/b.rs": "fn:fb:2", "src/c.rs": "fn:fc:3"}
MODULES = {"src/a.rs": "fn:a:1", "src/b.rs": "fn:b:1", "src/m1/c.rs": "fn:c:1", "src/m2/d.rs": "fn:d:1"}


def values(df, *columns):
    return [tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()]


def test_chain_and_cycle(spark):
    g = graph(spark, CHAIN, [("fn:fa:1", "fn:fb:2"), ("fn:fb:2", "fn:fc:3")])
    assert values(queries.connected_files(g, "src/a.rs"), "path") == ["src/b.rs"]
    assert values(queries.function_usage(g, "fa", "callees"), "path") == ["src/b.rs"]
    assert values(queries.function_usage(g, "fb", "callers"), "path") == ["src/a.rs"]
    assert traverse.cycles(g).collect() == []
    ring = graph(spark, CHAIN, [("fn:fa:1", "fn:fb:2"), ("fn:fb:2", "fn:fc:3"), ("fn:fc:3", "fn:fa:1")])
    assert values(traverse.cycles(ring), "files") == ["src/a.rs -> src/b.rs -> src/c.rs"]
    assert sorted(values(traverse.cycle_members(ring), "path")) == sorted(CHAIN)


def test_paths_and_hubs(spark):
    g = graph(spark, MODULES, [("fn:a:1", "fn:b:1"), ("fn:b:1", "fn:c:1")])
    assert values(traverse.shortest_path(g, "src/a.rs", "src/m1/c.rs"), "path") == ["src/a.rs", "src/b.rs", "src/m1/c.rs"]
    assert values(traverse.shortest_path(g, "src/m1/c.rs", "src/a.rs"), "path") == []
    assert values(traverse.shortest_path(g, "src/a.rs", "src/a.rs"), "path") == ["src/a.rs"]
    assert values(traverse.shortest_path(g, "src/a.rs", "nowhere.rs"), "path") == []
    row = ("path", "indegree", "outdegree")
    assert values(queries.hubs(g), *row) == [("src/b.rs", 1, 1), ("src/a.rs", 0, 1), ("src/m1/c.rs", 1, 0), ("src/m2/d.rs", 0, 0)]
    assert values(queries.hubs(g, "in", 1), "path") == ["src/b.rs"]
    assert values(queries.module_centrality(g), "module", "indegree", "outdegree") == [("src", 0, 1), ("src/m1", 1, 0), ("src/m2", 0, 0)]


def test_shared_ids_have_one_owner(spark):
    files = {"src/a/b.rs": "fn:dup:1", "src/a.rs": "fn:dup:1"}
    g = graph(spark, files, [])
    assert values(g.item_owner(), "item_id", "path") == [("fn:dup:1", "src/a.rs")]
    assert values(queries.item_lookup(g, "dup"), "path", "rank") == [("src/a.rs", 1), ("src/a/b.rs", 2)]


@pytest.mark.parametrize("seed", range(2))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    nodes = {f"src/f{i}.rs": f"fn:f{i}:1" for i in range(9)}
    ids = list(nodes.values())
    calls = [(rng.choice(ids), rng.choice(ids)) for _ in range(13)]
    g = graph(spark, nodes, calls)
    path = {v: k for k, v in nodes.items()}
    out = {p: {path[b] for a, b in calls if path[a] == p and a != b} for p in nodes}

    def distances(s):
        dist, todo = {s: 0}, [s]
        for u in todo:
            for v in out[u]:
                if v not in dist:
                    dist[v] = dist[u] + 1
                    todo.append(v)
        return dist

    reach = {p: set().union(*[distances(v).keys() for v in out[p]]) if out[p] else set() for p in nodes}
    assert sorted(values(traverse.cycle_members(g), "path")) == sorted(p for p in nodes if p in reach[p])
    for cycle in values(traverse.cycles(g), "files"):
        c = cycle.split(" -> ")
        assert all(v in out[u] for u, v in zip(c, c[1:] + c[:1]))
    assert bool(traverse.cycles(g).count()) == any(p in reach[p] for p in nodes)
    d = distances("src/f0.rs")
    for target in ("src/f1.rs", "src/f2.rs"):
        got = values(traverse.shortest_path(g, "src/f0.rs", target), "path")
        assert len(got) == (d[target] + 1 if target in d else 0) and all(v in out[u] for u, v in zip(got, got[1:]))


@pytest.mark.parametrize("seed", range(2))
def test_cycles_in_the_order_of_a_search(spark, seed):
    """The listing, its order and numbers against a plain recursive search over all files, ways into cycles included."""
    rng = random.Random(seed)
    nodes = {f"src/{'ab'[i % 2]}/f{i}.rs": f"fn:f{i}:1" for i in range(24)}
    paths = list(nodes)
    calls = {(rng.choice(paths[:12]), rng.choice(paths[:12])) for _ in range(16)} | {(rng.choice(paths[12:]), rng.choice(paths[12:])) for _ in range(18)}
    g = graph(spark, nodes, [(nodes[a], nodes[b]) for a, b in calls])
    key = lambda p: p.split("/")
    found, seen = [], set()

    def visit(u, trail):
        seen.add(u)
        for v in sorted((b for a, b in calls if a == u != b), key=key):
            if v in trail + [u]:
                found.append((trail + [u])[(trail + [u]).index(v) :])
            elif v not in seen:
                visit(v, trail + [u])

    for p in sorted(paths, key=key):
        if p not in seen:
            visit(p, [])
    assert values(traverse.cycles(g).orderBy("cycle"), "cycle", "files", "length") == [(i, " -> ".join(c), len(c)) for i, c in enumerate(found)]
    parts = {}
    for r in traverse.strong_parts(traverse.call_edges(g)).collect():
        parts.setdefault(r.label, set()).add(r.node)
    assert all(any(set(c) <= p for p in parts.values()) for c in found)


def test_exclamation_before_much_white_space(spark):
    files = sources(spark, {"src/a.rs": "fn f() { if !" + " \n" * 400 + "ok() {} }\nfn ok() {}\nfn g() {" + "x(); " * 3000 + " ok() }\nfn x() {}\n"})
    calls = {r["context"]: r["pos"] for r in relate.simple_calls(files, extract.items(files)).collect()}
    assert calls.keys() == {"ok", "x"} and calls["ok"] > 3000


def sources(spark, files):
    return spark.createDataFrame([(p, t, 0, len(t)) for p, t in files.items()], "path string, content string, mtime bigint, len bigint")


def test_extraction_micro_cases(spark):
    text = "pub fn top() {}\nfn hidden() {}\npub(crate) struct S;\npub(super) enum E { A, B }\n\npub async fn af() {}\npub const fn cf() {}\npub struct TS(u32);\npub(self) fn scoped() {}\nfn g<T>(x: T) {}\nunsafe fn u() {}\nmod m; pub fn inl() {}\n"
    got = {r["name"]: r for r in extract.items(sources(spark, {"src/a.rs": text})).collect()}
    assert got.keys() == {"a", "top", "hidden", "S", "E", "af", "cf", "TS", "scoped"}
    assert [got[n]["visibility"] for n in ("top", "hidden", "S", "E", "scoped")] == ["Public", "Private", "PubCrate", "PubSuper", "PubIn"]
    assert got["scoped"]["vis_scope"] == "self" and got["af"]["attrs"]["is_async"] and got["cf"]["attrs"]["is_const"] and not got["top"]["attrs"]["is_async"]
    assert [got[n]["ordinal"] for n in ("a", "top", "hidden", "af", "cf", "scoped", "S", "TS", "E")] == list(range(9))
    lines = {r["name"]: r["line_start"] for r in extract.items(sources(spark, {"src/x.rs": "pub fn a() {}\n\nfn b() {}\n"})).collect()}
    assert lines["a"] == 1 and lines["b"] == 2
    uses = "use std::collections::HashMap;\npub use crate::module::Thing as Alias;\nuse c::{d,e};\npub(crate) use q::r;\nuse y::z; // c\nuse t as _;\nuse x::*;\n"
    got = values(extract.imports(sources(spark, {"src/a.rs": uses})).orderBy("ordinal"), "import_path", "alias")
    assert got == [("std::collections::HashMap", None), ("crate::module::Thing", "Alias"), ("t", "_"), ("x::*", None)]


P1 = {
    "src/lib.rs": "\nmod a;\nmod b;\nuse crate::a::foo;\npub fn root() { foo(); }\n",
    "src/a.rs": "\npub fn foo() {}\n",
    "src/b.rs": "\npub fn bar() { crate::a::foo(); }\n",
}


def test_small_project(spark):
    g = build(sources(spark, P1))
    got = {(r["from_item"], r["to_item"], f"{r['rel_type']}/{r['rel_detail']}", r["strength"], r["context"]) for r in g.relationships.collect()}
    assert got == {
        ("file:src/lib.rs", "fn:root:5", "Contains/file_contains", 1.0, "auto"),
        ("file:src/a.rs", "fn:foo:1", "Contains/file_contains", 1.0, "auto"),
        ("file:src/b.rs", "fn:bar:1", "Contains/file_contains", 1.0, "auto"),
        ("file:src/lib.rs", "file:src/a.rs", "Contains/module_contains", 1.0, "fs"),
        ("file:src/lib.rs", "file:src/b.rs", "Contains/module_contains", 1.0, "fs"),
        ("file:src/lib.rs", "fn:foo:1", "Uses/import-item", 1.0, "crate::a::foo"),
        ("file:src/lib.rs", "fn:foo:1", "Calls/heuristic", 0.5, "foo"),
        ("file:src/b.rs", "fn:foo:1", "Calls/path", 0.7, "crate::a::foo"),
    }
    g.relationships = g.relationships.cache()
    assert values(queries.connected_files(g, "src/a.rs"), "path") == ["src/b.rs", "src/lib.rs"]
    assert values(queries.function_usage(g, "foo"), "path") == ["src/a.rs", "src/b.rs", "src/lib.rs"]
    assert values(queries.hubs(g), "path", "indegree", "outdegree") == [("src/a.rs", 4, 0), ("src/lib.rs", 0, 4), ("src/b.rs", 1, 1)]
    assert values(queries.unreferenced_items(g, True), "name") == ["bar", "root"]
    assert values(traverse.shortest_path(g, "src/b.rs", "src/a.rs"), "path") == ["src/b.rs", "src/a.rs"]


def test_call_heuristics(spark):
    files = sources(spark, {"src/a.rs": "fn main(){ foo(); a::b::baz(); my_macro!(x); if !ok() {} }\nfn foo() {}\nfn ok() {}\nfn b() {}\nfn my_macro() {}\nfn x(){ b() }\n", "src/b.rs": "pub fn baz() {}\n"})
    items, imports = extract.items(files), extract.imports(files)
    simple = {r["context"] for r in relate.simple_calls(files, items).collect()}
    assert simple == {"foo", "baz"}
    assert {r["context"] for r in relate.path_calls(files, items, imports).collect()} == {"a::b::baz"}


def test_questions_by_name(spark):
    g = graph(spark, CHAIN, [("fn:fa:1", "fn:fb:2")])
    assert values(Ask("connected-files", {"file": "src/a.rs"}).run(g), "path") == ["src/b.rs"]
    assert values(Ask("hubs", {"metric": "in", "top": 1}).run(g), "path") == ["src/b.rs"]
    with pytest.raises(QueryError):
        Ask("nothing").run(g)


def test_hierarchy(spark):
    files = sources(spark, {p: "" for p in ("src/lib.rs", "src/a/mod.rs", "src/a/foo.rs")})
    got = dict(values(relate.module_parents(files), "path", "parent"))
    assert got == {"src/a/mod.rs": "src/lib.rs", "src/a/foo.rs": "src/a/mod.rs"}
    g = CodeGraph(files, None, None, None)
    assert values(queries.module_parent(g, "src/a/foo.rs"), "path") == ["src/a/mod.rs"] and values(queries.module_children(g, "src/lib.rs"), "path") == ["src/a/mod.rs"]
    bare = sources(spark, {p: "" for p in ("src/lib.rs", "lib.rs", "z.rs")})  # a folder's lib.rs looks one folder up
    assert dict(values(relate.module_parents(bare), "path", "parent")) == {"src/lib.rs": "lib.rs", "z.rs": "lib.rs"}
