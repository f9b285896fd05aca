import pytest
from pyspark.sql import functions as F

from evigraph.operators import closure, cycles, fold, graph, integrity, resolve, upsert


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


@pytest.fixture(scope="module")
def abc(spark):
    return spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "A")], "src string, dst string")


def test_cycle_and_impact(spark, abc):
    assert [r.cycle for r in cycles.cycles(abc).collect()] == [["A", "B", "C", "A"]]
    assert rows(closure.impact(abc, "A", 3), "node", "depth") == [("B", 2), ("C", 1)]
    assert [(r.node, r.depth) for r in closure.impact_ordered(abc, "A", 3).orderBy("rank").collect()] == [("C", 1), ("B", 2)]
    with pytest.raises(ValueError):
        closure.impact(abc, "A", 0)


def test_cycles_follow_the_global_search_order(spark):
    e = spark.createDataFrame([("A", "C"), ("B", "C"), ("C", "B"), ("C", "D"), ("D", "B")], "src string, dst string")
    assert [r.cycle for r in cycles.cycles(e).collect()] == [["B", "C", "B"]]
    assert rows(cycles.scc_members(e), "node", "component") == [("B", "B"), ("C", "B"), ("D", "B")]
    long = spark.createDataFrame([(f"n{i:05d}", f"n{(i + 1) % 3000:05d}") for i in range(3000)], "src string, dst string")
    assert len(cycles.cycles(long).first().cycle) == 3001


def test_scc_members_leaves_out_nodes_between_cycles(spark):
    between = spark.createDataFrame([("b", "c"), ("c", "b"), ("c", "a"), ("a", "d"), ("d", "e"), ("e", "d")], "src string, dst string")
    assert rows(cycles.scc_members(between), "node", "component") == [("b", "b"), ("c", "b"), ("d", "d"), ("e", "d")]


@pytest.fixture(scope="module")
def small(spark):
    n = spark.createDataFrame([(x, k, x.upper(), p) for x, k, p in (("p", "project_file", "p.uproject"), ("b", "module", None), ("c", "source", "c.cpp"), ("h", "header", "h.h"))], "node_id string, kind string, name string, path string")
    e = spark.createDataFrame([("e1", "p", "b", "DECLARES"), ("e2", "b", "c", "CONTAINS"), ("e3", "c", "h", "INCLUDES")], "edge_id string, source_id string, target_id string, kind string")
    v = spark.createDataFrame([("v1", "e3", "c.cpp", 1), ("v2", "e3", "B.cpp", 9)], "evidence_id string, edge_id string, path string, line int")
    return n, e, v


def test_browse(spark, small):
    n, e, v = small
    nodes, edges, cut = closure.neighbourhood(n, e, "p", 3)
    assert rows(nodes, "node_id", "distance") == [("b", 1), ("c", 2), ("h", 3), ("p", 0)] and edges.count() == 3 and not cut
    nodes, edges = graph.hide_kinds(n, e, ["module"])
    assert rows(nodes, "node_id") == [("c",), ("h",), ("p",)] and rows(edges, "edge_id") == [("e3",)]
    ev = {r.edge_id: [(x.path, x.line) for x in r.evidence] for r in graph.attach_evidence(e, v).collect()}
    assert ev == {"e1": [], "e2": [], "e3": [("B.cpp", 9), ("c.cpp", 1)]}
    assert rows(graph.degrees(n, e), "node_id", "in_degree", "out_degree") == [("b", 1, 1), ("c", 1, 1), ("h", 1, 0), ("p", 0, 1)]
    assert graph.search(n, "H").first().node_id == "h" and graph.root_node(n, "project_file").first().node_id == "p"
    assert rows(graph.node_relations(e, "c"), "edge_id", "direction") == [("e2", "incoming"), ("e3", "outgoing")]


def test_cap_of_the_neighbourhood(spark):
    n = spark.createDataFrame([(f"n{i:02d}", "k", "x", None) for i in range(40)], "node_id string, kind string, name string, path string")
    e = spark.createDataFrame([(f"e{i:02d}", "n00", f"n{i:02d}", "K") for i in range(1, 40)], "edge_id string, source_id string, target_id string, kind string")
    nodes, edges, cut = closure.neighbourhood(n, e, "n00", 2, 20)
    assert rows(nodes, "node_id") == [(f"n{i:02d}",) for i in range(20)] and cut and edges.count() == 19


def test_hierarchy(spark):
    b = spark.createDataFrame([("D", "B"), ("D", "A"), ("B", "X"), ("E", "D")], "name string, base string")
    assert rows(closure.ancestor_chain(b, "E"), "hop", "base") == [(1, "D"), (2, "A")]
    assert rows(closure.descendants(b, "B"), "node") == [("D",), ("E",)]
    loop = spark.createDataFrame([("A", "B"), ("B", "A")], "name string, base string")
    assert rows(closure.descendants(loop, "A"), "node") == [("A",), ("B",)]
    v = spark.createDataFrame([("D", None, ["d"]), ("B", "typ", ["b", "d"]), ("E", None, ["e"])], "name string, value string, items array<string>")
    got = {r.name: (r.value, r["items"], r.cyclic) for r in closure.inherited(b.filter("base <> 'A'"), v).collect()}
    assert got["E"] == ("typ", ["b", "d", "e"], False) and got["B"] == ("typ", ["b", "d"], False)
    w = spark.createDataFrame([("A", None, ["a"]), ("B", None, ["b"])], "name string, value string, items array<string>")
    assert all(r.cyclic for r in closure.inherited(loop, w).collect())
    deep = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(24)] + [("t", "A"), ("A", "B"), ("B", "A")], "name string, base string")
    x = spark.createDataFrame([(f"n{i}", "far" if i == 24 else None, [f"i{i}"]) for i in range(25)] + [(k, None, [k]) for k in "tAB"], "name string, value string, items array<string>")
    got = {r.name: r for r in closure.inherited(deep, x).collect()}
    assert got["n0"].value == "far" and got["n0"]["items"] == [f"i{i}" for i in range(24, -1, -1)]
    assert got["A"].cyclic and not got["t"].cyclic and set(got["t"]["items"]) == set("tAB")


def test_blueprint_reachability(spark):
    pin = "struct<name:string,direction:string,type:string,connections:array<struct<node:string,pin:string>>>"
    df = spark.createDataFrame(
        [
            ("event", "K2Node_Event", [("then", "output", "exec", [("knot", "in")])]),
            ("knot", "K2Node_Knot", [("in", "input", "exec", [("event", "then")]), ("out", "output", "exec", [("call", "exec")])]),
            ("call", "K2Node_CallFunction", [("exec", "input", "exec", [("knot", "out")]), ("arg", "input", "int", [("getter", "v")])]),
            ("getter", "K2Node_VariableGet", [("v", "output", "int", [("call", "arg")])]),
            ("unused", "K2Node_VariableGet", [("v", "output", "int", [])]),
        ],
        f"object_path string, class string, pins array<{pin}>",
    )
    assert rows(closure.semantic_nodes(df), "node", "semantic") == [("call", True), ("event", False), ("getter", True), ("knot", False)]


def test_validation_and_difference(spark):
    n = spark.createDataFrame([("a", "p|k|a", "1"), ("b", "p|k|b", "1"), ("b", "p|k|b", "1")], "node_id string, canonical_key string, properties string")
    r = spark.createDataFrame([("r1", "a", "K", "b"), ("r2", "a", "K", "z")], "relation_id string, source_id string, kind string, target_id string")
    v = spark.createDataFrame([("v1", "r1"), ("v2", "r9")], "evidence_id string, relation_id string")
    p = integrity.validate_graph(n, r, v, {"nodes": 2, "evidence": 5})
    assert rows(p, "code", "subject") == [("dangling-evidence", "v2"), ("dangling-relation-endpoint", "r2"), ("duplicate-node-id", "b"), ("graph-count-mismatch", "evidence"), ("relation-evidence-missing", "r2")]
    assert tuple(integrity.status(p).first()) == ("error", 5) and tuple(integrity.status(p.limit(0)).first()) == ("ok", 0)
    assert integrity.status(p.limit(0).unionByName(spark.createDataFrame([("info", "x", "y", None)], p.schema))).first().status == "ok"
    m = spark.createDataFrame([("a", "p|k|a", "2"), ("c", "p|k|c", "1")], n.schema)
    assert rows(integrity.diff_nodes(n.distinct(), m), "canonical_key", "change") == [("p|k|a", "changed"), ("p|k|b", "removed"), ("p|k|c", "added")]
    a, b = integrity.relation_triples(n.distinct(), r), integrity.relation_triples(m, r)
    assert rows(integrity.diff_relations(a, b), "source_key", "change") == [("p|k|a", "removed")]
    ids = spark.createDataFrame([("a", "A1"), ("b", "B1")], "foreign_id string, local_id string")
    rel, detail = integrity.import_graph(r, r, v.withColumn("detail", F.lit("d")), ids)
    assert rows(rel, "source_id", "target_id") == [("A1", "B1")] and rows(detail, "detail") == [("d",)]


def test_upserts(spark):
    df = spark.createDataFrame([("n", "k1", "first", "x", 1), ("n", "k2", "second", "", 2), ("n", "k3", "third", None, 3)], "node_id string, kind string, name string, note string, seq long")
    assert tuple(upsert.upsert_nodes(df, last=("note",)).first()) == ("n", "k1", "first", "x")
    maps = spark.createDataFrame([("n", {"a": "1", "b": "2"}, 1), ("n", {"a": "", "b": "0", "c": None}, 2)], "node_id string, properties map<string,string>, seq long")
    assert upsert.merge_maps(maps, nulls_override=False).first().properties == {"a": "1", "b": "0", "c": None}
    assert upsert.merge_maps(maps).first().properties == {"a": "", "b": "0", "c": None}
    dep = spark.createDataFrame([("A", "class", ["f2"], [], 1), ("A", "struct", ["f1"], ["B"], 2)], "name string, kind string, files array<string>, base_types array<string>, seq long")
    assert tuple(upsert.accumulate_sets(dep).first()) == ("A", "class", ["f1", "f2"], ["B"])
    assert upsert.last_wins(df.select("node_id", "name", "seq"), "node_id").first().name == "third"
    assert graph.dependency_edges(spark.createDataFrame([("a", "a"), ("a", "b"), ("a", "b")], "source string, target string")).count() == 1


def test_fold_and_chain(spark):
    ops = [("+", "a"), ("+", "b"), ("+", "a"), (".", "a"), ("-", "b"), ("!", ""), ("set", "x"), (".", "x"), ("+", "x"), ("+", "y"), ("-", "x")]
    df = spark.createDataFrame([("s", i, o, v) for i, (o, v) in enumerate(ops)], "section string, seq long, operator string, value string")
    assert fold.fold_declarations(df.filter("seq < 5"), ["section"]).first()["values"] == ["a", "a"]
    assert fold.fold_declarations(df, ["section"]).first()["values"] == ["y"]
    twice = spark.createDataFrame([("A", "/0", 0), ("a", "/1", 1), ("b", "/2", 2)], "name string, pointer string, seq long")
    assert tuple(fold.duplicate_names(twice).first()) == ("a", 2, "/0")


def test_resolution(spark):
    c = spark.createDataFrame([("Core", 10, "e/Core"), ("core", 0, "p/core"), ("Ui", 3, "x/Ui")], "name string, rank int, path string")
    got = {r.key: (r.path, r.alternates) for r in resolve.overlay(c).collect()}
    assert got == {"core": ("p/core", ["e/Core"]), "ui": ("x/Ui", [])}
    refs = spark.createDataFrame([("CORE",), ("Ui",), ("Nope",)], "name string")
    out = resolve.reference_status(refs, c.withColumn("id", F.col("path")))
    assert rows(out, "name", "resolution_status", "target") == [("CORE", "ambiguous", "external:core"), ("Nope", "external", "external:nope"), ("Ui", "resolved", "x/Ui")]
    d = spark.createDataFrame([("A",), ("a",), ("B",), ("C",)], "name string")
    r = spark.createDataFrame([("b",), ("c",), ("C",), ("E",)], "name string")
    assert rows(resolve.reconcile(d, r), "key", "status") == [("a", "duplicate"), ("b", "resolved"), ("c", "ambiguous"), ("e", "undeclared")]
    own = resolve.deepest_owner(spark.createDataFrame([("a/b/c.h",), ("a/x.h",), ("q/y.h",)], "path string"), spark.createDataFrame([("a",), ("a/b",)], "root string"))
    assert rows(own.na.fill("-"), "path", "owner") == [("a/b/c.h", "a/b"), ("a/x.h", "a"), ("q/y.h", "-")]
    e = spark.createDataFrame([("h1", "s1"), ("h2", "s2"), ("h2", "s3")], "header string, source string")
    assert rows(resolve.pairing(e), "header", "source") == [("h1", "s1")]
    files = spark.createDataFrame([("h1", "h"), ("h2", "h"), ("h9", "h"), ("s3", "s")], "path string, side string")
    assert rows(resolve.pair_leftovers(files, e), "path") == [("h9",)]
    names = spark.createDataFrame([("A::X",), ("B::X",), ("Y",), ("A::Z",)], "name string")
    assert [resolve.select_symbol(names, s).first().status for s in ("X", "Y", "Z", "Q")] == ["ambiguous", "exact", "suffix", "not_found"]
    uses = spark.createDataFrame([(1, "A::B", "T"), (2, "Q", "U"), (3, "Q", "T")], "use_id int, scope string, expression string")
    types = spark.createDataFrame([("A::T",), ("B::T",), ("N::U",)], "qualified string")
    assert rows(resolve.scoped(uses, types).na.fill("-"), "use_id", "qualified") == [(1, "A::T"), (2, "N::U"), (3, "-")]
    obs = spark.createDataFrame([("empty", "[]"), ("changed", "2"), ("child", "v")], "name string, value string")
    base = spark.createDataFrame([("empty", "[]"), ("changed", "1")], "name string, value string")
    assert rows(resolve.property_delta(obs, base, ["name"]), "name", "comparison") == [("changed", "differs_from_default"), ("child", "baseline_property_missing"), ("empty", "matches_default")]
    assert resolve.deltas_only(resolve.property_delta(obs, None, ["name"])).count() == 0


def test_scc_members_on_a_chain_of_components(spark):
    pairs = [(f"n{i:03d}{x}", f"n{i:03d}{y}") for i in range(100) for x, y in ("ab", "ba")] + [(f"n{i:03d}a", f"n{i + 1:03d}a") for i in range(99)]
    got = cycles.scc_members(spark.createDataFrame(pairs, "src string, dst string")).collect()
    assert sorted((r.node, r.component) for r in got) == sorted((f"n{i:03d}{x}", f"n{i:03d}a") for i in range(100) for x in "ab")
    few = [p for p in pairs if p[0] < "n004"]
    spread = cycles.scc_members(spark.createDataFrame(few, "src string, dst string"), large=0).collect()
    assert sorted((r.node, r.component) for r in spread) == sorted((f"n{i:03d}{x}", f"n{i:03d}a") for i in range(4) for x in "ab")


def test_cycles_of_a_graph_with_several_ways_out_and_its_limit(spark):
    e = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "A"), ("B", "D"), ("D", "B"), ("A", "D"), ("D", "E"), ("E", "F")], "src string, dst string")
    assert [r.cycle for r in cycles.cycles(e).orderBy("cycle").collect()] == [["A", "B", "C", "A"], ["B", "D", "B"]]
    assert {(r.node, r.component) for r in cycles.scc_members(e).collect()} == {(x, "A") for x in "ABCD"}
    with pytest.raises(ValueError):
        cycles.cycles(e, most=3)


def test_breadth_first_ranks(spark):
    e = spark.createDataFrame([("d", "a"), ("b", "a"), ("x", "b"), ("y", "d"), ("c", "d"), ("x", "d"), ("z", "x")], "src string, dst string")
    got = closure.impact_ordered(e, "a", 3).orderBy("rank").collect()
    assert [(r.node, r.depth, r["rank"]) for r in got] == [("b", 1, 1), ("d", 1, 2), ("x", 2, 3), ("c", 2, 4), ("y", 2, 5), ("z", 3, 6)]
