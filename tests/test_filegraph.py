import pytest
from pyspark.sql import functions as F

from evigraph.operators import filegraph as g
from evigraph.operators.integrity import orphans
from evigraph.sources import code
from tests.test_sources import CPP, CS


def test_types_and_flow(spark):
    header = "class UOther {};\nUINTERFACE()\n\nclass UThingy : public UInterface {};\nclass IThingy {};\nclass INone {};\nUINTERFACE(x)\nclass Plain {};\nUINTERFACE()\nint x;\nclass Far {};"
    files = spark.createDataFrame([("a.cpp", CPP), ("b.h", header)], "path string, text string")
    facts = code.extract(files)
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("p", "text")).select("path", (F.col("p") + 1).alias("line"), "text")
    nodes, edges = g.type_graph(facts)
    assert {(r.source, r.target, r.kind) for r in edges.collect()} == {("N::UThing", "UOther", "field_type")}
    assert {r.name: r.base_types for r in nodes.collect()}["N::UThing"] == ["IOther", "UBase"]
    assert {(r.name, tuple(r.reasons)) for r in g.interface_candidates(facts, lines).collect()} == {("UThingy", ("UINTERFACE macro", "derives from UInterface")), ("IThingy", ("paired I/U interface naming",))}
    assert [(r.kind, r.name) for r in g.function_flow(facts, "UThing::Act").collect()] == [("control", "if"), ("call", "Helper")]


def test_rules_and_receivers(spark):
    text = CS + "\nclass Sub : Game {}\nclass Else : Other {}"
    facts = code.extract(spark.createDataFrame([("x.Build.cs", text)], "path string, text string"), "cs_facts")
    assert {r.name for r in g.rules_classes(facts, "ModuleRules").collect()} == {"Game", "Sub"}
    calls = spark.createDataFrame([("p", "Log.Add", "M"), ("p", "Go", "M")], "path string, name string, owner string")
    fields = spark.createDataFrame([("p", "Log", "List")], "path string, name string, detail string")
    assert {r.target for r in g.receiver_types(calls, fields).collect()} == {"List.Add", "Go"}
    refs = spark.createDataFrame([("a.connections[0]",), ("b.class_path",), ("c.value",), ("d.connections",)], "field string")
    assert [r.field for r in g.meaningful(refs).collect()] == ["c.value"]


def test_plugins_entries_paths(spark):
    kind = "name string, enabled boolean, optional boolean, platform_allow array<string>, supported_platforms array<string>, platform_deny array<string>, target_allow array<string>, target_deny array<string>"
    d = spark.createDataFrame([("A", True, False, None, None, None, None, None), ("b", True, False, ["Linux"], None, None, None, None), ("C", True, True, None, None, None, None, None)], kind)
    p = spark.createDataFrame([("e/A.uplugin", "engine"), ("p/a.uplugin", "project")], "path string, origin string")
    out, problems = g.resolve_plugins(d, p, operation="resolve")
    assert {(r.name, r.descriptor, r.applies) for r in out.collect()} == {("A", "p/a.uplugin", True), ("b", None, False), ("C", None, True)}
    assert [(r.severity, r.subject) for r in problems.collect()] == [("warning", "C")]
    with pytest.raises(ValueError):
        g.resolve_plugins(d, p, operation="x")
    deps = spark.createDataFrame([("A", "B"), ("b", "C"), ("c", "a")], "plugin string, needs string")
    assert {(r.plugin, r.depth) for r in g.plugin_closure(spark.createDataFrame([("A",)], "name string"), deps).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    out, problems = g.classify_paths(spark.createDataFrame([("Source", True), ("Odd", True), ("Config", False), ("x.uproject", False)], "name string, is_dir boolean"))
    assert sorted((r.severity, r.code, r.subject) for r in problems.collect()) == [("error", "project-path-type-mismatch", "Config"), ("warning", "unclassified-project-root-directory", "Odd")]
    facts = spark.createDataFrame([("m.cpp", "macro", "IMPLEMENT_MODULE", "FMod , Core", 3)], "path string, kind string, name string, detail string, line int")
    heads = spark.createDataFrame([("m.h", "type", "FMod")], "path string, kind string, name string")
    got = {r.name: (r.header, r.code) for r in g.module_entries(facts, spark.createDataFrame([("core",), ("Ui",)], "name string"), heads).collect()}
    assert got == {"core": ("m.h", None), "Ui": (None, "module-entry-registration-not-found")}


def test_file_graph(spark):
    files = spark.createDataFrame([(x,) for x in ("G.uproject", "Source/A/A.Build.cs", "Source/B/B.Build.cs", "Source/A/a.cpp", "Source/A/a.h", "Plugins/P/P.uplugin", "Intermediate/x.h", "notes.txt", "Source/A/a.gen.cpp", "Source/G.Target.cs", "Source/A/Sub/S.Build.cs", "Source/A/Sub/s.mm")], "rel string")
    plugins = spark.createDataFrame([("G.uproject", "p", True, 4), ("G.uproject", "Gone", False, 5)], "source string, name string, enabled boolean, line int")
    refs = spark.createDataFrame([("Source/A/A.Build.cs", "b", "DEPENDS_ON_MODULE", 2), ("Source/A/A.Build.cs", "Core", "DEPENDS_ON_MODULE", 2), ("G.uproject", "A", "DECLARES_MODULE", 3)], "source string, name string, kind string, line int")
    inc = spark.createDataFrame([("Source/A/a.cpp", "a.h", "Source/A/a.h", "resolved", 1), ("Source/A/a.cpp", "vector", None, "system_or_sdk_unresolved", 2), ("Source/A/a.cpp", "two.h", None, "ambiguous", 3)], "source string, target string, path string, status string, line int")
    entries = spark.createDataFrame([("Source/A/A.Build.cs", "source/a/A.cpp", 7), ("Source/A/A.Build.cs", "gone.cpp", 1)], "rules string, source string, line int")
    n, e, v = g.build(files, plugins, refs, inc, entries)
    assert sorted((r.kind, r.resolution_status) for r in e.collect()) == [("CONTAINS_FILE", "resolved")] * 3 + [("DECLARES_MODULE", "resolved"), ("DECLARES_TARGET", "resolved"), ("DEPENDS_ON_MODULE", "external"), ("DEPENDS_ON_MODULE", "resolved"), ("DISABLES_PLUGIN", "external"), ("ENABLES_PLUGIN", "resolved"), ("INCLUDES", "resolved"), ("INCLUDES", "system_or_sdk_unresolved"), ("MODULE_ENTRY", "resolved")]
    ends = e.select(F.col("source_id").alias("node_id")).union(e.select("target_id"))
    assert orphans(ends, "node_id", n, "node_id").isEmpty() and v.count() == 12 and n.count() == 12
    path = {r.node_id: r.path for r in n.collect()}
    assert {(path[r.source_id], path[r.target_id]) for r in e.filter("kind = 'CONTAINS_FILE'").collect()} == {("Source/A/A.Build.cs", "Source/A/a.cpp"), ("Source/A/A.Build.cs", "Source/A/a.h"), ("Source/A/Sub/S.Build.cs", "Source/A/Sub/s.mm")}
    assert {path[r.target_id] for r in e.filter("kind = 'DECLARES_TARGET'").collect()} == {"Source/G.Target.cs"}
    assert {r.kind for r in n.collect()} == {"project_file", "module_rules_file", "source_file", "target_file", "plugin_file", "external_plugin", "external_module", "unresolved_include"}
