"""Whole tools over extracted facts: type graphs, file graphs, plugin resolution, module entries, path roles, function flow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import file_id
from ..functions.text import SKIPPED_FOLDED, in_skipped, is_generated, leaf, parent, source_kind, stem, type_names
from .closure import reach
from .resolve import adjacent_markers, applicable, deepest_owner, origin_rank, overlay_winner, reference_status, scoped, synthetic_nodes
from .upsert import union

# --- types ----------------------------------------------------------------------------------------


def type_graph(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of types from C++ facts (path, kind, name, owner, detail, line).

    The type names in bases and fields are resolved by what is written out, by the scopes around the type that uses them, or as the only one of that name; a base
    that resolves to nothing stays as text in ``base_types`` and gives no edge; self-edges go.
    """
    q = F.concat_ws("::", F.nullif("owner", F.lit("")), "name")
    around = lambda c: F.regexp_replace(c, "(^|::)[^:]+$", "")
    types = facts.filter("kind = 'type'").select("path", "line", q.alias("qualified"), F.col("owner").alias("scope"), F.filter(F.split("detail", ","), lambda b: b != "").alias("bases"))
    cols = ["path", "line", "source", "scope", "text", "kind"]
    fields = facts.filter("kind = 'field'").select("path", "line", F.col("owner").alias("source"), around(F.col("owner")).alias("scope"), F.col("detail").alias("text"), F.lit("field_type").alias("kind"))
    up = types.select("path", "line", F.col("qualified").alias("source"), "scope", F.explode("bases").alias("text"), F.lit("inheritance").alias("kind"))
    uses = up.unionByName(fields).select(*cols, F.explode_outer(type_names(F.col("text"))).alias("expression")).withColumn("use_id", F.struct(*cols, "expression"))
    known = scoped(uses.filter("expression is not null").select("use_id", "scope", "expression", "text").distinct(), types.select("qualified")).select("use_id", F.col("qualified").alias("target"))
    bound = known.filter("target is not null").select("use_id.*", "target").filter("source <> target")
    edges = bound.select("source", "target", "kind", "path", "line").distinct()
    told = uses.filter("kind = 'inheritance'").join(known, "use_id", "left")
    bases = told.groupBy(F.col("source").alias("name")).agg(F.array_sort(F.collect_set(F.coalesce("target", "expression"))).alias("base_types"))
    nodes = types.groupBy(F.col("qualified").alias("name")).agg(F.lit("type").alias("kind"), F.array_sort(F.collect_set("path")).alias("files")).join(bases, "name", "left")
    return nodes.withColumn("base_types", F.coalesce("base_types", F.array().cast("array<string>"))), edges


#: Macros above a declaration that speak of it, and reasons for which a type may be an interface.
REFLECTION = ("UCLASS", "USTRUCT", "UENUM", "UINTERFACE", "UFUNCTION", "UPROPERTY", "UDELEGATE")
REASONS = ("UINTERFACE macro", "derives from UInterface", "paired I/U interface naming")


def interface_candidates(facts: DataFrame, lines: DataFrame) -> DataFrame:
    """Types with the reasons for which they may be interfaces: ``UINTERFACE()`` directly above them, a base, or an I beside a U of one name.

    ``lines`` (path, line, text) tells what stands between a macro and the type: only blank lines and other such macros may.
    """
    types = facts.filter("kind = 'type'").select("path", "line", "name", F.split("detail", ",").alias("bases"))
    at = types.select("path", "line").distinct().withColumn("is_type", F.lit(True))
    macros = facts.filter((F.col("kind") == "macro") & F.col("name").isin(*REFLECTION)).groupBy("path", "line").agg(F.max((F.col("name") == "UINTERFACE") & (F.trim("detail") == "")).alias("plain"))
    told = lines.select("path", "line", "text").join(at, ["path", "line"], "left").join(macros, ["path", "line"], "left")
    above = adjacent_markers(told, F.col("plain").isNotNull(), F.coalesce("is_type", F.lit(False)), doc="path")
    plain = above.join(macros.filter("plain").withColumnRenamed("line", "marker_line"), ["path", "marker_line"])
    marked = plain.select("path", F.col("target_line").alias("line")).distinct().withColumn("marked", F.lit(True))
    pairs = types.filter(F.startswith("name", F.lit("U"))).select(F.concat(F.lit("I"), F.substr("name", F.lit(2))).alias("name")).distinct().withColumn("paired", F.lit(True))
    out = types.join(marked, ["path", "line"], "left").join(pairs, "name", "left")
    tests = (F.col("marked"), F.exists("bases", lambda b: b == "UInterface"), F.col("paired"))
    reasons = F.array_compact(F.array(*[F.when(t, r) for t, r in zip(tests, REASONS)]))
    return out.select("path", "name", reasons.alias("reasons")).filter(F.size("reasons") > 0)


def rules_classes(facts: DataFrame, required: str) -> DataFrame:
    """Classes of each file that derive from ``required`` through classes of that file: (path, name)."""
    c = facts.filter("kind = 'class'").select("path", "name", F.regexp_extract(F.regexp_replace(F.split("detail", ",")[0], "<.*", ""), r"(\w+)$", 1).alias("base"))
    key = lambda n: F.concat_ws("\0", "path", n)
    roots = c.filter(F.col("base") == required).select(key("name").alias("node"))
    down = c.select(key("base").alias("src"), key("name").alias("dst"))
    return reach(down, roots).select(F.substring_index("node", "\0", 1).alias("path"), F.substring_index("node", "\0", -1).alias("name"))


def receiver_types(calls: DataFrame, fields: DataFrame) -> DataFrame:
    """Calls whose receiver is a field, with the receiver replaced by the field's type: (path, name, owner, target)."""
    head, rest = F.substring_index("name", ".", 1), F.regexp_extract("name", r"^[^.]+\.(.*)$", 1)
    f = fields.select("path", F.col("name").alias("head"), F.col("detail").alias("type"))
    out = calls.withColumn("head", head).withColumn("rest", rest).join(f, ["path", "head"], "left")
    return out.select("path", "name", "owner", F.when(F.col("type").isNotNull() & (F.col("rest") != ""), F.concat_ws(".", F.regexp_extract("type", r"(\w+)\W*$", 1), "rest")).otherwise(F.col("name")).alias("target"))


def function_flow(facts: DataFrame, name: str) -> DataFrame:
    """Control statements and calls of one function in source order; empty where it is not found."""
    own = (F.col("owner") == name) | F.endswith("owner", F.lit(f"::{name}"))
    return facts.filter(F.col("kind").isin("control", "call") & own).select("path", "owner", "kind", "name", "line").orderBy("path", "line")


#: Fields of a graph node that are no references of its own.
OWN_FIELDS = (".object_path", ".class_path", ".connections")


def meaningful(references: DataFrame, field: str = "field") -> DataFrame:
    """References without those of structural fields and of anything under connections."""
    return references.filter(~F.contains(field, F.lit(".connections[")) & ~F.exists(F.array(*[F.lit(x) for x in OWN_FIELDS]), lambda s: F.endswith(F.col(field), s)))


# --- modules, plugins and paths -------------------------------------------------------------------


def module_entries(facts: DataFrame, modules: DataFrame, headers: DataFrame) -> DataFrame:
    """Modules (name) with their registration macro (class, module) and the headers of that class: status by counts."""
    arg = lambda k: F.trim(F.get(F.split("detail", ","), F.lit(k)))
    reg = facts.filter(F.col("kind").isin("macro", "call") & F.col("name").rlike("^IMPLEMENT_(PRIMARY_GAME_|GAME_)?MODULE$")).select(arg(0).alias("class"), F.lower(arg(1)).alias("k"), "path", "line")
    found = modules.withColumn("k", F.lower("name")).join(reg.groupBy("k").agg(F.count("*").alias("registrations"), F.min("class").alias("class")), "k", "left").na.fill(0, ["registrations"])
    h = headers.filter("kind = 'type'").groupBy(F.col("name").alias("class")).agg(F.countDistinct("path").alias("headers"), F.min("path").alias("header"))
    out = found.join(h, "class", "left").na.fill(0, ["headers"])
    code = F.when(F.col("registrations") == 0, "module-entry-registration-not-found").when(F.col("registrations") > 1, "module-entry-source-ambiguous").when(F.col("headers") > 1, "module-entry-header-ambiguous")
    return out.select("name", "class", "registrations", F.when(F.col("headers") == 1, F.col("header")).alias("header"), code.alias("code"))


def resolve_plugins(declared: DataFrame, descriptors: DataFrame, platform: str = "Win64", target: str = "Editor", operation: str = "scan", names: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Declared plugins with the descriptor that wins for each and whether they apply, and a problem for each enabled, applicable one that is missing.

    ``declared``: name, enabled, optional and the allow and deny lists; ``descriptors``: path, origin. A missing plugin is a warning where it is optional
    or the operation is a scan, else an error.
    """
    if operation not in ("scan", "resolve"):
        raise ValueError("invalid-operation")
    rows = declared.filter(F.lower("name").isin([n.lower() for n in names])) if names else declared
    c = descriptors.select(F.lower(stem(F.col("path"))).alias("key"), F.col("path").alias("descriptor"), "origin", origin_rank(F.col("origin")).alias("rank"))
    best = overlay_winner(c, ["key"], [F.col("rank"), F.lower("descriptor"), F.col("descriptor")])
    out = rows.withColumn("key", F.lower("name")).join(best, "key", "left").withColumn("applies", applicable(platform, target)).drop("key", "rank")
    gone = out.filter(F.col("enabled") & F.col("applies") & F.col("descriptor").isNull())
    level = F.when(F.col("optional") | F.lit(operation == "scan"), "warning").otherwise("error")
    return out, gone.select(level.alias("severity"), F.lit("plugin-not-found").alias("code"), F.col("name").alias("subject"))


def plugin_closure(roots: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(plugin, depth) of all plugins that ``roots`` (name) need over ``dependencies`` (plugin, needs), by folded name."""
    e = dependencies.select(F.lower("plugin").alias("src"), F.lower("needs").alias("dst"))
    return reach(e, roots.select(F.lower("name").alias("node"))).select(F.col("node").alias("plugin"), "depth")


#: What directories of a project are for, and whether a missing or wrong one matters.
ROLES = {"config": "configuration", "content": "content", "source": "source", "plugins": "plugins", "binaries": "build", "intermediate": "cache", "saved": "cache", "deriveddatacache": "cache", "build": "build", "platforms": "platforms"}


def classify_paths(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Top entries (name, is_dir) of a project with roles, and problems: entries of the wrong type, and directories without a role."""
    role = F.element_at(F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv]), F.lower("name"))
    out = entries.withColumn("role", F.when(F.endswith(F.lower("name"), F.lit(".uproject")), "descriptor").otherwise(role))
    wrong = F.when((F.col("role") == "descriptor") & F.col("is_dir") | F.col("role").isNotNull() & (F.col("role") != "descriptor") & ~F.col("is_dir"), "project-path-type-mismatch")
    code = F.coalesce(wrong, F.when(F.col("role").isNull() & F.col("is_dir"), "unclassified-project-root-directory"))
    level = F.when(wrong.isNotNull() & ~F.col("role").isin("build", "cache"), "error").otherwise("warning")
    return out, out.select(level.alias("severity"), code.alias("code"), F.col("name").alias("subject")).filter("code is not null")


# --- the file graph -----------------------------------------------------------------------------


#: Node kinds by the end of a file's name.
FILE_KINDS = {".uproject": "project_file", ".build.cs": "module_rules_file", ".target.cs": "target_file", ".uplugin": "plugin_file"}


def build(files: DataFrame, plugins: DataFrame, module_refs: DataFrame, includes: DataFrame, entries: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, evidence) of a project's files.

    ``files``: rel path. ``plugins``: source path, name, enabled, line. ``module_refs``: source path, name, kind (DECLARES_MODULE, DEPENDS_ON_MODULE or REFERENCES_MODULE), line.
    ``includes``: source path, target, path (or null), status, line; only resolved, generated and system ones become edges. ``entries``: rules path, source path, line of
    registrations (MODULE_ENTRY). Rules files contain the source files below them that no deeper rules file owns (CONTAINS_FILE); the
    project declares its targets (DECLARES_TARGET). Module and plugin names meet their files by folded name: one candidate resolves, several or none give a synthetic node.
    """
    own = files.filter(~in_skipped(F.col("rel"), SKIPPED_FOLDED, folded=True))
    name = F.lower(leaf(F.col("rel")))
    kind = F.coalesce(*[F.when(F.endswith(name, F.lit(e)), k) for e, k in FILE_KINDS.items()], F.when((source_kind(F.col("rel")) != "other") & ~is_generated(name), "source_file"))
    node = lambda k, key: file_id("node", k, key)
    nodes = own.withColumn("kind", kind).filter("kind is not null").select(node(F.col("kind"), F.col("rel")).alias("node_id"), "kind", F.regexp_extract(leaf(F.col("rel")), r"^([^.]+)", 1).alias("name"), F.col("rel").alias("path"))
    at = nodes.select(F.col("path").alias("source"), F.col("node_id").alias("source_id"))
    of = lambda k: nodes.filter(F.col("kind") == k)

    def bind(refs: DataFrame, kind_: str, outside: str) -> tuple[DataFrame, DataFrame]:
        done = reference_status(refs, of(kind_).select("name", F.col("node_id").alias("id")))
        return done.join(at, "source"), synthetic_nodes(done, outside)

    p, pn = bind(plugins.withColumn("kind", F.when(F.endswith(F.lower("source"), F.lit(".uplugin")), "DEPENDS_ON_PLUGIN").when(F.col("enabled").eqNullSafe(F.lit(True)), "ENABLES_PLUGIN").otherwise("DISABLES_PLUGIN")), "plugin_file", "external_plugin")
    m, mn = bind(module_refs, "module_rules_file", "external_module")
    # synthetic targets are named alike for modules and plugins, so their kind is part of the id
    tag = lambda d, k: d.withColumn("target", F.when(F.col("resolution_status") == "resolved", F.col("target")).otherwise(node(F.lit(k), F.lower("name"))))
    pn, mn = (d.select(node(F.lit(k), F.col("name")).alias("node_id"), "kind", "name") for d, k in ((pn, "external_plugin"), (mn, "external_module")))
    cols = ["source_id", F.col("target").alias("target_id"), "kind", "resolution_status", F.col("source").alias("path"), "line"]
    parts = [tag(p, "external_plugin").select(*cols), tag(m, "external_module").select(*cols)]
    edge = lambda d, s, t, k, path, line: d.select(F.col(s).alias("source_id"), F.col(t).alias("target_id"), F.lit(k).alias("kind"), F.lit("resolved").alias("resolution_status"), path.alias("path"), line.cast("int").alias("line"))
    rules = of("module_rules_file").select(F.col("node_id").alias("rules_id"), F.col("path").alias("rules"), parent(F.col("path")).alias("owner"))
    held = deepest_owner(of("source_file"), rules.withColumnRenamed("owner", "root")).filter("owner is not null").join(rules, "owner")
    parts.append(edge(held, "rules_id", "node_id", "CONTAINS_FILE", F.col("rules"), F.lit(1)))
    home = of("project_file").select(F.col("node_id").alias("project_id"), parent(F.col("path")).alias("home"))
    inside = deepest_owner(of("target_file").withColumn("path", F.concat(F.lit("./"), "path")), home.select(F.when(F.col("home") == "", ".").otherwise(F.concat(F.lit("./"), "home")).alias("root")))
    below = inside.withColumn("home", F.regexp_replace("owner", r"^\./?", "")).join(home, "home").withColumn("path", F.substr("path", F.lit(3)))
    parts.append(edge(below, "project_id", "node_id", "DECLARES_TARGET", F.col("path"), F.lit(1)))
    files_at = of("source_file").select(F.lower("path").alias("folded"), F.col("node_id").alias("hit"))
    if entries is not None:
        told = entries.join(at.withColumnRenamed("source", "rules"), "rules").join(files_at, F.lower("source") == F.col("folded"))
        parts.append(edge(told, "source_id", "hit", "MODULE_ENTRY", F.col("source"), F.col("line")))
    inc = includes.filter(F.col("status").isin("resolved", "generated_header", "system_or_sdk_unresolved")).join(at, "source")
    inc = inc.join(files_at, F.lower("path") == F.col("folded"), "left")
    outside = F.when(F.col("path").isNotNull(), "external_file").otherwise("unresolved_include")
    named = F.coalesce("path", "target")
    inc = inc.withColumn("target_id", F.coalesce("hit", node(outside, named)))
    ext = inc.filter("hit is null").select(F.col("target_id").alias("node_id"), outside.alias("kind"), named.alias("name")).distinct()
    parts.append(inc.select("source_id", "target_id", F.lit("INCLUDES").alias("kind"), F.col("status").alias("resolution_status"), F.col("source").alias("path"), "line"))
    edges = union(parts)
    edges = edges.withColumn("certainty", F.when(F.col("resolution_status") == "ambiguous", "inferred").otherwise("observed")).withColumn("edge_id", file_id("edge", F.col("source_id"), F.col("kind"), F.col("target_id"), F.col("resolution_status")))
    none = lambda d: d.withColumn("path", F.lit(None).cast("string")).select("node_id", "kind", "name", "path")
    every = nodes.unionByName(none(pn)).unionByName(none(mn)).unionByName(none(ext)).dropDuplicates(["node_id"])
    evidence = edges.select(file_id("evidence", F.col("edge_id"), F.col("path"), F.col("line")).alias("evidence_id"), "edge_id", "path", "line").distinct()
    return every, edges.select("edge_id", "source_id", "target_id", "kind", "certainty", "resolution_status").distinct(), evidence
