"""Resolution of names to candidates: ranked, counted, scoped, by prefix and by pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranks of where a declaration comes from.
ORIGIN_RANK = {"project": 0, "platform": 1, "mods": 2, "additional": 3, "engine": 10, "engine_plugin": 11}


def origin_rank(origin: Column) -> Column:
    out = F.lit(99)
    for name, rank in ORIGIN_RANK.items():
        out = F.when(origin == name, rank).otherwise(out)
    return out


def overlay(candidates: DataFrame, key: str = "name", rank: str = "rank", path: str = "path") -> DataFrame:
    """The best candidate of each folded key by (rank, folded path), and the paths of the rest in that order."""
    order = F.struct(F.col(rank).alias("r"), F.lower(F.col(path)).alias("f"), F.col(path).alias("p"))
    folded = candidates.groupBy(F.lower(F.col(key)).alias("key")).agg(F.array_sort(F.collect_list(order)).alias("all"))
    return folded.select("key", F.col("all")[0]["r"].alias("rank"), F.col("all")[0]["p"].alias("path"), F.transform(F.slice("all", 2, F.size("all")), lambda x: x["p"]).alias("alternates"))


def overlay_winner(candidates: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Top candidate of each key; ranks are limited within each task before the shuffle."""
    return candidates.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__r = 1").drop("__r")


def reference_status(references: DataFrame, candidates: DataFrame, name: str = "name") -> DataFrame:
    """References with the number of candidates of their folded name: resolved (1), ambiguous (more), external (none).

    The target of a resolved reference is its candidate's id; the others get a synthetic one by name.
    """
    counted = candidates.groupBy(F.lower(F.col(name)).alias("k")).agg(F.count("*").alias("candidates"), F.min("id").alias("id"))
    out = references.join(counted, F.lower(references[name]) == F.col("k"), "left").drop("k").na.fill(0, ["candidates"])
    state = F.when(F.col("candidates") == 1, "resolved").when(F.col("candidates") > 1, "ambiguous").otherwise("external")
    return out.withColumn("resolution_status", state).withColumn("target", F.when(F.col("candidates") == 1, F.col("id").cast("string")).otherwise(F.concat(F.lit("external:"), F.lower(F.col(name))))).drop("id")


def synthetic_nodes(resolved: DataFrame, kind: str = "external_module") -> DataFrame:
    return resolved.filter("resolution_status <> 'resolved'").select(F.col("target").alias("node_id"), F.lit(kind).alias("kind"), F.lower("name").alias("name")).distinct()


def reconcile(declared: DataFrame, rules: DataFrame, name: str = "name") -> DataFrame:
    """Declarations against rule files by folded name: (key, declared, rules, status)."""
    a = declared.groupBy(F.lower(F.col(name)).alias("key")).agg(F.count("*").alias("declared"))
    b = rules.groupBy(F.lower(F.col(name)).alias("key")).agg(F.count("*").alias("rules"))
    both = a.join(b, "key", "full_outer").na.fill(0, ["declared", "rules"])
    state = (
        F.when(F.col("declared") > 1, "duplicate").when(F.col("declared") == 0, "undeclared").when(F.col("rules") == 0, "missing").when(F.col("rules") > 1, "ambiguous").otherwise("resolved")
    )
    return both.withColumn("status", state)


def deepest_owner(paths: DataFrame, owners: DataFrame, path: str = "path", root: str = "root") -> DataFrame:
    """Each path with the longest ``root`` that holds it: ancestors are exploded and joined by equality, never by prefix test."""
    parts = F.split(F.col(path), "/")
    up = paths.select(path).distinct().withColumn("n", F.explode(F.sequence(F.lit(1), F.size(parts)))).withColumn("dir", F.array_join(F.slice(parts, F.lit(1), F.col("n")), "/"))
    held = up.join(owners.select(F.col(root).alias("dir")).distinct(), "dir")
    best = held.groupBy(path).agg(F.max_by("dir", "n").alias("owner"))
    return paths.join(best, path, "left")


def include_candidates(includes: DataFrame, roots: DataFrame, files: DataFrame) -> DataFrame:
    """Includes (source, dir, target) with how many distinct existing files they can mean: beside the source, or below
    a module root or its Public, Private and Classes folders."""
    own = includes.select("source", "target", F.concat_ws("/", "dir", "target").alias("path"))
    suffixes = F.array(F.lit(""), F.lit("/Public"), F.lit("/Private"), F.lit("/Classes"))
    base = roots.select(F.explode(F.transform(suffixes, lambda s: F.concat(F.col("root"), s))).alias("base"))
    # a file lies below few roots, so files are cut at their roots and joined by what remains
    below = deepest_pairs(files, base).select(F.col("rest").alias("target"), "path")
    found = own.join(files.select("path"), "path", "left_semi").select("source", "target", "path").unionByName(includes.select("source", "target").join(below, "target").select("source", "target", "path"))
    counted = found.distinct().groupBy("source", "target").agg(F.count("*").alias("candidates"), F.min("path").alias("path"))
    out = includes.select("source", "target").distinct().join(counted, ["source", "target"], "left").na.fill(0, ["candidates"])
    return out.withColumn("status", F.when(F.col("candidates") == 1, "resolved").when(F.col("candidates") > 1, "ambiguous").when(F.endswith("target", F.lit(".generated.h")), "generated_header").otherwise("system_or_sdk_unresolved"))


def deepest_pairs(files: DataFrame, bases: DataFrame) -> DataFrame:
    """(path, base, rest) for each base directory above each file."""
    parts = F.split(F.col("path"), "/")
    up = files.select("path").withColumn("n", F.explode(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))))).withColumn("base", F.array_join(F.slice(parts, F.lit(1), F.col("n")), "/"))
    return up.join(bases.distinct(), "base").select("path", "base", F.array_join(F.slice(parts, F.col("n") + 1, F.size(parts)), "/").alias("rest"))


def pairing(edges: DataFrame, left: str = "header", right: str = "source") -> DataFrame:
    """Companion edges that are alone on both sides: exact pairs."""
    edges = edges.select(left, right).distinct()
    l1 = edges.groupBy(left).agg(F.count("*").alias("a")).filter("a = 1").select(left)
    r1 = edges.groupBy(right).agg(F.count("*").alias("b")).filter("b = 1").select(right)
    return edges.join(l1, left, "left_semi").join(r1, right, "left_semi")


def pair_leftovers(files: DataFrame, edges: DataFrame, left: str = "header", right: str = "source") -> DataFrame:
    """Files (path, side) without any companion edge; ambiguous ones are not leftovers."""
    used = edges.select(F.col(left).alias("path")).unionByName(edges.select(F.col(right).alias("path"))).distinct()
    return files.join(used, "path", "left_anti")


def applicable(platform: str, target: str) -> Column:
    """Whether allow and deny lists let a declaration apply; an empty or absent list is no constraint, and the platform list falls back
    to the supported platforms."""
    none = lambda c: F.coalesce(F.size(c) <= 0, F.lit(True))
    has = lambda c, v: F.coalesce(F.array_contains(c, v), F.lit(False))
    allow = F.when(none(F.col("platform_allow")), F.col("supported_platforms")).otherwise(F.col("platform_allow"))
    return (none(allow) | has(allow, platform)) & ~has(F.col("platform_deny"), platform) & (none(F.col("target_allow")) | has(F.col("target_allow"), target)) & ~has(F.col("target_deny"), target)


def declaration_relation(rows: DataFrame, key: str = "usr") -> DataFrame:
    """Per callable: declarations in headers (d), definitions in sources (s) and in headers (i), and their relation."""
    c = rows.groupBy(key).agg(*[F.count_if(F.col("role") == r).alias(n) for r, n in (("declaration", "declarations"), ("definition", "definitions"), ("inline", "inlines"))])
    state = (
        F.when((F.col("definitions") + F.col("inlines") > 1) | (F.col("declarations") > 1), "ambiguous")
        .when((F.col("declarations") == 1) & (F.col("definitions") == 1), "matched")
        .when(F.col("inlines") == 1, "inline_definition")
        .when(F.col("definitions") == 1, "source_only")
        .otherwise("declaration_only")
    )
    return c.withColumn("status", state)


def scoped(uses: DataFrame, types: DataFrame) -> DataFrame:
    """Uses (use_id, scope, expression, perhaps text) resolved to a type's qualified name.

    A qualified name written out wins, in ``text`` where it is given (if it is the only one of the short name ``expression`` there), else as the whole expression; then
    the enclosing scopes from inner to outer; then a short name that only one type has.
    """
    known = types.select("qualified").distinct().withColumn("short", F.substring_index("qualified", "::", -1))
    if "text" in uses.columns:
        of = uses.join(known.filter(F.contains("qualified", F.lit("::"))), F.col("expression") == F.col("short"))
        written = of.filter(F.rlike("text", F.concat(F.lit(r"(?<!\w)\Q"), "qualified", F.lit(r"\E(?!\w)"))))
        direct = written.groupBy("use_id").agg(F.count("*").alias("c"), F.min("qualified").alias("qualified")).filter("c = 1").select("use_id", F.lit(0).alias("rank"), "qualified")
    else:
        direct = uses.join(known, F.col("expression") == F.col("qualified")).select("use_id", F.lit(0).alias("rank"), "qualified")
    parts = F.split("scope", "::")
    scopes = uses.withColumn("n", F.explode(F.sequence(F.size(parts), F.lit(1), F.lit(-1)))).select("use_id", "n", F.concat_ws("::", F.array_join(F.slice(parts, F.lit(1), F.col("n")), "::"), "expression").alias("qualified"), F.size(parts).alias("m"))
    inner = scopes.join(known, "qualified").select("use_id", (F.col("m") - F.col("n") + 1).alias("rank"), "qualified")
    single = known.groupBy("short").agg(F.count("*").alias("c"), F.min("qualified").alias("qualified")).filter("c = 1")
    short = uses.join(single, F.col("expression") == F.col("short")).select("use_id", F.lit(1000).alias("rank"), "qualified")
    best = direct.unionByName(inner).unionByName(short).groupBy("use_id").agg(F.min_by("qualified", "rank").alias("qualified"))
    return uses.join(best, "use_id", "left")


def select_symbol(names: DataFrame, symbol: str, sep: str = "::") -> DataFrame:
    """(status, name, matches): an exact name, else the only one that ends in the symbol, else ambiguous or not_found."""
    hit = names.select(F.when(F.col("name") == symbol, 0).when(F.endswith("name", F.lit(f"{sep}{symbol}")), 1).alias("r"), "name").filter("r is not null")
    c = hit.agg(F.count_if(F.col("r") == 0).alias("e"), F.count("*").alias("matches"), F.min(F.when(F.col("r") == 0, F.col("name"))).alias("x"), F.min("name").alias("m"))
    return c.select(F.when(F.col("e") > 0, "exact").when(F.col("matches") == 1, "suffix").when(F.col("matches") > 1, "ambiguous").otherwise("not_found").alias("status"), F.when(F.col("e") > 0, F.col("x")).when(F.col("matches") == 1, F.col("m")).alias("name"), "matches")


def unique_values(rows: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """Names with one distinct value; a constant with several is of no use."""
    return rows.groupBy(name).agg(F.min(value).alias("lo"), F.max(value).alias("hi")).filter("lo = hi").select(name, F.col("lo").alias(value))


def property_delta(observed: DataFrame, baseline: DataFrame | None, key: list[str], value: str = "value") -> DataFrame:
    """Observed properties with their comparison to the baseline's value of the same key; ``has_baseline`` rows must exist for an owner."""
    if baseline is None:
        return observed.withColumn("comparison", F.lit("baseline_unavailable"))
    base = baseline.select(*key, F.col(value).alias("__b"), F.lit(True).alias("__h"))
    state = F.when(F.col("__h").isNull(), "baseline_property_missing").when(F.col(value).eqNullSafe(F.col("__b")), "matches_default").otherwise("differs_from_default")
    return observed.join(base, key, "left").withColumn("comparison", state).drop("__b", "__h")


def deltas_only(compared: DataFrame) -> DataFrame:
    return compared.filter(~F.col("comparison").isin("matches_default", "baseline_unavailable"))


def call_targets(calls: DataFrame, methods: DataFrame, functions: DataFrame) -> DataFrame:
    """Calls (call_id, owner_type, namespace, name) bound to a method of the owner's type, else a free function of the namespace, else unknown."""
    m = methods.select(F.col("owner").alias("owner_type"), "name", F.col("id").alias("method_id"))
    f = functions.select("namespace", "name", F.col("id").alias("function_id"))
    out = calls.join(m, ["owner_type", "name"], "left").join(f, ["namespace", "name"], "left")
    return out.select("call_id", F.coalesce("method_id", "function_id").alias("target"), F.when(F.col("method_id").isNotNull(), "method").when(F.col("function_id").isNotNull(), "function").otherwise("unknown").alias("kind"))


def adjacent_markers(lines: DataFrame, is_marker: Column, is_target: Column, doc: str = "doc_id", line: str = "line", text: str = "text") -> DataFrame:
    """Markers directly above a target with only blank lines between, chained upwards: (doc, marker_line, target_line)."""
    told = lines.filter(~F.col(text).rlike(r"^\s*$")).withColumn("__m", is_marker & ~is_target).withColumn("__t", is_target)
    w = Window.partitionBy(doc).orderBy(line)
    run = told.withColumn("__next", F.first(F.when(~F.col("__m"), F.struct(F.col(line).alias("l"), F.col("__t").alias("t"))), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    return run.filter("__m and __next.t").select(doc, F.col(line).alias("marker_line"), F.col("__next.l").alias("target_line"))


def declared_files(declared: DataFrame, project: DataFrame, engine: DataFrame, name: str = "name") -> DataFrame:
    """Declared names looked up among project files first and, only where none is there, among engine files."""
    key = F.lower(F.col(name)).alias("k")
    p = project.groupBy(key).agg(F.count("*").alias("in_project"))
    e = engine.groupBy(key).agg(F.count("*").alias("in_engine"))
    out = declared.withColumn("k", F.lower(F.col(name))).join(p, "k", "left").join(e, "k", "left").drop("k").na.fill(0, ["in_project", "in_engine"])
    return out.withColumn("found", F.when(F.col("in_project") > 0, "project").when(F.col("in_engine") > 0, "engine").otherwise("missing"))
