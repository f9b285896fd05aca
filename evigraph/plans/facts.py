"""Queries of sources, functions and adapters: facts are made from the driver's tables by SQL that both engines read alike.

``_rows`` runs such SQL in Spark, with ``{table}`` for a table; ``_sql`` is the same text for the oracle.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids, values
from ..functions import text as t
from ..operators import closure, connections, filegraph, graph, knowledge, messages, resolve, upsert
from ..sources import code, descriptors, editor, files, ini
from . import adapters as a

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _rows(spark, sf: str, sql: str) -> DataFrame:
    return spark.sql(re.sub(r"\{(\w+)\}", lambda m: f"parquet.`{sf}/{m[1]}.parquet`", sql))


def _sql(sql: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def _joined(c, sep: str = ";"):
    return F.array_join(F.transform(c, lambda x: F.concat_ws(" ", x["kind"], x["target"])), sep)


# --- configuration ------------------------------------------------------------------------------

_NL = "chr(10)"
_INI = f"SELECT CAST(p_partkey AS STRING) AS path, '[' || p_brand || ']' || {_NL} || '; note' || {_NL} || '+Paths=' || p_name || {_NL} || '  Key' || p_size || ' = \"' || p_type || '\"' || {_NL} || {_NL} || '[ T.' || p_size || ' ]' || {_NL} || '-Gone=x=y' || {_NL} || '!Clear=' || {_NL} || 'no declaration' || {_NL} || '.Dot=1' AS text FROM {{part}}"


@query(
    """SELECT CAST(p_partkey AS VARCHAR) AS file, line, section, operator, key, value FROM (
SELECT p_partkey, 3 AS line, p_brand AS section, '+' AS operator, 'Paths' AS key, p_name AS value FROM part UNION ALL SELECT p_partkey, 4, p_brand, 'set', 'Key' || p_size, '"' || p_type || '"' FROM part
UNION ALL SELECT p_partkey, 7, 'T.' || p_size, '-', 'Gone', 'x=y' FROM part UNION ALL SELECT p_partkey, 8, 'T.' || p_size, '!', 'Clear', '' FROM part UNION ALL SELECT p_partkey, 10, 'T.' || p_size, '.', 'Dot', '1' FROM part)"""
)
def ini_declarations(spark, sf):
    return ini.parse(_rows(spark, sf, _INI))


@query("SELECT p_partkey, p_partkey % 4 = 0 AS found FROM part")
def ini_files(spark, sf):
    x = _rows(spark, sf, "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Config/' WHEN 1 THEN 'Plugins/Saved/' WHEN 2 THEN 'Source/' ELSE 'Platforms/x' END || p_partkey || CASE WHEN p_partkey % 4 = 3 THEN '.txt' ELSE '.INI' END AS rel FROM {part}")
    found = ini.ini_files(x).select("p_partkey", F.lit(True).alias("f"))
    return x.select("p_partkey").join(found, "p_partkey", "left").select("p_partkey", F.coalesce("f", F.lit(False)).alias("found"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'gameplay_tag A.' || p_type WHEN p_size % 3 = 1 THEN 'asset /Game/X.' || p_type ELSE '' END AS refs FROM part")
def ini_references(spark, sf):
    x = _rows(spark, sf, "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'My.Tags' ELSE 'Other' END AS section, 'K' AS key, CASE WHEN p_size % 3 = 1 THEN '/Game/X.' || p_type ELSE '\"A.' || p_type || '\"' END AS value FROM {part}")
    return ini.declaration_references(x).select("p_partkey", _joined("references").alias("refs"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS file, 'T' || p_size AS type, '/Script/M.' || p_type AS base, p_size % 2 = 0 AS blueprints, '/Game/' || p_size AS directories, '/Game/A.' || p_type AS assets, CAST(p_size AS VARCHAR) AS priority FROM part WHERE p_size % 5 <> 0")
def ini_primary_assets(spark, sf):
    x = _rows(spark, sf, "SELECT CAST(p_partkey AS STRING) AS file, 1 AS line, '/Script/Engine.' || CASE WHEN p_size % 5 = 0 THEN 'Other' ELSE 'AssetManagerSettings' END AS section, '+' AS operator, 'PrimaryAssetTypesToScan' AS key, '(PrimaryAssetType=\"T' || p_size || '\",AssetBaseClass=/Script/M.' || p_type || ',bHasBlueprintClasses=' || CASE WHEN p_size % 2 = 0 THEN 'True' ELSE 'False' END || ',Directories=((Path=\"/Game/' || p_size || '\")),SpecificAssets=(/Game/A.' || p_type || '),Rules=(Priority=' || p_size || '))' AS value FROM {part}")
    r = ini.primary_asset_types(x)
    return r.select("file", F.col("primary_asset_type").alias("type"), F.col("asset_base_class").alias("base"), F.col("has_blueprint_classes").alias("blueprints"), F.array_join("directories", ",").alias("directories"), F.array_join("specific_assets", ",").alias("assets"), F.col("rules")["Priority"].alias("priority"))


# --- documents ----------------------------------------------------------------------------------


@query("SELECT event_id, CASE WHEN user_id % 2 = 0 THEN '{\"a\": 7, \"b\": [1, 2], \"u\": \"http://x\"}' ELSE '{\"a\": ' || event_id || ', \"b\": [1, 2], \"u\": \"http://x\"}' END AS document, CASE WHEN user_id % 2 = 0 THEN '/a 2' ELSE '' END AS duplicates FROM events")
def json_relaxed(spark, sf):
    x = _rows(spark, sf, "SELECT event_id, encode('{\"a\": ' || event_id || ', // note' || chr(10) || '\"b\": [1, 2,], /* x */ \"u\": \"http://x\",' || CASE WHEN user_id % 2 = 0 THEN '\"a\": 7,' ELSE '' END || '}', 'utf-8') AS content FROM {events}")
    r = files.read_json(x, relaxed=True)
    return r.select("event_id", "document", F.array_join(F.transform("duplicates", lambda d: F.concat_ws(" ", d["pointer"], d["count"].cast("string"))), ",").alias("duplicates"))


@query("SELECT event_id, event_id % 4 = 0 AS good FROM events")
def json_strict(spark, sf):
    x = _rows(spark, sf, "SELECT event_id, encode(CASE event_id % 4 WHEN 0 THEN '{\"a\": 1}' WHEN 1 THEN '{\"a\": 1, \"a\": 2}' WHEN 2 THEN '{\"a\": NaN}' ELSE '[1]' END, 'utf-8') AS content FROM {events}")
    return files.read_json(x).select("event_id", F.col("error").isNull().alias("good"))


@query("SELECT event_id, '{\"a\":\"é' || event_type || '\",\"b\":{\"c\":[1],\"d\":' || user_id || '}}' AS document FROM events")
def json_canonical(spark, sf):
    return _rows(spark, sf, "SELECT event_id, '{\"b\": {\"d\": ' || user_id || ', \"c\": [1]}, \"a\": \"é' || event_type || '\"}' AS d FROM {events}").select("event_id", ids.canonical_json("d").alias("document"))


_MODULES = "SELECT CAST(p_partkey AS STRING) AS path, '{\"FileVersion\": ' || CASE WHEN p_partkey % 3 = 0 THEN '\"3\"' ELSE '3' END || ', \"Modules\": [{\"Name\": \"A\", \"Type\": \"' || CASE WHEN p_partkey % 2 = 0 THEN 'Runtime' ELSE 'Odd' END || '\"}, {\"Name\": \"' || CASE WHEN p_partkey % 5 = 0 THEN 'a' ELSE 'B' END || '\", \"Type\": \"Editor\", \"LoadingPhase\": \"Late\"}, 5], \"Plugins\": [{\"Name\": \"P\", \"Enabled\": true, \"TargetAllowList\": [\"Game\", \"X\"]}, {\"Name\": \"p\"}, {}]}' AS document FROM {part}"


@query(
    """WITH x AS (SELECT CAST(p_partkey AS VARCHAR) AS path, p_partkey AS k FROM part)
SELECT path, 'error' AS severity, 'invalid-plugin-module' AS code, '/Modules/2' AS pointer FROM x UNION ALL SELECT path, 'error', 'invalid-plugin-module-enum-value', '/Modules/0/Type' FROM x WHERE k % 2 = 1
UNION ALL SELECT path, 'error', 'invalid-plugin-module-enum-value', '/Modules/1/LoadingPhase' FROM x UNION ALL SELECT path, 'error', 'duplicate-module-declaration', '/Modules/0/Name' FROM x WHERE k % 5 = 0"""
)
def descriptor_modules(spark, sf):
    return descriptors.modules(_rows(spark, sf, _MODULES))[1]


@query("WITH x AS (SELECT CAST(p_partkey AS VARCHAR) AS path FROM part) SELECT path, 0 AS i, 'P' AS name, true AS enabled, false AS optional FROM x UNION ALL SELECT path, 1, 'p', false, false FROM x")
def descriptor_plugins(spark, sf):
    return descriptors.plugin_references(_rows(spark, sf, _MODULES))[0]


@query("WITH x AS (SELECT CAST(p_partkey AS VARCHAR) AS path, p_partkey AS k FROM part) SELECT path, 'invalid-field-type' AS code, '/FileVersion' AS pointer FROM x WHERE k % 3 = 0 UNION ALL SELECT path, 'list', '/Plugins/0/TargetAllowList/1' FROM x")
def descriptor_fields(spark, sf):
    d = _rows(spark, sf, _MODULES)
    wrong = descriptors.field_types(d, {"FileVersion": "BIGINT", "Modules": "ARRAY"}).unionByName(descriptors.enum_arrays(d, "Plugins", "TargetAllowList", descriptors.TARGET_TYPES, "list"))
    return wrong.select("path", "code", "pointer")


@query("SELECT p_size AS major, p_size + 1 AS minor, count(*) AS n FROM part GROUP BY 1, 2")
def engine_version(spark, sf):
    d = _rows(spark, sf, "SELECT '{\"MajorVersion\": ' || p_size || ', \"MinorVersion\": ' || (p_size + 1) || ', \"BranchName\": \"b\"}' AS document FROM {part}")
    return files.engine_version(d).groupBy("major", "minor").agg(F.count("*").alias("n"))


_ENGINES = "SELECT CASE s_suppkey % 4 WHEN 0 THEN 'ancestor' WHEN 1 THEN 'registry' WHEN 2 THEN 'path' ELSE 'override' END AS source, 'e' || s_suppkey AS path, s_suppkey = 5 OR s_suppkey = 8 AS exists FROM {supplier}"


@query("SELECT 'resolved' AS status, 'registry' AS source, 'e5' AS path")
def resolve_engine(spark, sf):
    return files.resolve_engine(_rows(spark, sf, _ENGINES))


_TREE = "SELECT CASE n_nationkey % 3 WHEN 0 THEN 'M' || n_nationkey || '.Build.cs' WHEN 1 THEN 'P' || n_nationkey || '.uplugin' ELSE 'x.h' END AS path FROM {nation} UNION ALL SELECT 'Game.UPROJECT' FROM {region} WHERE r_regionkey = 0"


@query("SELECT 'resolved' AS status, 1 AS count, 'Game.UPROJECT' AS path, NULL AS code UNION ALL SELECT 'module', 1, 'M6.Build.cs', NULL UNION ALL SELECT 'plugin', 0, NULL, 'build-descriptor-not-found'")
def find_descriptors(spark, sf):
    x = _rows(spark, sf, _TREE)
    project = files.find_projects(x).withColumn("code", F.lit(None).cast("string"))
    asked = [files.find_build_descriptor(x, **{k: v}).withColumn("status", F.lit(k)) for k, v in (("module", "m6"), ("plugin", "none"))]
    return upsert.union([project, *asked]).select("status", "count", "path", "code")


# --- scalar functions ------------------------------------------------------------------------------


@query("SELECT event_id, 'node:' || substr(sha256('[\"P|k|' || event_type || '\",\"a\\\"b\",null]'), 1, 32) AS node, 'tag:' || sha256('[\"tag\",\"' || event_type || '\"]') AS tag FROM events")
def logical_ids(spark, sf):
    e = a.read(spark, sf, "events")
    return e.select("event_id", ids.logical_id("node", F.concat(F.lit("P|k|"), "event_type"), F.lit('a"b'), F.lit(None).cast("string")).alias("node"), ids.message_id("tag", F.col("event_type")).alias("tag"))


@query("SELECT p_partkey, p_type || '.Build.CS' AS leaf, p_type || '.Build' AS stem, '.cs' AS suffix, 'C:/x/' || p_brand AS parent, p_brand || '/' || p_type || '.Build.CS' AS relative FROM part")
def path_parts(spark, sf):
    p = F.col("p")
    x = a.read(spark, sf, "part").select("p_partkey", F.concat(F.lit("C:\\x\\"), "p_brand", F.lit("\\"), "p_type", F.lit(".Build.CS")).alias("p"))
    return x.select("p_partkey", t.leaf(p).alias("leaf"), t.stem(p).alias("stem"), t.suffix(p).alias("suffix"), t.parent(p).alias("parent"), t.relative(p, F.lit("C:\\x\\")).alias("relative"))


@query("SELECT p_partkey, '/Game/' || p_type || '.X_C' AS path FROM part")
def object_paths(spark, sf):
    k = F.col("p_partkey") % 3
    body = F.concat(F.lit("/Game/"), "p_type", F.lit(".X_C"))
    v = F.when(k == 0, F.concat(F.lit("BlueprintGeneratedClass'"), body, F.lit("'"))).when(k == 1, F.concat(F.lit(' "'), F.replace(body, F.lit("/"), F.lit("\\")), F.lit('"'))).otherwise(body)
    return a.read(spark, sf, "part").select("p_partkey", t.object_path(v).alias("path"))


@query("SELECT event_id, '{\"entries\":[{\"key\":{\"kind\":\"string\",\"value\":\"a\"},\"value\":{\"kind\":\"boolean\",\"value\":true}},{\"key\":{\"kind\":\"string\",\"value\":\"k\"},\"value\":{\"kind\":\"integer\",\"value\":' || user_id || '}}],\"kind\":\"map\",\"truncated_count\":0}' AS tagged FROM events")
def tagged_values(spark, sf):
    return _rows(spark, sf, "SELECT event_id, '{\"a\": true, \"k\": ' || user_id || '}' AS v FROM {events}").select("event_id", values.tag_json("v").alias("tagged"))


@query("SELECT event_id, 'gameplay_tag T.' || event_type || ' t[0];object /Game/A.A:S' || user_id || ' p.path;primary_asset Map:' || user_id || ' i' AS refs FROM events")
def typed_references(spark, sf):
    x = _rows(spark, sf, "SELECT event_id, '{\"p\": {\"kind\": \"object\", \"path\": \"/Game/A.A:S' || user_id || '\"}, \"t\": [{\"kind\": \"gameplay_tag\", \"tag\": \"T.' || event_type || '\"}], \"i\": {\"kind\": \"primary_asset_id\", \"id\": \"Map:' || user_id || '\"}}' AS v FROM {events}")
    return x.select("event_id", F.array_join(F.transform(values.json_typed_references("v"), lambda r: F.concat_ws(" ", r["kind"], r["target"], r["field"])), ";").alias("refs"))


@query("SELECT event_id, 'asset /Game/X.X' || user_id || ' a[1].b' AS refs FROM events")
def nested_references(spark, sf):
    x = _rows(spark, sf, "SELECT event_id, '{\"a\": [1, {\"b\": \"/Game/X.X' || user_id || '\"}], \"c\": {\"connections\": [\"/Game/Y.Y\"]}, \"z\": {\"class_path\": \"/Script/M.N\"}}' AS v FROM {events}")
    refs = x.select("event_id", F.explode(values.json_references("v")).alias("r")).select("event_id", "r.*")
    return filegraph.meaningful(refs.withColumn("field", F.replace("field", F.lit("connections["), F.lit(".connections[")))).groupBy("event_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "kind", "target", "field"))), ";").alias("refs"))


@query("SELECT p_partkey, 'N::T' || p_size || '<int>' AS clean, 'N::T' || p_size AS primary FROM part")
def clean_types(spark, sf):
    e = F.concat(F.lit("const  N::T"), F.col("p_size").cast("string"), F.lit("<int> & "))
    return a.read(spark, sf, "part").select("p_partkey", t.clean_type(e).alias("clean"), t.primary_type(e).alias("primary"))


@query("SELECT p_partkey, 'A' || p_size || '|F(b, c)|\"x,' || p_type || '\"|T<a,b>' AS arguments FROM part")
def macro_arguments(spark, sf):
    x = _rows(spark, sf, "SELECT p_partkey, 'A' || p_size || ', F(b, c), \"x,' || p_type || '\", T<a,b>' AS v FROM {part}")
    return x.select("p_partkey", F.array_join(t.macro_arguments("v"), "|").alias("arguments"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'public_dependency PublicDependencyModuleNames AddRange' WHEN 1 THEN 'iwyu bEnforceIWYU assign' WHEN 2 THEN 'private_definition PrivateDefinitions assign' END AS note FROM part")
def rule_annotations(spark, sf):
    k = F.col("p_partkey") % 4
    target = F.when(k == 0, "PublicDependencyModuleNames.AddRange").when(k == 1, "this.bEnforceIWYU").when(k == 2, "PrivateDefinitions").otherwise("Names.Add")
    note = t.rule_annotation(F.when(k.isin(1, 2), "assign").otherwise("call"), target)
    return a.read(spark, sf, "part").select("p_partkey", F.when(note.isNotNull(), F.concat_ws(" ", note["kind"], note["member"], note["action"])).alias("note"))


@query("SELECT p_partkey, 'a~1' || p_type || '~0' AS pointer, 'a\\%' || p_type || '\\_\\\\' AS pattern, p_size AS minor, 'strasse ' || lower(p_name) AS folded FROM part")
def escapes(spark, sf):
    x = a.read(spark, sf, "part")
    c = lambda b, e: F.concat(F.lit(b), "p_type", F.lit(e))
    return x.select("p_partkey", t.pointer_escape(c("a/", "~")).alias("pointer"), t.like_escape(c("a%", "_\\")).alias("pattern"), t.version(F.concat(F.lit("UE 5."), F.col("p_size").cast("string"), F.lit(".1-x")))["minor"].alias("minor"), ids.full_fold(F.concat(F.lit("STRAßE "), F.upper("p_name"))).alias("folded"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'publish On' || event_type || ' UOwner ' WHEN 1 THEN 'subscribe On' || event_type || ' UComp UA::Go' WHEN 2 THEN 'subscribe Subs UOwner ' END AS operation FROM events")
def delegate_operations(spark, sf):
    k = F.col("event_id") % 4
    on = F.concat(F.lit("On"), "event_type")
    callee = F.when(k == 0, F.concat(on, F.lit(".Broadcast"))).when(k == 1, F.concat(F.lit("Comp."), on, F.lit(".AddDynamic"))).when(k == 2, "Subs.ListenTo").otherwise(F.concat(on, F.lit(".RemoveAll")))
    o = t.delegate_operation(callee, F.when(k == 1, "this, &UA::Go").otherwise("x"), F.lit("N::UOwner"), F.create_map(F.lit("Comp"), F.lit("N::UComp*")))
    return a.read(spark, sf, "events").select("event_id", F.when(o.isNotNull(), F.concat(o["operation"], F.lit(" "), o["event"], F.lit(" "), o["owner_type"], F.lit(" "), F.coalesce(o["callback"], F.lit("")))).alias("operation"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'static' WHEN event_id % 3 = 1 THEN 'static' ELSE 'unresolved' END AS status, CASE WHEN event_id % 3 = 0 THEN 'A.' || event_type WHEN event_id % 3 = 1 THEN 'X.Y' END AS tag FROM events")
def code_channels(spark, sf):
    k = F.col("event_id") % 3
    e = F.when(k == 0, F.concat(F.lit('Get("A.'), "event_type", F.lit('")'))).when(k == 1, "&N::Tag").otherwise(F.col("event_type"))
    return a.read(spark, sf, "events").select("event_id", messages.channel_of(e, F.create_map(F.lit("Tag"), F.lit("X.Y"))).alias("c")).select("event_id", "c.status", "c.tag")


# --- editor facts ----------------------------------------------------------------------------------


@query("SELECT 'P' || (p_partkey % 50) AS package, count(*) AS n, string_agg('O' || p_partkey || ' ' || p_brand, ',' ORDER BY 'O' || p_partkey) AS assets FROM part WHERE p_type = 'ECONOMY' GROUP BY 1")
def asset_inventory(spark, sf):
    x = _rows(spark, sf, "SELECT 'P' || (p_partkey % 50) AS package, 'O' || p_partkey AS object_path, '/Script/X.' || p_type AS class, p_brand AS b FROM {part}").withColumn("tags", F.create_map(F.lit("ParentClass"), F.col("b"), F.lit("Else"), F.lit("no"), F.lit("RowStructure"), F.lit("")))
    r = editor.inventory(x, ["economy"])
    return r.select("package", F.size("assets").cast("long").alias("n"), F.array_join(F.transform("assets", lambda s: F.concat(s["object_path"], F.lit(" "), F.get_json_object(s["registry_tags"], "$.ParentClass"))), ",").alias("assets"))


_DEPS = "SELECT 'A' || l_orderkey AS package, CASE l_returnflag WHEN 'N' THEN 'hard_package' WHEN 'R' THEN 'soft_package' ELSE 'searchable_name' END AS kind, 'B' || l_partkey AS target FROM {lineitem}"


@query(f"WITH d AS (SELECT DISTINCT * FROM ({_sql(_DEPS)})) SELECT package, string_agg(target, ',' ORDER BY target) FILTER (WHERE kind = 'hard_package') AS hard, string_agg(target, ',' ORDER BY target) FILTER (WHERE kind = 'soft_package') AS soft, string_agg(target, ',' ORDER BY target) FILTER (WHERE kind = 'searchable_name') AS named FROM d GROUP BY 1")
def asset_dependencies(spark, sf):
    r = editor.dependencies(_rows(spark, sf, _DEPS))
    show = lambda c: F.when(F.size(c) > 0, F.array_join(c, ","))
    return r.select("package", show("hard_package").alias("hard"), show("soft_package").alias("soft"), show("searchable_name").alias("named"))


@query(f"WITH d AS ({_sql(_DEPS)}) SELECT package, kind, count(*) AS n, CASE WHEN kind <> 'soft_package' THEN string_agg(DISTINCT target, ',' ORDER BY target) ELSE '' END AS targets FROM d GROUP BY 1, 2")
def registry_counts(spark, sf):
    return editor.registry_counts(_rows(spark, sf, _DEPS), ["soft_package"]).select("package", "kind", "n", F.array_join("targets", ",").alias("targets"))


@query("SELECT 'T' || p_partkey AS asset, CASE WHEN p_partkey % 3 = 0 THEN 'r' || p_size ELSE '0' END AS name, 'asset /Game/A.' || p_type AS refs FROM part UNION ALL SELECT 'T' || p_partkey, 'second', '' FROM part")
def data_table_rows(spark, sf):
    x = _rows(spark, sf, "SELECT 'T' || p_partkey AS asset, '[{' || CASE WHEN p_partkey % 3 = 0 THEN '\"Name\": \"r' || p_size || '\", ' ELSE '' END || '\"x\": \"/Game/A.' || p_type || '\"}, {\"RowName\": \"second\", \"y\": \"1\"}]' AS json FROM {part}")
    return editor.data_table_rows(x, values=False).select("asset", "name", _joined("references").alias("refs"))


@query("SELECT 'P' || (p_partkey % 40) AS package, max(p_partkey) AS seq FROM part WHERE p_size % 2 = 0 GROUP BY 1")
def blueprint_list(spark, sf):
    return editor.blueprints(_rows(spark, sf, "SELECT 'P' || (p_partkey % 40) AS package, CASE WHEN p_size % 2 = 0 THEN '/Script/E.WidgetBlueprint' ELSE '/Script/E.Mesh' END AS class, p_partkey AS seq FROM {part}")).select("package", "seq")


@query("SELECT user_id, least(count(*), 20) AS shown, count(*) > 20 AS truncated FROM events GROUP BY 1")
def blueprint_inspect(spark, sf):
    g = a.read(spark, sf, "events").groupBy("user_id").agg(F.collect_list("event_id").alias("nodes"))
    return editor.inspect_graph(g, 20).select("user_id", F.size("nodes").cast("long").alias("shown"), "truncated")


@query("WITH x AS (SELECT DISTINCT 'A' || (p_partkey % 30) AS asset, CASE p_size % 3 WHEN 0 THEN 'variable' WHEN 1 THEN 'function' ELSE 'graph' END AS part, p_name AS name FROM part WHERE p_size % 7 <> 0) SELECT asset, count(*) FILTER (WHERE part = 'variable') AS variables, count(*) FILTER (WHERE part = 'function') AS functions, count(*) FILTER (WHERE part = 'graph') AS graphs FROM x GROUP BY 1")
def blueprint_structure(spark, sf):
    x = _rows(spark, sf, "SELECT 'A' || (p_partkey % 30) AS asset, CASE p_size % 3 WHEN 0 THEN 'variable' WHEN 1 THEN 'function' ELSE 'graph' END AS part, p_name AS name, 'd' AS detail, CASE WHEN p_size % 7 = 0 THEN 'failed' END AS error FROM {part}")
    n = lambda c: F.greatest(F.size(F.coalesce(c, F.array())), F.lit(0)).cast("long")
    r = editor.structure(x)[0]
    return r.select("asset", *[F.coalesce(F.size(c), F.lit(0)).cast("long").alias(f"{c}s") for c in ("variable", "function", "graph")])


@query("SELECT 'blueprint-structure-scan-failed' AS code, 'A' || (p_partkey % 30) AS subject, count(*) AS n FROM part WHERE p_size % 7 = 0 GROUP BY 1, 2")
def blueprint_problems(spark, sf):
    x = _rows(spark, sf, "SELECT 'A' || (p_partkey % 30) AS asset, 'graph' AS part, p_name AS name, 'd' AS detail, CASE WHEN p_size % 7 = 0 THEN 'failed' END AS error FROM {part}")
    return editor.structure(x)[1].groupBy("code", "subject").agg(F.count("*").alias("n"))


@query("SELECT 'T.' || event_type AS tag, string_agg(DISTINCT 'u' || user_id, ',' ORDER BY 'u' || user_id) AS referencers FROM events WHERE event_type LIKE 'p%' GROUP BY 1")
def tag_referencers(spark, sf):
    x = _rows(spark, sf, "SELECT 'T.' || event_type AS tag, 'u' || user_id AS referencer FROM {events}")
    return editor.tag_referencers(x.join(editor.tags(x, "T.p"), "tag", "left_semi")).select("tag", F.array_join("referencers", ",").alias("referencers"))


@query("SELECT p_type AS type, string_agg(n, ',' ORDER BY n, 'X/' || n) AS assets, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS roots FROM (SELECT *, 'N' || p_partkey AS n FROM part) GROUP BY 1")
def primary_assets(spark, sf):
    x = _rows(spark, sf, "SELECT p_type AS type, CASE WHEN p_partkey % 2 = 0 THEN 'N' || p_partkey ELSE '' END AS name, 'X/N' || p_partkey AS object_path, p_brand AS root FROM {part}")
    return editor.primary_assets(x).select("type", F.array_join(F.transform("assets", lambda s: s["name"]), ",").alias("assets"), F.array_join("roots", ",").alias("roots"))


@query("SELECT count(DISTINCT p_name) FILTER (WHERE p_size > 40) AS dirty, 'error' AS severity, 'dirty-editor-packages' AS code FROM part")
def editor_state(spark, sf):
    s = editor.editor_state(_rows(spark, sf, "SELECT p_name AS package, p_size > 40 AS dirty FROM {part}"))
    return s.select(F.size("dirty_packages").cast("long").alias("dirty"), "severity", "code")


@query("SELECT 'ambiguous' AS status, (SELECT count(*) FROM customer WHERE c_nationkey = 3) AS count")
def select_session(spark, sf):
    return editor.select_session(_rows(spark, sf, "SELECT CAST(c_nationkey AS STRING) AS node_id FROM {customer}"), "3")


@query("SELECT p_partkey, p_size % 2 AS kept FROM part WHERE p_partkey % 4 <> 0")
def logical_packages(spark, sf):
    x = _rows(spark, sf, "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '/Game/__ExternalActors__/x' ELSE '/Game/x' END AS package, CASE WHEN p_size % 2 = 0 THEN '/Game/__ExternalObjects__/y' ELSE '/Game/y' END AS d FROM {part}").withColumn("dependencies", F.create_map(F.lit("hard_package"), F.array("d")))
    return editor.logical_only(x).select("p_partkey", F.size(F.col("dependencies")["hard_package"]).alias("kept"))


@query("SELECT name, CAST(floor((row_number() OVER (ORDER BY lower(name), name) - 1) / 20) AS BIGINT) AS batch FROM (SELECT DISTINCT p_brand || p_name AS name FROM part)")
def scan_batches(spark, sf):
    return editor.in_batches(_rows(spark, sf, "SELECT DISTINCT p_brand || p_name AS name FROM {part}"), "name", 20)


@query("SELECT 'srv' || (s_suppkey % 7) AS server_id, string_agg(DISTINCT 'tool' || s_nationkey, ',' ORDER BY 'tool' || s_nationkey) AS tools FROM supplier WHERE s_suppkey % 5 <> 0 GROUP BY 1")
def tool_inventory(spark, sf):
    x = _rows(spark, sf, "SELECT CASE WHEN s_suppkey % 5 = 0 THEN 'plain' ELSE 'mcp__srv' || (s_suppkey % 7) || '__tool' || s_nationkey END AS name FROM {supplier}")
    return connections.inventory(x).select("server_id", F.array_join("tool_names", ",").alias("tools"))


# --- messages ----------------------------------------------------------------------------------------

_NODES = "SELECT event_id, 'a' || (user_id % 9) AS asset, 'g' AS graph, 'n' || event_id AS node, CASE event_id % 4 WHEN 0 THEN 'K2Node_AsyncAction_ListenForGameplayMessages' ELSE 'K2Node_CallFunction' END AS node_class, CASE WHEN event_id % 4 = 3 THEN 'x|Other' ELSE 'x|Broadcast Message (' || event_type || ')' END AS type_id, CASE WHEN event_id % 4 = 2 THEN 'Else' ELSE 'GameplayMessageSubsystem' END AS self_title, CAST(event_id % 3 AS INT) AS connections, CASE WHEN event_id % 5 <> 0 THEN 'T.' || event_type END AS tag FROM {events}"


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'subscribe' ELSE 'publish' END AS operation, CASE WHEN event_id % 3 > 0 THEN 'dynamic' WHEN event_id % 5 <> 0 THEN 'static' ELSE 'unresolved' END AS channel_status FROM events WHERE event_id % 4 < 2")
def message_nodes(spark, sf):
    x = _rows(spark, sf, _NODES).withColumn("inputs", F.array(F.lit("self"), F.lit("Channel"), F.lit("Message")))
    return editor.message_nodes(x).select("event_id", "operation", "channel_status")


@query("SELECT (SELECT count(DISTINCT user_id % 9) FROM events) AS scanned_asset_count, count(*) AS message_operation_count, count(DISTINCT event_type) FILTER (WHERE event_id % 3 = 0 AND event_id % 5 <> 0) AS static_channel_count FROM events WHERE event_id % 4 < 2")
def message_summary(spark, sf):
    x = _rows(spark, sf, _NODES).withColumn("inputs", F.array(F.lit("self"), F.lit("Channel"), F.lit("Message")))
    return editor.message_summary(editor.message_nodes(x), x.select("asset"))


_OPERATIONS = "SELECT '/Game/a' || (user_id % 9) AS asset, 'g' AS graph, '/Game/a' || (user_id % 9) || ':g' AS graph_path, 'n' || event_id AS node, 'T' AS node_type, 'C' AS node_class, CASE WHEN event_id % 2 = 0 THEN 'publish' ELSE 'subscribe' END AS operation, CASE WHEN event_id % 3 = 0 THEN 'static' ELSE 'dynamic' END AS channel_status, CASE WHEN event_id % 3 = 0 THEN 'T.' || event_type END AS tag, CASE WHEN event_id % 5 = 0 THEN '/S.P' || (user_id % 4) END AS payload_type, CAST(NULL AS STRING) AS match_type FROM {events}"
_REFERENCERS = "SELECT DISTINCT 'T.' || event_type AS tag, '/Game/r' || (user_id % 5) AS referencer FROM {events}"
_MID = lambda kind, key: f"'{kind}:' || sha256('[\"{kind}\",\"P\",\"' || {key} || '\"]')"
_MESSAGE_LINKS = f"""o AS ({_sql(_OPERATIONS)}), f AS ({_sql(_REFERENCERS)}), l AS (
SELECT {_MID('asset', 'asset')} AS s, 'CONTAINS' AS kind, {_MID('blueprint_graph', 'graph_path')} AS t, 'confirmed' AS certainty FROM o UNION SELECT {_MID('blueprint_graph', 'graph_path')}, 'CONTAINS', {_MID('blueprint_node', 'node')}, 'confirmed' FROM o
UNION SELECT {_MID('blueprint_node', 'node')}, CASE operation WHEN 'publish' THEN 'PUBLISHES_EVENT' ELSE 'SUBSCRIBES_EVENT' END, CASE WHEN tag IS NOT NULL THEN {_MID('gameplay_tag', 'tag')} ELSE {_MID('message_channel_expression', "node || '|Channel'")} END, CASE WHEN tag IS NOT NULL THEN 'confirmed' ELSE 'unresolved' END FROM o
UNION SELECT {_MID('blueprint_node', 'node')}, 'USES_TYPE', {_MID('payload_type', 'payload_type')}, 'confirmed' FROM o WHERE payload_type IS NOT NULL UNION SELECT {_MID('asset', 'referencer')}, 'REFERENCES', {_MID('gameplay_tag', 'tag')}, 'confirmed' FROM f)"""


def _exported(spark, sf):
    return messages.export(_rows(spark, sf, _OPERATIONS), _rows(spark, sf, _REFERENCERS), "P")


@query(f"WITH {_MESSAGE_LINKS} SELECT 'relation:' || sha256('[\"relation\",\"' || s || '\",\"' || kind || '\",\"' || t || '\"]') AS relation_id, s AS source_id, kind, t AS target_id, certainty FROM l")
def message_relations(spark, sf):
    return _exported(spark, sf)[1].select("relation_id", "source_id", "kind", "target_id", "certainty")


@query(f"""WITH o AS ({_sql(_OPERATIONS)}), f AS ({_sql(_REFERENCERS)}) SELECT DISTINCT kind, name, 'P|' || kind || '|' || key AS canonical_key FROM (
SELECT 'asset' AS kind, split_part(asset, '/', 3) AS name, asset AS key FROM o UNION SELECT 'blueprint_graph', graph, graph_path FROM o UNION SELECT 'blueprint_node', node_type, node FROM o UNION SELECT 'gameplay_tag', tag, tag FROM o WHERE tag IS NOT NULL
UNION SELECT 'message_channel_expression', 'Dynamic Channel', node || '|Channel' FROM o WHERE tag IS NULL UNION SELECT 'payload_type', split_part(payload_type, '.', 2), payload_type FROM o WHERE payload_type IS NOT NULL UNION SELECT 'gameplay_tag', tag, tag FROM f UNION SELECT 'asset', split_part(referencer, '/', 3), referencer FROM f)""")
def message_graph(spark, sf):
    return _exported(spark, sf)[0].select("kind", "name", "canonical_key")


@query(f"WITH o AS ({_sql(_OPERATIONS)}) SELECT (SELECT count(DISTINCT (asset, graph_path)) FROM o) + count(*) + count(*) + count(payload_type) + (SELECT count(*) FROM ({_sql(_REFERENCERS)})) AS evidence FROM o")
def message_evidence(spark, sf):
    return _exported(spark, sf)[2].agg(F.count("*").alias("evidence"))


# --- adapters ----------------------------------------------------------------------------------------

_LINK = ("sk", "s", "kind", "tk", "t", "certainty")


def _links(schema: str, rows):
    return knowledge.ADAPTERS[schema](rows)[1].select(*_LINK).distinct()


def _expected(ctes: str, *parts: tuple) -> str:
    """Links as (from where, source kind, source, kind, target kind, target[, certainty])."""
    return f"WITH {ctes} " + " UNION ".join(f"SELECT {p[1]} AS sk, {p[2]} AS s, {p[3]} AS kind, {p[4]} AS tk, {p[5]} AS t, {p[6] if len(p) > 6 else repr('confirmed')} AS certainty FROM {p[0]}" for p in parts)


_ASSETS = "SELECT '/Game/P' || p_partkey AS package, '/Script/X.' || p_type AS class, CASE WHEN p_size % 2 = 0 THEN '/Game/P' || p_partkey || '.C' END AS generated_class, '/Script/X.Base' AS parent_class, '/Game/D' || p_size AS hard, '/Game/S' || p_size AS odd FROM {part}"


@query(_expected(f"x AS ({_sql(_ASSETS)})", ("x", "'asset'", "package", "'INSTANCE_OF'", "'asset_class'", "class"), ("x WHERE generated_class IS NOT NULL", "'asset'", "package", "'GENERATES_CLASS'", "'class'", "generated_class"), ("x WHERE generated_class IS NOT NULL", "'class'", "generated_class", "'INHERITS'", "'class'", "parent_class"), ("x", "'asset'", "package", "'DEPENDS_ON'", "'asset'", "hard"), ("x", "'asset'", "package", "'MANAGES'", "'asset'", "odd"), ("x", "'asset'", "package", "'REFERENCES'", "'asset'", "odd")))
def adapter_assets(spark, sf):
    x = _rows(spark, sf, _ASSETS).withColumn("dependencies", F.create_map(F.lit("hard_package"), F.array("hard"), F.lit("soft_manage"), F.array("odd"), F.lit("unheard_of"), F.array("odd")))
    return _links("asset-graph", x)


_PARTS = "SELECT '/Game/B' || (p_partkey % 25) AS package, CASE WHEN p_partkey % 25 < 12 THEN '/Game/B' || (p_partkey % 25) || '.C' END AS generated_class, CASE p_size % 8 WHEN 0 THEN 'variable' WHEN 1 THEN 'function' WHEN 2 THEN 'event' WHEN 3 THEN 'component' WHEN 4 THEN 'graph' WHEN 5 THEN 'node' WHEN 6 THEN 'interface' ELSE 'reference' END AS part, CASE WHEN p_size % 8 = 7 THEN '/Game/R.' || p_type ELSE p_name END AS name, CASE WHEN p_size % 8 = 7 THEN CASE WHEN p_partkey % 2 = 0 THEN 'class' ELSE 'asset' END ELSE p_brand END AS parent, CASE WHEN p_partkey % 3 = 0 THEN false WHEN p_partkey % 3 = 1 THEN true END AS implemented FROM {part}"
_BP = "y WHERE part = "


@query(_expected(
    f"x AS ({_sql(_PARTS)}), y AS (SELECT *, coalesce(generated_class, package) AS owner, CASE WHEN generated_class IS NULL THEN 'asset' ELSE 'class' END AS ok FROM x WHERE implemented IS DISTINCT FROM false)",
    ("x WHERE generated_class IS NOT NULL", "'asset'", "package", "'GENERATES_CLASS'", "'class'", "generated_class"), (_BP + "'variable'", "ok", "owner", "'DECLARES_VARIABLE'", "'blueprint_variable'", "owner || '|' || name"), (_BP + "'function'", "ok", "owner", "'DECLARES_FUNCTION'", "'blueprint_function'", "owner || '|function|' || name"),
    (_BP + "'event'", "ok", "owner", "'DECLARES_EVENT'", "'blueprint_event'", "owner || '|event|' || name"), (_BP + "'component'", "ok", "owner", "'OWNS_COMPONENT'", "'blueprint_component'", "owner || '|' || name || '|' || parent"), (_BP + "'interface'", "ok", "owner", "'IMPLEMENTS'", "'interface'", "name"),
    (_BP + "'graph'", "'asset'", "package", "'CONTAINS'", "'blueprint_graph'", "name"), (_BP + "'node'", "'blueprint_graph'", "parent", "'CONTAINS'", "'blueprint_node'", "name"), (_BP + "'reference'", "'asset'", "package", "'REFERENCES'", "parent", "CASE WHEN parent = 'asset' THEN '/Game/R' ELSE name END"),
))
def adapter_blueprints(spark, sf):
    return _links("blueprint-structure", _rows(spark, sf, _PARTS))


_TABLE = "SELECT '/Game/T' || (p_partkey % 20) AS asset, '/Script/S.' || p_type AS row_struct, p_name AS name, CASE WHEN p_size % 2 = 0 THEN 'gameplay_tag' ELSE 'soft' END AS rk, '/Game/Q' || p_size || '.Q' AS rt FROM {part}"


@query(_expected(f"x AS ({_sql(_TABLE)})", ("x", "'data_table'", "asset", "'USES_ROW_STRUCT'", "'row_struct'", "row_struct"), ("x", "'data_table'", "asset", "'CONTAINS_ROW'", "'data_table_row'", "asset || '|' || name"), ("x", "'data_table_row'", "asset || '|' || name", "'REFERENCES'", "CASE rk WHEN 'soft' THEN 'asset' ELSE rk END", "CASE rk WHEN 'soft' THEN split_part(rt, '.', 1) ELSE rt END")))
def adapter_tables(spark, sf):
    return _links("data-table", _rows(spark, sf, _TABLE).withColumn("references", F.array(F.struct(F.col("rk").alias("kind"), F.col("rt").alias("target")))))


_PROPERTIES = "SELECT '/Game/A' || (p_partkey % 30) AS asset, '/Script/C.' || p_type AS asset_class, p_name AS path, CASE p_size % 4 WHEN 0 THEN 'matches_default' WHEN 1 THEN 'baseline_unavailable' WHEN 2 THEN 'differs_from_default' ELSE 'baseline_property_missing' END AS comparison, CASE WHEN p_partkey % 2 = 0 THEN 'object' ELSE 'primary_asset' END AS rk, 'Map:' || p_size AS rt FROM {part}"


@query(_expected(f"x AS ({_sql(_PROPERTIES)}), y AS (SELECT * FROM x WHERE comparison IN ('differs_from_default', 'baseline_property_missing'))", ("x", "'asset'", "asset", "'INSTANCE_OF'", "'class'", "asset_class"), ("y", "'asset'", "asset", "'DECLARES_PROPERTY'", "'data_asset_property'", "asset || '|' || path"), ("y", "'data_asset_property'", "asset || '|' || path", "'REFERENCES'", "rk", "rt")))
def adapter_data_assets(spark, sf):
    return _links("data-asset", _rows(spark, sf, _PROPERTIES).withColumn("references", F.array(F.struct(F.col("rk").alias("kind"), F.col("rt").alias("target")))))


@query(f"SELECT comparison, count(*) AS n FROM ({_sql(_PROPERTIES)}) WHERE comparison IN ('differs_from_default', 'baseline_property_missing') GROUP BY 1")
def non_default_properties(spark, sf):
    return resolve.deltas_only(_rows(spark, sf, _PROPERTIES)).groupBy("comparison").agg(F.count("*").alias("n"))


_PRIMARY = "SELECT p_type AS type, CASE WHEN p_size % 3 > 0 THEN 'N' || p_partkey END AS name, '/Game/N' || p_partkey || '.N' AS object_path, CASE WHEN p_size % 3 = 0 THEN 'R' || p_size END AS rules, CASE WHEN p_size % 2 = 0 THEN 'b' || p_size END AS bundle, '/Game/' || p_brand AS d FROM {part}"


@query(_expected(
    f"x AS ({_sql(_PRIMARY)}), n AS (SELECT * FROM x WHERE name IS NOT NULL)",
    ("x WHERE rules IS NOT NULL", "'primary_asset_rule'", "'type|' || type || '|' || rules", "'APPLIES_TO'", "'primary_asset_type'", "type"), ("x", "'primary_asset_type'", "type", "'SCANS_PATH'", "'content_path'", "d"), ("n", "'primary_asset'", "type || ':' || name", "'PRIMARY_ASSET_OF_TYPE'", "'primary_asset_type'", "type"),
    ("n", "'primary_asset'", "type || ':' || name", "'RESOLVES_TO'", "'asset'", "split_part(object_path, '.', 1)"), ("x WHERE bundle IS NOT NULL", "'primary_asset'", "type || coalesce(':' || name, '')", "'DECLARES_BUNDLE'", "'asset_bundle'", "type || coalesce(':' || name, '') || '|' || bundle"),
))
def adapter_primary_assets(spark, sf):
    return _links("primary-asset", _rows(spark, sf, _PRIMARY).withColumn("directories", F.array("d")))


_CONFIG = "SELECT 'f' || (event_id % 3) || '.ini' AS file, CAST(event_id AS INT) AS line, event_type AS section, 'k' || (user_id % 10) AS key, '+' AS operator, 'v' AS value, CASE event_id % 3 WHEN 0 THEN 'gameplay_tag' WHEN 1 THEN 'class' ELSE 'asset' END AS rk, '/Game/V' || user_id || '.V' AS rt FROM {events}"


@query(_expected(
    f"x AS ({_sql(_CONFIG)}), y AS (SELECT *, file || '|' || line || '|' || section || '|' || key AS dec, lag(file || '|' || line || '|' || section || '|' || key) OVER (PARTITION BY section, key ORDER BY file, line) AS prev FROM x)",
    ("y", "'config_file'", "file", "'DECLARES'", "'config_section'", "file || '|' || section"), ("y", "'config_section'", "file || '|' || section", "'DECLARES'", "'config_declaration'", "dec"), ("y", "'config_declaration'", "dec", "'CONFIGURES'", "'config_key'", "section || '|' || key"), ("y WHERE prev IS NOT NULL", "'config_declaration'", "dec", "'OVERRIDES'", "'config_declaration'", "prev"),
    ("y", "'config_declaration'", "dec", "CASE rk WHEN 'gameplay_tag' THEN 'DECLARES_TAG' WHEN 'class' THEN 'SELECTS_CLASS' ELSE 'REFERENCES' END", "rk", "CASE rk WHEN 'asset' THEN split_part(rt, '.', 1) ELSE rt END"),
))
def adapter_config(spark, sf):
    return _links("config-graph", _rows(spark, sf, _CONFIG).withColumn("references", F.array(F.struct(F.col("rk").alias("kind"), F.col("rt").alias("target")))))


_CODE = "SELECT CASE event_id % 3 WHEN 0 THEN 'publish' WHEN 1 THEN 'subscribe' ELSE 'unsubscribe' END AS operation, 'm' || (user_id % 5) || '.cpp' AS path, 'F' || (user_id % 7) AS function, CAST(event_id % 100 AS INT) AS line, CASE WHEN event_id % 2 = 0 THEN 'static' ELSE 'unresolved' END AS status, CASE WHEN event_id % 2 = 0 THEN 'T.' || event_type END AS tag, 'e' || user_id AS expression, CASE WHEN event_id % 4 = 0 THEN 'FPay' END AS payload_type FROM {events}"


@query(_expected(
    f"x AS ({_sql(_CODE)})",
    ("x", "'cxx_function'", "path || '|' || function", "upper(operation) || CASE operation WHEN 'publish' THEN 'ES' ELSE 'S' END || '_EVENT'", "CASE status WHEN 'static' THEN 'gameplay_tag' ELSE 'message_channel_expression' END", "CASE status WHEN 'static' THEN tag ELSE path || ':' || line || '|' || expression END", "CASE status WHEN 'static' THEN 'confirmed' ELSE 'unresolved' END"),
    ("x WHERE payload_type IS NOT NULL", "'cxx_function'", "path || '|' || function", "'USES_TYPE'", "'payload_type'", "payload_type"),
))
def adapter_code_messages(spark, sf):
    return _links("cxx-messages", _rows(spark, sf, _CODE))


_IMPORTED = (
    f"o AS ({_sql(_OPERATIONS)}), f AS ({_sql(_REFERENCERS)})",
    ("o", "'asset'", "asset", "'CONTAINS'", "'blueprint_graph'", "graph_path"), ("o", "'blueprint_graph'", "graph_path", "'CONTAINS'", "'blueprint_node'", "node"),
    ("o", "'blueprint_node'", "node", "CASE operation WHEN 'publish' THEN 'PUBLISHES_EVENT' ELSE 'SUBSCRIBES_EVENT' END", "CASE WHEN tag IS NULL THEN 'message_channel_expression' ELSE 'gameplay_tag' END", "coalesce(tag, 'unknown-project|message_channel_expression|' || node || '|Channel')", "CASE WHEN tag IS NULL THEN 'unresolved' ELSE 'confirmed' END"),
    ("o WHERE payload_type IS NOT NULL", "'blueprint_node'", "node", "'USES_TYPE'", "'payload_type'", "payload_type"), ("f", "'asset'", "referencer", "'REFERENCES'", "'gameplay_tag'", "tag"),
)


# an imported graph and blueprint node are keyed by their property object_path, for an asset stands first only where there is a package
@query(_expected(*_IMPORTED))
def adapter_message_scan(spark, sf):
    return _links("message-scan", (_rows(spark, sf, _OPERATIONS), _rows(spark, sf, _REFERENCERS)))


@query(_expected(*_IMPORTED).replace("unknown-project", "P"))
def adapter_graph_import(spark, sf):
    return _links("message-graph", _exported(spark, sf))


@query(f"""WITH x AS ({_sql(_ASSETS)}), c AS ({_sql(_CONFIG)}) SELECT kind, 'Proj|' || kind || '|' || key AS canonical_key, name FROM (
SELECT 'asset' AS kind, package AS key, split_part(package, '/', 3) AS name FROM x UNION SELECT 'asset_class', class, class FROM x UNION SELECT 'class', generated_class, generated_class FROM x WHERE generated_class IS NOT NULL UNION SELECT 'class', parent_class, parent_class FROM x
UNION SELECT 'asset', hard, split_part(hard, '/', 3) FROM x UNION SELECT 'asset', odd, split_part(odd, '/', 3) FROM x UNION SELECT 'config_file', file, file FROM c UNION SELECT 'config_section', file || '|' || section, section FROM c UNION SELECT 'config_key', section || '|' || key, key FROM c
UNION SELECT 'config_declaration', file || '|' || line || '|' || section || '|' || key, key FROM c UNION SELECT rk, CASE rk WHEN 'asset' THEN split_part(rt, '.', 1) ELSE rt END, CASE rk WHEN 'gameplay_tag' THEN rt WHEN 'class' THEN split_part(rt, '.', 2) ELSE split_part(split_part(rt, '.', 1), '/', 3) END FROM c)""")
def knowledge_graph(spark, sf):
    assets = _rows(spark, sf, _ASSETS).withColumn("dependencies", F.create_map(F.lit("hard_package"), F.array("hard"), F.lit("soft_manage"), F.array("odd")))
    config = _rows(spark, sf, _CONFIG).withColumn("references", F.array(F.struct(F.col("rk").alias("kind"), F.col("rt").alias("target"))))
    return knowledge.build({"asset-graph": assets, "config-graph": config}, "Proj")[0].select("kind", "canonical_key", "name")


# --- code, modules and files --------------------------------------------------------------------------

_CPP = "SELECT CAST(p_partkey AS STRING) AS path, '#include \"A' || p_size || '.h\"' || chr(10) || 'namespace N {' || chr(10) || 'UCLASS()' || chr(10) || 'class X_API U' || p_type || ' : public UBase {' || chr(10) || '  UOther* Other;' || chr(10) || '  void Act(int A) { if (A) { Helper(A); } }' || chr(10) || '};' || chr(10) || '}' AS text FROM {part}"


@query(
    """WITH x AS (SELECT CAST(p_partkey AS VARCHAR) AS path, 'A' || p_size || '.h' AS h, 'U' || p_type AS u FROM part)
SELECT path, 'include' AS kind, h AS name, '' AS owner, 1 AS line FROM x UNION ALL SELECT path, 'macro', 'UCLASS', 'N', 3 FROM x UNION ALL SELECT path, 'type', u, 'N', 4 FROM x UNION ALL SELECT path, 'field', 'Other', 'N::' || u, 5 FROM x
UNION ALL SELECT path, 'function', 'N::' || u || '::Act', 'N::' || u, 6 FROM x UNION ALL SELECT path, 'control', 'if', 'N::' || u || '::Act', 6 FROM x UNION ALL SELECT path, 'call', 'Helper', 'N::' || u || '::Act', 6 FROM x"""
)
def cpp_facts(spark, sf):
    return code.extract(_rows(spark, sf, _CPP)).select("path", "kind", "name", "owner", "line")


_CSHARP = "SELECT CAST(p_partkey AS STRING) AS path, 'public class M' || p_partkey || ' : ModuleRules {' || chr(10) || 'public M' || p_partkey || '(T t) { PublicDependencyModuleNames.AddRange(new string[] { \"Core\", \"' || p_type || '\" }); Setup(); }' || chr(10) || 'void Setup() { PrivateDependencyModuleNames.Add(\"' || p_brand || '\"); }' || chr(10) || 'void Dead() { PrivateDependencyModuleNames.Add(\"Never\"); }' || chr(10) || '}' AS text FROM {part}"


@query("WITH x AS (SELECT CAST(p_partkey AS VARCHAR) AS path, p_type, p_brand FROM part) SELECT path, 'PublicDependencyModuleNames' AS setting, 'Core' AS dependency FROM x UNION ALL SELECT path, 'PublicDependencyModuleNames', p_type FROM x UNION ALL SELECT path, 'PrivateDependencyModuleNames', p_brand FROM x")
def rule_dependencies(spark, sf):
    return code.rule_dependencies(code.extract(_rows(spark, sf, _CSHARP), "cs_facts")).select("path", "setting", "dependency")


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, 'M' || p_partkey AS name FROM part")
def rules_classes(spark, sf):
    return filegraph.rules_classes(code.extract(_rows(spark, sf, _CSHARP), "cs_facts"), "ModuleRules")


@query("SELECT p_partkey AS path, CASE WHEN p_size % 2 = 0 THEN 'List.Add' ELSE 'Go' END AS target FROM part")
def receiver_types(spark, sf):
    calls = _rows(spark, sf, "SELECT p_partkey AS path, CASE WHEN p_size % 2 = 0 THEN 'Log.Add' ELSE 'Go' END AS name, 'M' AS owner FROM {part}")
    return filegraph.receiver_types(calls, _rows(spark, sf, "SELECT p_partkey AS path, 'Log' AS name, 'N.List' AS detail FROM {part}")).select("path", "target")


_TYPES = "SELECT 'f' || p_partkey || '.h' AS path, 'type' AS kind, 'U' || p_partkey AS name, 'N' || (p_partkey % 5) AS owner, CASE WHEN p_partkey % 3 = 0 THEN 'FOutside' ELSE 'N' || ((p_partkey - 1) % 5) || '::U' || (p_partkey - 1) END AS detail, 1 AS line FROM {part} UNION ALL SELECT 'f' || p_partkey || '.h', 'field', 'x', 'N' || (p_partkey % 5) || '::U' || p_partkey, 'TArray<U' || p_size || '*>', 2 FROM {part}"


@query("WITH q AS (SELECT p_partkey AS k, 'N' || (p_partkey % 5) || '::U' || p_partkey AS q, 'f' || p_partkey || '.h' AS path, p_size FROM part) SELECT a.q AS source, b.q AS target, 'inheritance' AS kind, a.path, 1 AS line FROM q a JOIN q b ON b.k = a.k - 1 WHERE a.k % 3 <> 0 UNION SELECT a.q, b.q, 'field_type', a.path, 2 FROM q a JOIN q b ON b.k = a.p_size WHERE a.q <> b.q")
def type_graph(spark, sf):
    return filegraph.type_graph(_rows(spark, sf, _TYPES))[1]


@query("WITH q AS (SELECT p_partkey AS k, 'N' || (p_partkey % 5) || '::U' || p_partkey AS q FROM part) SELECT a.q AS name, CASE WHEN a.k % 3 = 0 THEN 'FOutside' ELSE coalesce(b.q, 'U' || (a.k - 1)) END AS bases FROM q a LEFT JOIN q b ON b.k = a.k - 1")
def type_bases(spark, sf):
    return filegraph.type_graph(_rows(spark, sf, _TYPES))[0].select("name", F.array_join("base_types", ",").alias("bases"))


_INTERFACES = "SELECT 'f' || p_partkey AS path, CASE p_partkey % 3 WHEN 0 THEN 'UINTERFACE()' WHEN 1 THEN 'UINTERFACE(x)' ELSE 'UCLASS()' END AS macro, CASE WHEN p_size % 2 = 0 THEN '' ELSE 'int x;' END AS gap FROM {part}"


@query("SELECT 'f' || p_partkey AS path, 'U' || p_partkey AS name, concat_ws(',', CASE WHEN p_partkey % 3 = 0 AND p_size % 2 = 0 THEN 'UINTERFACE macro' END, CASE WHEN p_size % 5 = 0 THEN 'derives from UInterface' END) AS reasons FROM part WHERE (p_partkey % 3 = 0 AND p_size % 2 = 0) OR p_size % 5 = 0 UNION ALL SELECT 'f' || p_partkey, 'I' || p_partkey, 'paired I/U interface naming' FROM part")
def interface_candidates(spark, sf):
    x = _rows(spark, sf, _INTERFACES)
    facts = _rows(spark, sf, "SELECT 'f' || p_partkey AS path, 'type' AS kind, 'U' || p_partkey AS name, '' AS owner, CASE WHEN p_size % 5 = 0 THEN 'UInterface' ELSE 'UObject' END AS detail, 3 AS line FROM {part} UNION ALL SELECT 'f' || p_partkey, 'type', 'I' || p_partkey, '', '', 4 FROM {part} UNION ALL SELECT 'f' || p_partkey, 'macro', CASE p_partkey % 3 WHEN 2 THEN 'UCLASS' ELSE 'UINTERFACE' END, '', CASE p_partkey % 3 WHEN 1 THEN 'x' ELSE '' END, 1 FROM {part}")
    line = lambda n, c: x.select("path", F.lit(n).alias("line"), c.alias("text"))
    lines = upsert.union([line(1, F.col("macro")), line(2, F.col("gap")), line(3, F.lit("class U {};")), line(4, F.lit("class I {};"))])
    return filegraph.interface_candidates(facts, lines).select("path", "name", F.array_join("reasons", ",").alias("reasons"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, 'control' AS kind, 'if' AS name FROM part WHERE p_type = 'ECONOMY' UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'call', 'Helper' FROM part WHERE p_type = 'ECONOMY'")
def function_flow(spark, sf):
    return filegraph.function_flow(code.extract(_rows(spark, sf, _CPP)), "UECONOMY::Act").select("path", "kind", "name")


@query("SELECT 'm' || c_custkey AS name, CASE WHEN c_custkey % 4 = 0 THEN 0 WHEN c_custkey % 4 = 1 THEN 2 ELSE 1 END AS registrations, CASE WHEN c_custkey % 4 = 0 THEN 'module-entry-registration-not-found' WHEN c_custkey % 4 = 1 THEN 'module-entry-source-ambiguous' END AS code, CASE WHEN c_custkey % 4 > 0 THEN 'h' || c_custkey END AS header FROM customer")
def module_entries(spark, sf):
    facts = _rows(spark, sf, "SELECT 'macro' AS kind, 'IMPLEMENT_MODULE' AS name, 'F' || c_custkey || ' , M' || c_custkey AS detail, 'x.cpp' AS path, 1 AS line FROM {customer} WHERE c_custkey % 4 > 0 UNION ALL SELECT 'macro', 'IMPLEMENT_GAME_MODULE', 'F' || c_custkey || ', M' || c_custkey, 'y.cpp', 1 FROM {customer} WHERE c_custkey % 4 = 1")
    heads = _rows(spark, sf, "SELECT 'h' || c_custkey AS path, 'type' AS kind, 'F' || c_custkey AS name FROM {customer}")
    return filegraph.module_entries(facts, _rows(spark, sf, "SELECT 'm' || c_custkey AS name FROM {customer}"), heads).select("name", "registrations", "code", "header")


_PLUGINS = "SELECT 'P' || c_custkey AS name, c_custkey % 3 > 0 AS enabled, c_custkey % 5 = 0 AS optional, CASE WHEN c_custkey % 7 = 0 THEN array('Linux') END AS platform_allow, array('Win64') AS supported_platforms, CASE WHEN c_custkey % 11 = 0 THEN array('Win64') END AS platform_deny, CAST(NULL AS array<string>) AS target_allow, CAST(NULL AS array<string>) AS target_deny FROM {customer}"
_DESCRIPTORS = "SELECT 'e/' || CASE WHEN o_orderkey % 2 = 0 THEN 'p' ELSE 'P' END || o_custkey || '.uplugin' AS path, CASE o_orderstatus WHEN 'F' THEN 'engine' WHEN 'O' THEN 'mods' ELSE 'project' END AS origin FROM {orders}"


@query(f"WITH d AS (SELECT lower(regexp_replace(path, '.*/|\\.uplugin$', '', 'g')) AS k, path, CASE origin WHEN 'engine' THEN 10 WHEN 'mods' THEN 2 ELSE 0 END AS r FROM ({_sql(_DESCRIPTORS)})), b AS (SELECT k, arg_min(path, (r, lower(path), path)) AS path FROM d GROUP BY 1) SELECT 'P' || c_custkey AS name, b.path AS descriptor, c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 AS applies FROM customer LEFT JOIN b ON b.k = 'p' || c_custkey")
def plugin_resolution(spark, sf):
    return filegraph.resolve_plugins(_rows(spark, sf, _PLUGINS), _rows(spark, sf, _DESCRIPTORS), operation="resolve")[0].select("name", "descriptor", "applies")


@query("SELECT CASE WHEN c_custkey % 5 = 0 THEN 'warning' ELSE 'error' END AS severity, 'plugin-not-found' AS code, 'P' || c_custkey AS subject FROM customer WHERE c_custkey % 3 > 0 AND c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)")
def plugin_problems(spark, sf):
    return filegraph.resolve_plugins(_rows(spark, sf, _PLUGINS), _rows(spark, sf, _DESCRIPTORS), operation="resolve")[1]


@query("WITH RECURSIVE r(n, d) AS (SELECT CAST(5 AS BIGINT), 0 UNION ALL SELECT c_custkey, d + 1 FROM r JOIN customer ON c_custkey IN (2 * n, 2 * n + 1) WHERE c_custkey > 0) SELECT 'p' || n AS plugin, min(d) AS depth FROM r GROUP BY 1")
def plugin_closure(spark, sf):
    needs = _rows(spark, sf, "SELECT 'P' || CAST(floor(c_custkey / 2) AS BIGINT) AS plugin, 'p' || c_custkey AS needs FROM {customer} WHERE c_custkey > 1")
    return filegraph.plugin_closure(spark.createDataFrame([("P5",)], "name string"), needs)


_FILES = "SELECT 'Source/M' || (p_partkey % 20) || CASE WHEN p_partkey % 20 = 3 THEN '/Sub' ELSE '' END || '/f' || p_partkey || CASE p_partkey % 4 WHEN 0 THEN '.h' WHEN 1 THEN '.cpp' WHEN 2 THEN '.txt' ELSE '.mm' END AS rel FROM {part} UNION ALL SELECT DISTINCT 'Source/M' || (p_partkey % 20) || '/M' || (p_partkey % 20) || '.Build.cs' FROM {part} UNION ALL SELECT 'Source/M3/Sub/S.Build.cs' FROM {region} WHERE r_regionkey = 0 UNION ALL SELECT 'G.uproject' FROM {region} WHERE r_regionkey = 0 UNION ALL SELECT 'Source/G.Target.cs' FROM {region} WHERE r_regionkey = 0 UNION ALL SELECT 'Plugins/P' || r_regionkey || '/P' || r_regionkey || '.uplugin' FROM {region}"
_FREF = "SELECT 'Source/M' || (p_partkey % 20) || '/M' || (p_partkey % 20) || '.Build.cs' AS source, CASE WHEN p_size < 20 THEN 'm' ELSE 'E' END || p_size AS name, 'DEPENDS_ON_MODULE' AS kind, p_size AS line FROM {part}"
_FPLUG = "SELECT 'G.uproject' AS source, 'p' || n_nationkey AS name, n_nationkey % 2 = 0 AS enabled, n_nationkey AS line FROM {nation}"


@query(f"""WITH f AS ({_sql(_FILES)}), src AS (SELECT rel FROM f WHERE regexp_matches(rel, '\\.(h|cpp|mm)$')), m AS (SELECT rel, lower(regexp_extract(rel, '([^/.]+)\\.Build\\.cs$', 1)) AS k FROM f WHERE rel LIKE '%.Build.cs')
SELECT 'CONTAINS_FILE' AS kind, 'resolved' AS resolution_status, CASE WHEN rel LIKE 'Source/M3/Sub/%' THEN 'Source/M3/Sub/S.Build.cs' ELSE regexp_extract(rel, '^Source/M[0-9]+/', 0) || regexp_extract(rel, '^Source/(M[0-9]+)/', 1) || '.Build.cs' END AS source, rel AS target FROM src
UNION SELECT 'DECLARES_TARGET', 'resolved', 'G.uproject', 'Source/G.Target.cs' UNION SELECT r.kind, CASE WHEN m.k IS NULL THEN 'external' ELSE 'resolved' END, r.source, coalesce(m.rel, lower(r.name)) FROM ({_sql(_FREF)}) r LEFT JOIN m ON m.k = lower(r.name)
UNION SELECT CASE WHEN enabled THEN 'ENABLES_PLUGIN' ELSE 'DISABLES_PLUGIN' END, CASE WHEN line < 5 THEN 'resolved' ELSE 'external' END, source, CASE WHEN line < 5 THEN 'Plugins/P' || line || '/P' || line || '.uplugin' ELSE name END FROM ({_sql(_FPLUG)})
UNION SELECT 'INCLUDES', 'system_or_sdk_unresolved', rel, 'vector' FROM src""")
def file_graph(spark, sf):
    f = _rows(spark, sf, _FILES)
    includes = f.filter(F.col("rel").rlike(r"\.(h|cpp|mm)$")).select(F.col("rel").alias("source"), F.lit("vector").alias("target"), F.lit(None).cast("string").alias("path"), F.lit("system_or_sdk_unresolved").alias("status"), F.lit(1).alias("line"))
    n, e, _ = filegraph.build(f, _rows(spark, sf, _FPLUG), _rows(spark, sf, _FREF), includes)
    at = n.select("node_id", F.coalesce("path", "name").alias("at"))
    s, o = at.toDF("source_id", "source"), at.toDF("target_id", "target")
    return e.join(s, "source_id").join(o, "target_id").select("kind", "resolution_status", "source", "target")


# --- graphs ----------------------------------------------------------------------------------------------


@query("SELECT 'n' || c_custkey AS node, c_custkey % 6 <> 1 AND c_custkey % 6 <> 0 AS semantic FROM customer WHERE c_custkey % 6 < 4")
def semantic_nodes(spark, sf):
    """Blocks of six: an event starts a knot, the knot a call, a getter feeds the call; two more nodes are tied to nothing."""
    k = F.col("c_custkey")
    nm = lambda c: F.concat(F.lit("n"), c.cast("string"))
    link = lambda node, pin: F.array(F.struct(node.alias("node"), F.lit(pin).alias("pin")))
    pin = lambda n, d, ty, c: F.struct(F.lit(n).alias("name"), F.lit(d).alias("direction"), F.lit(ty).alias("type"), c.alias("connections"))
    none = F.array().cast("array<struct<node:string,pin:string>>")
    r = k % 6
    pins = (
        F.when(r == 0, F.array(pin("then", "output", "exec", link(nm(k + 1), "in"))))
        .when(r == 1, F.array(pin("in", "input", "exec", link(nm(k - 1), "then")), pin("out", "output", "exec", link(nm(k + 1), "exec"))))
        .when(r == 2, F.array(pin("exec", "input", "exec", link(nm(k - 1), "out")), pin("arg", "input", "int", link(nm(k + 1), "v"))))
        .when(r == 3, F.array(pin("v", "output", "int", link(nm(k - 1), "arg"))))
        .otherwise(F.array(pin("v", "output", "int", none)))
    )
    cls = F.when(r == 0, "K2Node_Event").when(r == 1, "K2Node_Knot").when(r == 2, "K2Node_CallFunction").otherwise("K2Node_VariableGet")
    whole = a.read(spark, sf, "customer")
    return closure.semantic_nodes(whole.select(nm(k).alias("object_path"), cls.alias("class"), pins.alias("pins"))).select("node", "semantic")


@query("SELECT CAST(n AS VARCHAR) AS name, (SELECT count(*) FROM customer WHERE c_custkey > 0 AND floor(c_custkey / 10) = n) AS in_degree, CASE WHEN n > 0 THEN 1 ELSE 0 END AS out_degree, CASE WHEN n % 2 = 0 THEN 'f' || n END AS files FROM (SELECT c_custkey AS n FROM customer)")
def graph_document(spark, sf):
    c = a.read(spark, sf, "customer")
    nodes = c.select(F.col("c_custkey").cast("string").alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.array(F.concat(F.lit("f"), F.col("c_custkey").cast("string")))).otherwise(F.array().cast("array<string>")).alias("files"))
    edges = a.tree(spark, sf).select(F.col("name").cast("string").alias("source"), F.col("base").cast("string").alias("target"))
    return graph.document(nodes, edges).select("name", "in_degree", "out_degree", F.array_join("files", ",").alias("files"))


@query("SELECT o_custkey AS name, arg_min(o_orderstatus, o_orderkey) AS kind, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS files FROM orders GROUP BY 1")
def accumulated_sets(spark, sf):
    o = a.read(spark, sf, "orders").select(F.col("o_custkey").alias("name"), F.col("o_orderstatus").alias("kind"), F.array("o_orderpriority").alias("files"), F.col("o_orderkey").alias("seq"))
    return upsert.accumulate_sets(o, sets=("files",)).select("name", "kind", F.array_join("files", ",").alias("files"))


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT n_regionkey + 100 AS s, n_nationkey AS t FROM nation UNION SELECT DISTINCT s_nationkey, s_suppkey + 1000 FROM supplier), l1 AS (SELECT t AS n, row_number() OVER (ORDER BY t) AS r FROM e WHERE s = 101),
m AS (SELECT e.t AS n, min(l1.r) AS above FROM e JOIN l1 ON e.s = l1.n GROUP BY 1) SELECT n AS node, 1 AS depth, r AS rank FROM l1 UNION ALL SELECT n, 2, (SELECT count(*) FROM l1) + row_number() OVER (ORDER BY above, n) FROM m"""
)
def impact_ranks(spark, sf):
    up = _rows(spark, sf, "SELECT DISTINCT CAST(n_nationkey AS BIGINT) AS src, CAST(n_regionkey + 100 AS BIGINT) AS dst FROM {nation} UNION SELECT DISTINCT s_suppkey + 1000, CAST(s_nationkey AS BIGINT) FROM {supplier}")
    return closure.impact_ordered(up, 101, 3)
