"""Descriptors: declarations, enumerations and field types, with every fault as a problem row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import pointer_escape

#: What descriptors may say.
HOST_TYPES = ("Runtime", "RuntimeNoCommandlet", "RuntimeAndProgram", "CookedOnly", "UncookedOnly", "Developer", "DeveloperTool", "Editor", "EditorNoCommandlet", "EditorAndProgram", "Program", "ServerOnly", "ClientOnly", "ClientOnlyNoCommandlet")
LOADING_PHASES = ("EarliestPossible", "PostConfigInit", "PostSplashScreen", "PreEarlyLoadingScreen", "PreLoadingScreen", "PreDefault", "Default", "PostDefault", "PostEngineInit", "None")
TARGET_TYPES = ("Game", "Editor", "Client", "Server", "Program")
CONFIGURATIONS = ("Unknown", "Debug", "DebugGame", "Development", "Test", "Shipping")


def items(documents: DataFrame, field: str) -> DataFrame:
    """(path, i, item JSON) of an array field of JSON documents (path, document)."""
    return documents.select("path", F.posexplode(F.from_json(F.get_json_object("document", f"$.{field}"), "array<string>")).alias("i", "item"))


def _problem(df: DataFrame, when: Column, severity: str, code: str, pointer: Column) -> DataFrame:
    return df.filter(when).select("path", F.lit(severity).alias("severity"), F.lit(code).alias("code"), pointer.alias("pointer"))


def _at(field: str, sub: str | None = None) -> Column:
    base = F.concat(F.lit(f"/{field}/"), F.col("i").cast("string"))
    return F.concat(base, F.lit("/"), pointer_escape(F.lit(sub))) if sub else base


def plugin_references(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, i, name, enabled, optional) and problems: items that are no objects or have no name, and names declared twice."""
    rows = items(documents, "Plugins")
    name = F.get_json_object("item", "$.Name")
    ok = F.startswith("item", F.lit("{")) & name.isNotNull() & (name != "")
    good = rows.filter(ok).select("path", "i", name.alias("name"), F.coalesce(F.get_json_object("item", "$.Enabled") == "true", F.lit(False)).alias("enabled"), F.coalesce(F.get_json_object("item", "$.Optional") == "true", F.lit(False)).alias("optional"))
    bad = _problem(rows, ~F.coalesce(ok, F.lit(False)), "error", "invalid-plugin-reference", _at("Plugins"))
    twice = good.groupBy("path", F.lower("name").alias("k")).agg(F.count("*").alias("n"), F.min("i").alias("i")).filter("n > 1")
    return good, bad.unionByName(_problem(twice, F.lit(True), "error", "duplicate-plugin-reference", _at("Plugins", "Name")))


def modules(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, i, name, type, loading_phase) and problems: shapes, unknown host types and phases, repeated names."""
    rows = items(documents, "Modules")
    get = lambda k: F.get_json_object("item", f"$.{k}")
    ok = F.coalesce(F.startswith("item", F.lit("{")) & get("Name").isNotNull(), F.lit(False))
    good = rows.filter(ok).select("path", "i", get("Name").alias("name"), get("Type").alias("type"), F.coalesce(get("LoadingPhase"), F.lit("Default")).alias("loading_phase"))
    problems = _problem(rows, ~ok, "error", "invalid-plugin-module", _at("Modules"))
    problems = problems.unionByName(_problem(good, F.col("type").isNull() | ~F.col("type").isin(*HOST_TYPES), "error", "invalid-plugin-module-enum-value", _at("Modules", "Type")))
    problems = problems.unionByName(_problem(good, ~F.col("loading_phase").isin(*LOADING_PHASES), "error", "invalid-plugin-module-enum-value", _at("Modules", "LoadingPhase")))
    twice = good.groupBy("path", F.lower("name").alias("k")).agg(F.count("*").alias("n"), F.min("i").alias("i")).filter("n > 1")
    return good, problems.unionByName(_problem(twice, F.lit(True), "error", "duplicate-module-declaration", _at("Modules", "Name")))


def enum_arrays(documents: DataFrame, field: str, sub: str, allowed: tuple[str, ...], code: str) -> DataFrame:
    """Problems of an enum array inside an array field: each value that is not allowed, with its pointer."""
    rows = items(documents, field).select("path", "i", F.posexplode(F.from_json(F.get_json_object("item", f"$.{sub}"), "array<string>")).alias("j", "v"))
    at = F.concat(_at(field, sub), F.lit("/"), F.col("j").cast("string"))
    return _problem(rows, ~F.col("v").isin(*allowed), "error", code, at)


def field_types(documents: DataFrame, expected: dict[str, str]) -> DataFrame:
    """Problems of top-level fields whose JSON type is not the expected one (STRING, BIGINT, BOOLEAN, ARRAY, OBJECT)."""
    v = F.try_parse_json("document")
    out = None
    for field, kind in expected.items():
        seen = F.schema_of_variant(F.try_variant_get(v, f"$.{field}", "variant"))
        bad = seen.isNotNull() & (seen != "VOID") & ~F.startswith(seen, F.lit(kind))
        part = documents.filter(bad).select("path", F.lit("error").alias("severity"), F.lit("invalid-field-type").alias("code"), F.lit(f"/{field}").alias("pointer"))
        out = part if out is None else out.unionByName(part)
    return out
