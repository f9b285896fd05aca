"""INI configuration: files, lines, sections, declarations and their references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators.fold import running_section

#: Roots of configuration, the forms of a declaration, of a struct's field and of a directory in it, and fields that are rules.
ROOTS = ("config", "plugins", "platforms")
ASSIGNMENT = r"^([+\-.!]?)\s*([^=]+?)\s*=\s*(.*)$"
STRUCT_FIELD = r"([A-Za-z_]\w*)\s*=\s*(\"[^\"]*\"|[^,()]+)"
DIRECTORY = r"\bPath\s*=\s*\"(/[^\"]+)\""
RULES = ("Priority", "ChunkId", "bApplyRecursively", "CookRule")


def ini_files(files: DataFrame) -> DataFrame:
    """``*.ini`` below the configuration roots, in folded path order of (rel)."""
    first = F.lower(F.substring_index("rel", "/", 1))
    return files.filter(F.endswith(F.lower("rel"), F.lit(".ini")) & first.isin(*ROOTS) & ~t.in_skipped(F.col("rel"), t.SKIPPED_CONFIG))


def parse(files: DataFrame, file: str = "path", content: str = "text") -> DataFrame:
    """(file, line, section, operator, key, value): declarations below section headers; comments and blank lines are left out.

    A section is told by the last header at or above a line; the operator is ``+ - . !`` before the key, else ``set``.
    """
    rows = files.select(F.col(file).alias("file"), F.posexplode(F.split(F.regexp_replace(content, "^\\uFEFF", ""), r"\r\n|\r|\n", -1)).alias("p", "raw"))
    rows = rows.select("file", (F.col("p") + 1).alias("line"), F.regexp_replace("raw", r"^\s+|\s+$", "").alias("raw"))
    header = F.when(F.col("raw").rlike(r"^\[.*\]$"), F.trim(F.regexp_extract("raw", r"^\[(.*)\]$", 1)))
    told = running_section(rows, header, "file", "line").withColumn("section", F.coalesce("section", F.lit("")))
    body = told.filter(header.isNull() & F.col("raw").rlike(ASSIGNMENT) & ~F.col("raw").rlike(r"^[;#]"))
    part = lambda k: F.regexp_extract("raw", ASSIGNMENT, k)
    return body.select("file", "line", "section", F.when(part(1) == "", "set").otherwise(part(1)).alias("operator"), part(2).alias("key"), part(3).alias("value"))


def struct_fields(value) -> object:
    """Fields of ``(A=1,B="x")`` as a map; later duplicates win. Quoted values lose their quotes."""
    pairs = lambda k: F.regexp_extract_all(value, F.lit(STRUCT_FIELD), F.lit(k))
    made = F.zip_with(pairs(1), pairs(2), lambda k, v: F.struct(k.alias("k"), F.regexp_replace(F.trim(v), '^"+|"+$', "").alias("v")))
    names = F.array_distinct(F.transform(made, lambda x: x["k"]))
    return F.map_from_arrays(names, F.transform(names, lambda k: F.element_at(F.filter(made, lambda x: x["k"] == k), -1)["v"]))


def declaration_references(declarations: DataFrame) -> DataFrame:
    """Declarations with their references: object paths and tags in the value, and values that read like tags where section or key speaks of tags."""
    refs = t.references(F.col("value"))
    hinted = F.contains(F.lower(F.concat_ws(".", "section", "key")), F.lit("tag")) & t.looks_like_tag(F.col("value"))
    target = F.regexp_replace(F.trim("value"), '^"+|"+$', "")
    tag = F.when(hinted, F.array(F.struct(F.lit("gameplay_tag").alias("kind"), target.alias("target")))).otherwise(F.slice(refs, 1, 0))
    return declarations.withColumn("references", F.array_sort(F.array_distinct(F.concat(refs, tag))))


def primary_asset_types(declarations: DataFrame) -> DataFrame:
    """Primary-asset types that asset-manager settings declare as structs: type, base class, flags, sorted directories and assets, and rules."""
    d = declarations.filter(F.endswith("section", F.lit("AssetManagerSettings")) & (F.col("key") == "PrimaryAssetTypesToScan"))
    d = d.withColumn("f", struct_fields(F.col("value"))).filter(F.coalesce(F.col("f")["PrimaryAssetType"], F.lit("")) != "")
    directories = F.array_sort(F.array_distinct(F.regexp_extract_all("value", F.lit(DIRECTORY), F.lit(1))))
    assets = F.transform(F.filter(t.references(F.col("value")), lambda r: (r["kind"] == "asset") & ~F.array_contains(directories, r["target"])), lambda r: r["target"])
    flag = lambda k: F.coalesce(F.lower(F.col("f")[k]) == "true", F.lit(False))
    return d.select(
        "file", "line", "operator", F.col("f")["PrimaryAssetType"].alias("primary_asset_type"), F.col("f")["AssetBaseClass"].alias("asset_base_class"),
        flag("bHasBlueprintClasses").alias("has_blueprint_classes"), flag("bIsEditorOnly").alias("is_editor_only"), directories.alias("directories"),
        F.array_sort(assets).alias("specific_assets"), F.map_filter("f", lambda k, v: k.isin(*RULES)).alias("rules"),
    )
