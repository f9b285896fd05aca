"""Editor facts landed as tables: inventories, dependencies, tables, properties, tags, messages and primary assets.

The live editor is out of scope; its rows come as JSON or Parquet and these operators shape them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import numbered
from ..functions.text import references
from ..operators.messages import channel_status, classify

#: Registry tags that an inventory keeps, and kinds of dependency.
REGISTRY_TAGS = ("GeneratedClass", "ParentClass", "NativeParentClass", "BlueprintType", "RowStructure")
DEPENDENCIES = ("hard_package", "soft_package", "hard_manage", "soft_manage", "searchable_name")
EXTERNAL = ("/__ExternalActors__/", "/__ExternalObjects__/")


def is_logical(package: Column) -> Column:
    """Whether a package is content of its own, not an external actor's or object's."""
    return ~F.exists(F.array(*[F.lit(e) for e in EXTERNAL]), lambda e: F.contains(package, e))


def logical_only(rows: DataFrame, dependencies: str = "dependencies") -> DataFrame:
    """Rows of logical packages, with other packages also gone from their dependency lists (map of arrays)."""
    return rows.filter(is_logical(F.col("package"))).withColumn(dependencies, F.transform_values(dependencies, lambda k, v: F.filter(v, is_logical)))


def inventory(rows: DataFrame, classes: list[str] | None = None) -> DataFrame:
    """Assets (package, object_path, class, tags map) grouped by package; ``classes`` match in full or by leaf in any case."""
    if classes:
        want = [c.lower() for c in classes]
        rows = rows.filter(F.lower("class").isin(want) | F.lower(F.regexp_extract("class", r"([^./]+)$", 1)).isin(want))
    kept = F.map_filter("tags", lambda k, v: k.isin(*REGISTRY_TAGS) & (v != ""))
    return rows.groupBy("package").agg(F.array_sort(F.collect_list(F.struct("object_path", "class", F.to_json(kept).alias("registry_tags")))).alias("assets"))


def dependencies(rows: DataFrame) -> DataFrame:
    """(package, kind, target) to a column of sorted distinct targets per kind; an unknown kind is an error."""
    checked = rows.withColumn("kind", F.when(F.col("kind").isin(*DEPENDENCIES), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unknown dependency kind "), F.col("kind")))))
    return checked.groupBy("package").pivot("kind", list(DEPENDENCIES)).agg(F.array_sort(F.collect_set("target")))


def data_table_rows(tables: DataFrame, values: bool = True) -> DataFrame:
    """Rows of exported tables (asset, json: array of objects): name from Name, RowName or the position, references, values."""
    parsed = tables.select("asset", F.posexplode(F.from_json("json", "array<map<string,string>>")).alias("i", "row"))
    name = F.coalesce(F.col("row")["Name"], F.col("row")["RowName"], F.col("i").cast("string"))
    body = F.map_filter("row", lambda k, v: ~k.isin("Name", "RowName"))
    out = parsed.select("asset", name.alias("name"), references(F.concat_ws(" ", F.map_values(body))).alias("references"), F.to_json(body).alias("values"))
    return out if values else out.drop("values")


def blueprints(rows: DataFrame) -> DataFrame:
    """The latest row (seq) of each blueprint package."""
    own = rows.filter(F.lower(F.regexp_extract("class", r"([^./]+)$", 1)).rlike("blueprint$"))
    return own.groupBy("package").agg(F.max_by(F.struct(*[c for c in own.columns if c != "package"]), "seq").alias("r")).select("package", "r.*")


def inspect_graph(rows: DataFrame, max_nodes: int) -> DataFrame:
    """Graphs with at most ``max_nodes`` nodes and whether any were left out."""
    return rows.withColumn("truncated", F.size("nodes") > max_nodes).withColumn("nodes", F.slice("nodes", 1, max_nodes))


def structure(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blueprint structures assembled by asset from rows (asset, part, name, detail, error); failures become problem rows."""
    good, bad = rows.filter("error is null"), rows.filter("error is not null")
    parts = good.groupBy("asset").pivot("part", ["variable", "function", "event", "component", "graph", "reference"]).agg(F.array_sort(F.collect_set(F.struct("name", "detail"))))
    problems = bad.select(F.lit("warning").alias("severity"), F.lit("blueprint-structure-scan-failed").alias("code"), F.col("asset").alias("subject"), F.col("error").alias("detail"))
    return parts, problems


def tags(rows: DataFrame, prefix: str = "") -> DataFrame:
    return rows.filter(F.startswith("tag", F.lit(prefix))).select("tag").distinct()


def tag_referencers(rows: DataFrame) -> DataFrame:
    return rows.groupBy("tag").agg(F.array_sort(F.collect_set("referencer")).alias("referencers"))


def message_nodes(rows: DataFrame) -> DataFrame:
    """Message operations of nodes (asset, graph, node, node_class, type_id, inputs array of pin names, self_title, connections, tag): others are left out."""
    out = rows.withColumn("operation", classify(F.col("node_class"), F.col("inputs"), F.col("self_title"), F.col("type_id"))).filter("operation is not null")
    return out.withColumn("channel_status", channel_status(F.col("connections"), F.col("tag")))


def message_summary(operations: DataFrame, scanned: DataFrame) -> DataFrame:
    """One row: distinct scanned assets, operations, and distinct static channels."""
    c = operations.agg(F.count("*").alias("message_operation_count"), F.countDistinct(F.when(F.col("channel_status") == "static", F.col("tag"))).alias("static_channel_count"))
    return scanned.agg(F.countDistinct("asset").alias("scanned_asset_count")).join(c)  # a row with a row


def in_batches(rows: DataFrame, key: str, size: int, most: int = 200) -> DataFrame:
    """Rows with the number of the batch of at most ``size`` distinct keys, in folded order, that theirs belongs to. Sizes over ``most`` are errors.

    Keys are numbered by distributed counts of ranges, not in one task.
    """
    if not 1 <= size <= most:
        raise ValueError(f"a batch has 1 to {most} members")
    keys = numbered(rows.select(key).distinct(), [F.lower(key), F.col(key)], "__n")
    return rows.join(keys.select(key, F.floor(F.col("__n") / size).cast("long").alias("batch")), key)


def primary_assets(rows: DataFrame) -> DataFrame:
    """(type, name, object_path, root): names fall back to the object's leaf; per type its assets and set of roots."""
    name = F.coalesce(F.nullif("name", F.lit("")), F.regexp_extract("object_path", r"([^./]+)$", 1))
    return rows.withColumn("name", name).groupBy("type").agg(F.array_sort(F.collect_list(F.struct("name", "object_path"))).alias("assets"), F.array_sort(F.collect_set("root")).alias("roots"))


def editor_state(packages: DataFrame, allow_dirty: bool = False) -> DataFrame:
    """One row: sorted dirty packages, and the problem that they are for a build."""
    c = packages.filter("dirty").agg(F.array_sort(F.collect_set("package")).alias("dirty_packages"))
    level = "warning" if allow_dirty else "error"
    return c.withColumn("severity", F.when(F.size("dirty_packages") > 0, level)).withColumn("code", F.when(F.size("dirty_packages") > 0, "dirty-editor-packages"))


def select_session(sessions: DataFrame, node_id: str) -> DataFrame:
    """(status, count) of an exact session id: none and several are errors."""
    return sessions.filter(F.col("node_id") == node_id).agg(F.count("*").alias("count")).select(F.when(F.col("count") == 1, "resolved").when(F.col("count") > 1, "ambiguous").otherwise("missing").alias("status"), "count")


def registry_counts(rows: DataFrame, count_only: list[str]) -> DataFrame:
    """Dependency counts by (package, kind) with targets except for the kinds that are only counted."""
    return rows.groupBy("package", "kind").agg(F.count("*").alias("n"), F.array_sort(F.collect_set(F.when(~F.col("kind").isin(count_only), F.col("target")))).alias("targets"))
