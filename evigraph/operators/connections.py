"""Resolution of tool connections: candidates, compatibility and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a part of a tool's name says that a server can do.
MARKERS = {"asset": "assets", "blueprint": "blueprints", "material": "materials", "tag": "gameplay_tags", "data_table": "data_tables", "config": "config", "level": "levels"}


def inventory(tools: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """Names ``mcp__server__tool`` grouped by server, with metadata (server_id, display_name, metadata, healthy) where given."""
    parts = F.split("name", "__", 3)
    own = tools.filter(F.startswith("name", F.lit("mcp__")) & (F.size(parts) == 3) & (parts[1] != "") & (parts[2] != ""))
    grouped = own.groupBy(parts[1].alias("server_id")).agg(F.array_sort(F.collect_set(parts[2])).alias("tool_names"))
    if metadata is None:
        return grouped.select("server_id", F.col("server_id").alias("display_name"), "tool_names", F.create_map().cast("map<string,string>").alias("metadata"), F.lit(True).alias("healthy"))
    return grouped.join(metadata, "server_id", "left").withColumn("display_name", F.coalesce("display_name", "server_id")).withColumn("healthy", F.coalesce("healthy", F.lit(True)))


def capabilities(tool_names: Column) -> Column:
    """Sorted capabilities that the tools' names imply."""
    return F.array_sort(F.array_compact(F.array(*[F.when(F.exists(tool_names, _holds(m)), F.lit(c)) for m, c in MARKERS.items()])))


def _holds(marker: str):
    return lambda t: F.contains(F.lower(t), F.lit(marker))


def compatible(connections: DataFrame, required: list[str], version: tuple[int, int] | None = None, read_only: bool = False, project: str | None = None) -> DataFrame:
    """Connections with ``reasons`` (codes of what speaks against each); none is compatible."""
    from ..functions.text import version as read

    meta = lambda k: F.col("metadata")[k]
    reasons = [F.when(~F.col("healthy"), "connection-unhealthy")]
    if version is not None:
        seen = read(meta("engine_version"))
        reasons += [F.when(seen.isNull(), "engine-version-not-declared"), F.when(seen.isNotNull() & ((seen["major"] != version[0]) | (seen["minor"] != version[1])), "engine-version-mismatch")]
    if read_only:
        reasons.append(F.when(F.coalesce(F.lower(meta("read_only")), F.lit("")) != "true", "read-only-not-declared"))
    lacking = F.array_except(F.array(*[F.lit(r) for r in required]).cast("array<string>"), capabilities(F.col("tool_names")))
    reasons.append(F.when(F.size(lacking) > 0, "capabilities-missing"))
    if project is not None:
        same = F.lower(F.replace(meta("project_path"), F.lit("\\"), F.lit("/"))) == project.replace("\\", "/").lower()
        reasons += [F.when(meta("project_path").isNull(), "project-not-declared"), F.when(meta("project_path").isNotNull() & ~same, "project-mismatch")]
    return connections.withColumn("missing", lacking).withColumn("reasons", F.array_compact(F.array(*reasons)))


def connection_status(checked: DataFrame) -> DataFrame:
    """One row: missing without candidates, ambiguous or available by compatible ones, unhealthy if all are, else incompatible."""
    c = checked.agg(F.count("*").alias("n"), F.count_if(F.size("reasons") == 0).alias("good"), F.count_if(~F.col("healthy")).alias("ill"), F.min(F.when(F.size("reasons") == 0, F.col("server_id"))).alias("server_id"))
    state = F.when(F.col("n") == 0, "missing").when(F.col("good") > 1, "ambiguous").when(F.col("good") == 1, "available").when(F.col("ill") == F.col("n"), "unhealthy").otherwise("incompatible")
    return c.select(state.alias("status"), F.when(F.col("good") == 1, F.col("server_id")).alias("server_id"), "n", "good")
