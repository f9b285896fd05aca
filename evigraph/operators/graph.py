"""Degrees, summaries, search, visibility and evidence of a node and edge table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dependency_edges(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Edges as a set: self-edges and repeated rows go."""
    return edges.filter(F.col(source) != F.col(target)).dropDuplicates()


def degrees(nodes: DataFrame, edges: DataFrame, key: str = "node_id", source: str = "source_id", target: str = "target_id") -> DataFrame:
    """Nodes with in_degree and out_degree. Ends that are no node count for nobody, and edges to them do not count."""
    ends = edges.select(F.col(source).alias(key), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col(target).alias(key), F.lit(0).alias("o"), F.lit(1).alias("i")))
    counted = ends.groupBy(key).agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))  # one shuffle for both ends
    return nodes.join(counted, key, "left").na.fill(0, ["out_degree", "in_degree"])


def totals(**tables: DataFrame) -> DataFrame:
    """(what, count) of each table."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("count")).select(F.lit(name).alias("what"), "count")
        out = row if out is None else out.unionByName(row)
    return out


def kind_histogram(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("kind").agg(F.count("*").alias("count"))


def hide_kinds(nodes: DataFrame, edges: DataFrame, hidden: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes of other kinds, and the edges that keep both ends."""
    seen = nodes.filter(~F.col("kind").isin(hidden)) if hidden else nodes
    ids = seen.select("node_id")
    kept = edges.join(ids.withColumnRenamed("node_id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("node_id", "target_id"), "target_id", "left_semi")
    return seen, kept.select(*edges.columns)


def search(nodes: DataFrame, text: str, limit: int = 30) -> DataFrame:
    """Nodes whose name or path holds ``text`` (any case): whole-name matches first, then by kind, name and id."""
    low = text.lower()
    name = F.lower("name")
    hit = F.contains(name, F.lit(low)) | F.contains(F.lower(F.coalesce(F.col("path").cast("string"), F.lit(""))), F.lit(low))
    return nodes.filter(hit).orderBy(F.when(name == low, 0).otherwise(1), "kind", name, "node_id").limit(limit)


def root_node(nodes: DataFrame, kind: str, by: str = "path") -> DataFrame:
    return nodes.filter(F.col("kind") == kind).orderBy(by, "node_id").limit(1)


def attach_evidence(edges: DataFrame, evidence: DataFrame, key: str = "edge_id") -> DataFrame:
    """Edges with their evidence as an array ordered by path in any case, then line."""
    item = F.struct(F.lower("path").alias("order"), "line", "path", "evidence_id")
    found = evidence.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("evidence"))
    return edges.join(found, key, "left").withColumn("evidence", F.coalesce("evidence", F.array().cast(found.schema["evidence"].dataType)))


def node_relations(edges: DataFrame, node_id: str | Column) -> DataFrame:
    """Edges at a node with their direction; a self-edge goes out."""
    node = F.lit(node_id) if isinstance(node_id, str) else node_id
    out = edges.filter((F.col("source_id") == node) | (F.col("target_id") == node))
    return out.withColumn("direction", F.when(F.col("source_id") == node, "outgoing").otherwise("incoming"))


def override_chain(rows: DataFrame, by: list[str], seq: str = "seq", key: str = "declaration_id") -> DataFrame:
    """Each row with the previous one of its group in order, or null."""
    return rows.withColumn("previous", F.lag(key).over(Window.partitionBy(*by).orderBy(seq)))


def document(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Dependency-graph nodes with degrees; empty members are null."""
    none = lambda c: F.when(F.size(c) > 0, F.col(c))
    out = degrees(nodes, edges, "name", "source", "target")
    return out.withColumns({c: none(c) for c in ("files", "base_types") if c in nodes.columns})
