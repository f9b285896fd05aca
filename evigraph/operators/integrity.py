"""Validation, difference and import of graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import cut

_RANK = {"error": 2, "warning": 1, "info": 0}


def problem(severity: str | Column, code: str | Column, subject: Column, detail: Column | None = None) -> list[Column]:
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    return [as_col(severity).alias("severity"), as_col(code).alias("code"), subject.cast("string").alias("subject"), (detail if detail is not None else F.lit(None)).cast("string").alias("detail")]


def status(problems: DataFrame) -> DataFrame:
    """(status, problem_count): the worst of error and warning, else ok; info never matters."""
    rank = F.max(F.when(F.col("severity") == "error", 2).when(F.col("severity") == "warning", 1).otherwise(0))
    return problems.agg(rank.alias("r"), F.count("*").alias("problem_count")).select(F.when(F.col("r") == 2, "error").when(F.col("r") == 1, "warning").otherwise("ok").alias("status"), "problem_count")


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(rows: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key is no parent's; a null key is one too."""
    return rows.join(parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def evidence_counts(relations: DataFrame, evidence: DataFrame, key: str = "relation_id") -> DataFrame:
    counted = evidence.groupBy(key).agg(F.count("*").alias("evidence_count"))
    return relations.select(key).distinct().join(counted, key, "left").na.fill(0, ["evidence_count"])


def validate_graph(nodes: DataFrame, relations: DataFrame, evidence: DataFrame, declared: dict[str, int] | None = None) -> DataFrame:
    """Problem rows of six checks: duplicate nodes and relations, dangling ends and evidence, missing evidence, counts.

    Declared counts are compared with distinct nodes and relations, and with all evidence rows. The ids are read once and checkpointed; one aggregation by
    node id and one by relation id then tell all but the rows that dangle, which are looked up by the few ids that have no parent.
    """
    n = cut(nodes.select("node_id"))
    r = cut(relations.select("relation_id", "source_id", "target_id"))
    e = cut(evidence.select("evidence_id", "relation_id"))
    ends = r.select("relation_id", F.explode(F.array("source_id", "target_id")).alias("node_id"))
    at = n.select("node_id", F.lit(1).alias("own")).unionByName(ends.select("node_id", F.lit(0).alias("own")))
    by_node = cut(at.groupBy("node_id").agg(F.sum("own").alias("own")).filter("own <> 1"))
    of = r.select("relation_id", F.lit(1).alias("own"), F.lit(0).alias("told")).unionByName(e.select("relation_id", F.lit(0).alias("own"), F.lit(1).alias("told")))
    by_relation = cut(of.groupBy("relation_id").agg(F.sum("own").alias("own"), F.sum("told").alias("told")).filter("own <> 1 or told = 0"))
    null = F.col("node_id").isNull()
    missing = ends.join(by_node.filter("own = 0").select("node_id"), "node_id", "left_semi").unionByName(ends.filter(null).select("node_id", "relation_id"))
    dangling = missing.groupBy("relation_id").agg(F.array_join(F.array_sort(F.collect_set("node_id")), ",").alias("missing"))
    lost = e.join(by_relation.filter("own = 0").select("relation_id"), "relation_id", "left_semi").unionByName(e.filter("relation_id is null").select("relation_id", "evidence_id"))
    parts = [
        by_node.filter("own > 1").select(*problem("error", "duplicate-node-id", F.col("node_id"))),
        by_relation.filter("own > 1").select(*problem("error", "duplicate-relation-id", F.col("relation_id"))),
        dangling.select(*problem("error", "dangling-relation-endpoint", F.col("relation_id"), F.col("missing"))),
        lost.select(*problem("error", "dangling-evidence", F.col("evidence_id"))),
        by_relation.filter("own > 0 and told = 0").select(*problem("warning", "relation-evidence-missing", F.col("relation_id"))),
    ]
    if declared:
        counts = {"nodes": n.distinct(), "relations": r.select("relation_id").distinct(), "evidence": e}
        for name, want in declared.items():
            c = counts[name].agg(F.count("*").alias("n")).filter(F.col("n") != want)
            parts.append(c.select(*problem("error", "graph-count-mismatch", F.lit(name), F.concat_ws("/", F.lit(want), F.col("n")))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def diff_nodes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(canonical_key, change): added, removed, or changed where the properties differ; names and kinds alone do not count."""
    a = before.select("canonical_key", F.col("properties").alias("p"), F.lit(True).alias("was"))
    b = after.select("canonical_key", F.col("properties").alias("q"), F.lit(True).alias("is"))
    both = a.join(b, "canonical_key", "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(~F.col("p").eqNullSafe(F.col("q")), "changed")
    return both.select("canonical_key", change.alias("change")).filter("change is not null")


def key_sets(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, change): added, removed or common, for each distinct key of two tables. One aggregation."""
    both = before.select(key, F.lit(1).alias("was"), F.lit(0).alias("is")).unionByName(after.select(key, F.lit(0).alias("was"), F.lit(1).alias("is")))
    c = both.groupBy(key).agg(F.max("was").alias("was"), F.max("is").alias("is"))
    return c.select(key, F.when(F.col("was") == 0, "added").when(F.col("is") == 0, "removed").otherwise("common").alias("change"))


def relation_triples(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """(source_key, kind, target_key); relations with an unknown end have none."""
    keys = nodes.select("node_id", "canonical_key")
    s = keys.select(F.col("node_id").alias("source_id"), F.col("canonical_key").alias("source_key"))
    t = keys.select(F.col("node_id").alias("target_id"), F.col("canonical_key").alias("target_key"))
    return relations.join(s, "source_id").join(t, "target_id").select("source_key", "kind", "target_key").distinct()


def diff_relations(before: DataFrame, after: DataFrame) -> DataFrame:
    """Triples with ``change`` added or removed."""
    gone = before.join(after, before.columns, "left_anti").withColumn("change", F.lit("removed"))
    new = after.join(before, before.columns, "left_anti").withColumn("change", F.lit("added"))
    return gone.unionByName(new)


def import_graph(nodes: DataFrame, relations: DataFrame, evidence: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Foreign relations and evidence with local node ids (``ids``: foreign_id, local_id). A relation without evidence gets one empty row."""
    local = relations.join(ids.select(F.col("foreign_id").alias("source_id"), F.col("local_id").alias("s")), "source_id").join(ids.select(F.col("foreign_id").alias("target_id"), F.col("local_id").alias("t")), "target_id")
    mapped = local.select("relation_id", F.col("s").alias("source_id"), "kind", F.col("t").alias("target_id"))
    detail = mapped.select("relation_id").join(evidence.select("relation_id", "detail"), "relation_id", "left").withColumn("detail", F.coalesce("detail", F.lit("{}")))
    return mapped, detail
