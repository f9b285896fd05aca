"""Order-aware merges: the table semantics of nodes, relations and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def first_by(value: str, seq: str = "seq") -> Column:
    return F.min_by(value, seq)


def is_told(value: Column, text: bool = True) -> Column:
    """Whether an observation says something: not null, and not an empty text. Zero and false count."""
    return value.isNotNull() & (value != F.lit("")) if text else value.isNotNull()


def upsert_nodes(rows: DataFrame, key: str = "node_id", seq: str = "seq", first: tuple[str, ...] = ("kind", "name"), last: tuple[str, ...] = ()) -> DataFrame:
    """One row per key: ``first`` columns from the first observation, ``last`` ones from the last that says something, else from the first."""
    kinds = dict(rows.dtypes)
    out = [F.min_by(c, seq).alias(c) for c in first]
    for c in last:
        told = F.max_by(F.col(c), F.when(is_told(F.col(c), kinds[c] == "string"), F.col(seq)))
        out.append(F.coalesce(F.when(F.max(is_told(F.col(c), kinds[c] == "string").cast("int")) == 1, told), F.min_by(c, seq)).alias(c))
    return rows.groupBy(key).agg(*out)


def merge_maps(rows: DataFrame, key: str = "node_id", seq: str = "seq", properties: str = "properties", nulls_override: bool = True) -> DataFrame:
    """Shallow merge of property maps by key and field: the last observation wins; without ``nulls_override`` empty values do not."""
    fields = rows.select(key, F.col(seq).alias("__s"), F.explode(properties).alias("field", "value"))
    at = F.struct("__s", "value")  # of equal places the largest value
    value = F.max_by("value", at) if nulls_override else F.coalesce(F.max_by("value", F.when(is_told(F.col("value")), at)), F.min_by("value", at))
    merged = fields.groupBy(key, "field").agg(value.alias("value"))
    return merged.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias(properties))


def upsert_relations(rows: DataFrame, key: str = "relation_id", seq: str = "seq") -> DataFrame:
    """One row per relation, the first in order; what follows only adds evidence."""
    rest = [c for c in rows.columns if c not in (key, seq)]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), seq).alias("r")).select(key, "r.*")


def last_wins(rows: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    rest = [c for c in rows.columns if c not in (key, seq)]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(key, "r.*")


def accumulate_sets(rows: DataFrame, key: str = "name", sets: tuple[str, ...] = ("files", "base_types")) -> DataFrame:
    """Dependency-graph nodes: first kind wins, array columns are united and sorted."""
    united = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in sets]
    return rows.groupBy(key).agg(F.min_by("kind", "seq").alias("kind"), *united)
