"""Ordered folds of configuration operators, running sections and first-occurrence duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold_declarations(rows: DataFrame, by: list[str], seq: str = "seq", op: str = "operator", value: str = "value") -> DataFrame:
    """Final value lists by group: ``!`` clears, ``-`` removes all equal, ``+`` appends if absent, ``.`` appends, ``set`` replaces.

    What remains follows from three aggregations, so a group's declarations need not meet in one task: those after the last clearing of their
    group, of them those after the last removal of their value, and of additions the first of their value. A group with nothing left has an empty list.
    """
    r = rows.select(F.struct(*by).alias("k"), F.col(seq).alias("s"), F.col(op).alias("o"), F.col(value).alias("v"))  # structs are equal with nulls inside
    cuts = r.groupBy("k").agg(F.max(F.when(F.col("o").isin("!") | ~F.col("o").isin("!", "-", "+", "."), F.col("s"))).alias("cut"))
    live = r.join(cuts, "k").filter(F.col("cut").isNull() | (F.col("s") > F.col("cut")) | (F.col("s") == F.col("cut")) & (F.col("o") != "!"))
    told = live.select("k", F.struct("v").alias("w"), "s", "o")
    gone = told.filter("o = '-'").groupBy("k", "w").agg(F.max("s").alias("gone"))
    left = told.filter("o <> '-'").join(gone, ["k", "w"], "left").filter("gone is null or s > gone")
    first = left.groupBy("k", "w").agg(F.min("s").alias("first"))
    kept = left.join(first, ["k", "w"]).filter("o <> '+' or s = first")
    lists = kept.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("s", F.col("w.v").alias("v")))), lambda x: x["v"]).alias("values"))
    kind = dict(rows.dtypes)[value]
    return cuts.select("k").join(lists, "k", "left").select("k.*", F.coalesce("values", F.array().cast(f"array<{kind}>")).alias("values"))


def running_section(lines: DataFrame, section: Column, by: str = "file", line: str = "line") -> DataFrame:
    """Lines with the last non-null ``section`` at or above them in their file."""
    w = Window.partitionBy(by).orderBy(line).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.last(section, ignorenulls=True).over(w))


def duplicate_names(rows: DataFrame, name: str = "name", pointer: str = "pointer", seq: str = "seq") -> DataFrame:
    """Folded names declared more than once: (key, n, first pointer)."""
    return rows.groupBy(F.lower(F.col(name)).alias("key")).agg(F.count("*").alias("n"), F.min_by(pointer, seq).alias("first")).filter("n > 1")


def ordered_distinct(rows: DataFrame, by: str, value: str, seq: str = "seq") -> DataFrame:
    """Distinct values by group in order of first occurrence."""
    first = rows.groupBy(by, value).agg(F.min(seq).alias("s"))
    return first.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("s", value))), lambda x: x[value]).alias("values"))
