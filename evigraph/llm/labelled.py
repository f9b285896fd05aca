"""A bounded sample of labelled documents, chosen by hash, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Remainder of crc32(doc_id as text) mod 4 that is never learned from.
HELD_OUT, FOLDS = 2, 4


def fold(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS


def is_held_out(key: str = "doc_id"):
    return F.coalesce(fold(key) == HELD_OUT, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, per_class: int, label: str = "quality", key: str = "doc_id", text: str = "text") -> DataFrame:
    """At most ``per_class`` documents of label 0 and of label 1, whole: (__id, __label, __text).

    The least hashes of the ids are taken, so the choice does not depend on partitioning. Rows with a null id or another
    label, and held-out rows, are left out. An id that several documents have counts once, with its least text; one with both labels
    is in both classes.
    """
    ids = []
    for value in (0, 1):
        rows = labels.filter((F.col(label) == value) & F.col(key).isNotNull() & ~is_held_out(key))
        ids.append(rows.select(F.col(key).alias("__id"), F.lit(value).alias("__label")).distinct().orderBy(F.xxhash64("__id"), "__id").limit(per_class))
    chosen = ids[0].unionByName(ids[1])
    own = docs.select(F.col(key).alias("__id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    found = own.join(F.broadcast(chosen), "__id")  # at most 2 * per_class ids
    return found.groupBy("__id", "__label").agg(F.min("__text").alias("__text"))


def within(chosen: DataFrame, most: int) -> DataFrame:
    """The rows of ``chosen`` (see ``sample``), by class in order of their hashes, until the next one would bring its class over ``most`` bytes of text.

    It bounds what a fit collects by rows, each of them whole; a class whose first text alone is over ``most`` keeps that one.
    """
    order = Window.partitionBy("__label").orderBy(F.xxhash64("__id"), "__id")
    size = F.octet_length("__text").cast("long")
    upto = F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return chosen.withColumn("__upto", upto).withColumn("__nr", F.row_number().over(order)).filter((F.col("__upto") <= most) | (F.col("__nr") == 1)).drop("__upto", "__nr")
