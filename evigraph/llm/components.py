"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _mark(e: DataFrame) -> tuple:
    r = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return r[0], r[1]


def _large(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every neighbour above a node tied to the least of its neighbours and itself; and the table of the least ones, which is written."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialise(both.groupBy("u").agg(F.min("v").alias("n")).select("u", F.least("u", "n").alias("m")), "least")
    # as they are a written table, a hub's rows can be split among tasks when they meet it
    return both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct(), least


def _small(e: DataFrame) -> DataFrame:
    """Every neighbour below a node tied to the least of them; hubs are the least nodes of their edges by now, so no node has many."""
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    rest = down.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``edges`` (u, v) of an ordered type to (u, v) with ``v`` the least node of u's component, for every u but the least.

    Each round is two aggregations and joins over the edges; a component's edges shrink to a star in about
    log(size) rounds. The edge table is written each round, so lineage stays short and nothing is collected; tables that nothing
    reads any more go.
    """
    e = materialise(edges.filter("u != v").distinct(), "edges")
    before = _mark(e)
    for _ in range(most_rounds):
        if before[0] == 0:
            return e
        large, least = _large(e)
        after = materialise(_small(large), "edges")
        discard(e), discard(least)
        e, now = after, _mark(after)
        if now == before:
            return e
        before = now
    raise RuntimeError("components did not settle")
