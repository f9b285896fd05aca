"""Fact documents as a stream: each micro-batch is upserted into a node table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import Versions


def table(spark: SparkSession, target: str) -> DataFrame | None:
    """The node table at ``target`` as the last finished batch left it."""
    at = Versions(spark, target).current()
    return spark.read.parquet(at) if at else None


def upsert_batch(target: str, buckets: int = 64):
    """A ``foreachBatch`` function: the table at ``target`` keeps the last row (seq; of equal ones the largest) of each node.

    The table is dealt into ``buckets`` folders by node. A batch writes a new version in which only the buckets that it touches are merged anew, while
    the rows of others are copied as they are; the version counts from the moment when it is named, so a stop at any place leaves the table
    as it was before the batch. Runs of one batch twice give the same table.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        versions, cols = Versions(spark, target), batch.columns
        now, name = versions.current(), f"batch{epoch}"
        if now is not None and now.endswith(f"/v-{name}"):
            return  # this batch is in the table
        new = batch.withColumn("__bucket", F.pmod(F.xxhash64("node_id"), F.lit(buckets)).cast("int"))
        rest = [c for c in cols if c != "node_id"]
        last = lambda d: d.groupBy("__bucket", "node_id").agg(F.max(F.struct("seq", F.struct(*[c for c in rest if c != "seq"]).alias("o"))).alias("r")).select("__bucket", "node_id", "r.seq", "r.o.*").select(*cols, "__bucket")
        if now is None:
            out = last(new)
        else:
            old = spark.read.schema(new.schema).parquet(now)
            touched = [r[0] for r in new.select("__bucket").distinct().collect()]  # at most the number of buckets
            hit = F.col("__bucket").isin(touched) if touched else F.lit(False)
            out = last(new.unionByName(old.filter(hit))).unionByName(old.filter(~hit))
        out.write.partitionBy("__bucket").parquet(versions.place(name))
        versions.name(name)

    return run


def stream_nodes(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str):
    """Start the stream of node rows (node_id, ..., seq) from JSON files; it ends when the files there now are read."""
    rows = spark.readStream.schema(schema).json(source)
    return rows.writeStream.foreachBatch(upsert_batch(target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
