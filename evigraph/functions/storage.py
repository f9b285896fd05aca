"""Cutting lineage in the folder that the session names for checkpoints, numbering rows, and replacing tables whole."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed reliably. Where the session names no folder, a local session gets one of its own; on a cluster that is an error."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="evigraph-ckpt-"))
    return df.checkpoint()


def numbered(df: DataFrame, order: list[Column], name: str = "n") -> DataFrame:
    """``df`` with the place (from 0) of each row in ``order``: rows are dealt by range, and a range begins where the ones before it end."""
    dealt = cut(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    counts = dealt.groupBy("__p").agg(F.count("*").alias("__c"))  # a row for each range
    ahead = counts.select("__p", F.coalesce(F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1 + F.col("__before")
    return dealt.join(F.broadcast(ahead), "__p").withColumn(name, place.cast("long")).drop("__p", "__before")


class Versions:
    """Versions of a table side by side in one folder, each written whole and then named in a small file, so that a stop at any place leaves the one before.

    ``v-<name>`` folders hold versions and ``at-<number>`` files name them; the highest number counts. Old versions go when a newer one is named.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.folder, self.jvm = folder.rstrip("/"), spark.sparkContext._jvm
        self.fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _named(self) -> list[tuple[int, str]]:
        if not self.fs.exists(self.path("")):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self.path(""))]
        return sorted((int(n.split("-", 2)[1]), n.split("-", 2)[2]) for n in names if n.startswith("at-"))

    def current(self) -> str | None:
        """The folder of the version that counts."""
        named = self._named()
        return f"{self.folder}/v-{named[-1][1]}" if named else None

    def place(self, name: str) -> str:
        """A folder for a new version; what an earlier try left there goes."""
        self.fs.delete(self.path(f"v-{name}"), True)
        return f"{self.folder}/v-{name}"

    def name(self, name: str) -> None:
        """Make a written version the one that counts, and remove those before the last one: readers of that may still be at work."""
        named = self._named()
        if not named or named[-1][1] != name:
            self.fs.create(self.path(f"at-{(named[-1][0] if named else 0) + 1:08d}-{name}"), True).close()
        for number, old in named[:-1]:
            if old != name:
                self.fs.delete(self.path(f"v-{old}"), True)
            self.fs.delete(self.path(f"at-{number:08d}-{old}"), False)
