"""Chat formatting with cumulative-snapshot collapse.

Logs often hold the same conversation several times, each snapshot a turn longer than the last. Turns get a
rolling prefix hash; a conversation whose whole hash is a prefix hash of a longer one is dropped by an
anti-join, of equal ones the least ``conv_id`` stays, and what is left is rendered.

The prefix hash of turn ``k`` is the sum over turns ``i <= k`` of two 64-bit hashes of ``(i, role, text)``, kept as
four sums of 32-bit halves, so it can be built by blocks: positions and sums are counted inside blocks of ``TURNS``
consecutive turn numbers, the few block totals are accumulated per conversation, and the two are added. No task holds a
whole conversation, however long. A rendered conversation comes in parts of one block each.

Repeated rows of a conversation count once; rows that share a turn number are ordered by role and text. Rows with a null
``conv_id`` are one conversation; a null turn comes first; null role or text renders as empty. In a text, ``<|`` becomes
``< |`` so that it can't close a turn. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

TURNS = 1024
#: Kept conversations up to which their keys are broadcast.
SMALL = 200_000
START, END = "<|im_start|>", "<|im_end|>"
_SUMS = ("a", "b", "c", "d")


def _keyed(df: DataFrame) -> DataFrame:
    """Internal columns: k (text key of the conversation, null-safe), blk, turn, role, text."""
    return df.select(
        F.when(F.col("conv_id").isNull(), F.lit("n")).otherwise(F.concat(F.lit("c"), F.col("conv_id").cast("string"))).alias("k"),
        "conv_id",
        F.coalesce(F.floor(F.col("turn") / TURNS), F.lit(-(1 << 40))).cast("long").alias("blk"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def prefixes(df: DataFrame) -> DataFrame:
    """Per turn: k, conv_id, pos (from 1), n (turns of the conversation) and the prefix hash (a, b, c, d)."""
    rows = _keyed(df).select("k", "conv_id", "blk", "turn", F.xxhash64("role", "text").alias("h"), F.xxhash64(F.lit("2"), "text", "role").alias("g"))
    rows = rows.repartition("k", "blk").dropDuplicates(["k", "blk", "turn", "h", "g"])
    inside = Window.partitionBy("k", "blk").orderBy(F.col("turn").asc_nulls_first(), "h", "g")
    ranked = rows.withColumn("r", F.row_number().over(inside))
    upto = Window.partitionBy("k").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("k")
    sizes = ranked.groupBy("k", "blk").agg(F.count("*").alias("m"))
    sizes = sizes.select("k", "blk", F.coalesce(F.sum("m").over(upto), F.lit(0)).alias("ahead"), F.sum("m").over(every).alias("n"))
    placed = ranked.join(sizes, ["k", "blk"]).withColumn("pos", F.col("ahead") + F.col("r"))
    one, two = F.xxhash64("pos", "h"), F.xxhash64("g", "pos")
    low = F.lit(0xFFFFFFFF)
    halves = placed.withColumns({"a": one.bitwiseAND(low), "b": F.shiftrightunsigned(one, 32), "c": two.bitwiseAND(low), "d": F.shiftrightunsigned(two, 32)})
    run = inside.rowsBetween(Window.unboundedPreceding, 0)
    running = halves.select("k", "conv_id", "blk", "pos", "n", *[F.sum(x).over(run).alias(x) for x in _SUMS])
    totals = running.groupBy("k", "blk").agg(*[F.max(x).alias(f"t{x}") for x in _SUMS])  # halves are not negative, so the last sum is the largest
    before = totals.select("k", "blk", *[F.coalesce(F.sum(f"t{x}").over(upto), F.lit(0)).alias(f"t{x}") for x in _SUMS])
    return running.join(before, ["k", "blk"]).select("k", "conv_id", "pos", "n", *[(F.col(x) + F.col(f"t{x}")).alias(x) for x in _SUMS])


def maximal(df: DataFrame) -> DataFrame:
    """(k, n) of the conversations that are no prefix of another, one of each set of equal ones."""
    every = materialise(prefixes(df), "prefixes")
    whole = every.filter("pos = n")
    same = ["pos", *_SUMS]
    longer = every.filter("pos < n").select(*same).distinct()  # counted within tasks first: a common first turn is one row of each
    left = whole.join(longer, same, "left_anti")
    first = left.groupBy(*same).agg(F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id", "k")).alias("w"))
    return materialise(first.select(F.col("w.k").alias("k"), F.col("pos").alias("n")), "maximal")


def format_chats(df: DataFrame, start: str = START, end: str = END) -> DataFrame:
    """conv_id, part, n_turns (of the whole conversation) and text, for the maximal conversations of ``df``."""
    keep = maximal(df)
    few = keep.count() <= SMALL
    rows = _keyed(df).join(F.broadcast(keep) if few else keep, "k")
    parts = rows.groupBy("k", "blk").agg(F.max("conv_id").alias("conv_id"), F.max("n").alias("n_turns"), F.collect_set(F.struct("turn", "role", "text")).alias("t"))
    turn = lambda x: F.concat(F.lit(start), x["role"], F.lit("\n"), F.replace(x["text"], F.lit("<|"), F.lit("< |")), F.lit(f"{end}\n"))
    return parts.select("conv_id", F.col("blk").alias("part"), F.col("n_turns").cast("long").alias("n_turns"), F.array_join(F.transform(F.array_sort("t"), turn), "").alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


ORACLE_SQL = r"""
WITH d AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM d),
p AS (SELECT conv_id, pos, n, string_agg(md5(role || chr(1) || text), ',') OVER (PARTITION BY conv_id ORDER BY pos) AS h FROM o),
w AS (SELECT conv_id, n, h FROM p WHERE pos = n),
m AS (SELECT min(conv_id) AS conv_id FROM w WHERE h NOT IN (SELECT h FROM p WHERE pos < n) GROUP BY h)
SELECT o.conv_id, CAST(floor(o.turn / 1024) AS BIGINT) AS part, max(o.n) AS n_turns,
       string_agg('<|im_start|>' || o.role || chr(10) || replace(o.text, '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY o.turn, o.role, o.text) AS text
FROM o JOIN m USING (conv_id) GROUP BY 1, 2
"""
