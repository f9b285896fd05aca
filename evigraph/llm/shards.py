"""Sharding by histogram sort: shards of near equal bytes from exact splitters and one exchange.

Rows are ordered by ``(hash of the text, hash of the key, key)``. The driver keeps, for each splitter,
the interval of keys it must lie in; each round counts exact bytes and rows below probes that divide
those intervals (one distributed aggregation with a few thousand result rows at most per splitter),
until a probe is within tolerance of the splitter's target. Then every row's shard follows from its
own key, and one exchange brings the rows of a slice together to number them.

Law ``bytes``: shard sizes differ by the tolerance or by one document, whichever is more. Equal texts
(a group) are neighbours in this order; a splitter goes to a group's edge where that meets the
tolerance and cuts a group only where the group itself is too large, so a group of any size is spread
over as many shards and tasks as its bytes need. A shard is numbered in slices of about ``SLICE_BYTES``, which a hash of key and
text deals, so no task sorts a whole shard; slots go by slice, and by key inside one. What the driver keeps depends on the
number of shards alone: their splitters, and for each of them the buckets of one round.

Null texts count no bytes; null keys are one key; repeated rows each get a slot; rows equal in both key
and text stay in one shard and slice. Result columns replace columns of their names, others pass through. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table, without

SHARDS = 40
#: Largest distance of a splitter from its target, as a share of a shard's bytes.
TOLERANCE = 0.0005
#: Bytes of text in a slice, at most about.
SLICE_BYTES = 16 << 20
#: Bits by which a round narrows an interval.
STEP = 11
OVERHEAD = 16
KEY_BITS = 63


def sized(df: DataFrame, text: str, key: str) -> DataFrame:
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return (
        df.withColumn("__size", F.octet_length(body).cast("long") + F.lit(OVERHEAD).cast("long"))
        .withColumn("__k1", F.shiftrightunsigned(F.xxhash64(body), 1))
        .withColumn("__k2", F.shiftrightunsigned(F.xxhash64(F.col(f"`{key}`")), 1))
    )


def _count(keys: DataFrame, level: int, group: list[int], shift: int, above: int, active: list[int]) -> dict[int, tuple]:
    """Exact bytes below the probes inside the active intervals: per bucket (bytes, least and largest key)."""
    k = F.col("__k1") if level == 1 else F.col("__k2")
    rows = keys
    if level == 2:
        rows = rows.filter(F.col("__k1").isin(group))
    if above < KEY_BITS:
        rows = rows.filter(F.shiftright(k, above).isin(active))
    by = [F.shiftright(k, shift).alias("b")] + ([F.col("__k1").alias("g")] if level == 2 else [F.lit(0).cast("long").alias("g")])
    got = rows.groupBy(*by).agg(F.sum("__size").alias("n"), F.min(k).alias("lo"), F.max(k).alias("hi")).collect()
    return {(r.g, r.b): (r.n, r.lo, r.hi) for r in got}


def find_splitters(keys: DataFrame, total: int, wanted: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Keys ``(k1, k2)`` such that the bytes of smaller keys are each ``(target, tolerance)`` of ``wanted``, nearly.

    ``keys`` has columns __k1, __k2, __size. Results ascend.
    """
    out: list[tuple[int, int] | None] = [None] * len(wanted)
    for level in (1, 2):
        # open: splitter -> (group, prefix, bytes below the prefix)
        if level == 1:
            open_ = {i: (0, 0, 0) for i in range(len(wanted))}
        above = KEY_BITS
        while open_ and above > 0:
            shift = max(0, above - STEP)
            found = _count(keys, level, sorted({g for g, _, _ in open_.values()}), shift, above, sorted({p for _, p, _ in open_.values()}))
            inside: dict[tuple[int, int], list[tuple[int, int, int, int]]] = {}
            for (g, b), (n, lo, hi) in found.items():
                inside.setdefault((g, b >> (above - shift)), []).append((b, n, lo, hi))
            for v in inside.values():
                v.sort()
            still, cut = {}, {}
            for i, (g, p, below) in open_.items():
                target, tol = wanted[i]
                for b, n, lo, hi in inside.get((g, p), []):
                    if below + n < target:
                        below += n
                        continue
                    near = min((abs(below - target), lo), (abs(below + n - target), hi + 1))
                    at = (near[1], 0) if level == 1 else (g, near[1])
                    if near[0] <= tol:
                        out[i] = at
                    elif lo < hi:
                        still[i] = (g, b, below)
                    elif level == 1:
                        cut[i] = (lo, 0, below)  # one group of equal texts that is too large to keep whole
                    else:
                        out[i] = at  # one key: no finer place exists
                    break
                else:
                    out[i] = (1 << KEY_BITS, 0)
            if level == 1:
                pending = {**(pending if above < KEY_BITS else {}), **cut}
            open_, above = still, shift
        if level == 1:
            open_ = pending if wanted else {}
    return sorted(x if x is not None else (1 << KEY_BITS, 0) for x in out)


def place(k1: np.ndarray, k2: np.ndarray, s1: np.ndarray, s2: np.ndarray) -> np.ndarray:
    """For each key the number of splitters that are not above it."""
    lo, hi = np.searchsorted(s1, k1, "left"), np.searchsorted(s1, k1, "right")
    at = lo.copy()
    tied = np.flatnonzero(lo < hi)
    for a in np.unique(lo[tied]):
        mine = tied[lo[tied] == a]
        at[mine] = a + np.searchsorted(s2[a : hi[mine[0]]], k2[mine], "right")
    return at


def shard_documents(
    df: DataFrame, n_shards: int = SHARDS, text: str = "text", key: str = "doc_id", tolerance: float = TOLERANCE, slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """All columns of ``df`` with ``shard`` (int, from 0) and ``slot`` (long, gapless from 0 in each shard), which replace columns of these names."""
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    df = without(df, "shard", "slot")
    rows = sized(df, text, key)
    keys = materialise(rows.select("__k1", "__k2", "__size"), "shard-keys")
    total = keys.agg(F.sum("__size")).first()[0] or 0
    per = max(1, -(-total // (n_shards * slice_bytes)))
    share = total / n_shards
    wanted = [(round(share * i), int(share * tolerance)) for i in range(1, n_shards)]
    splitters = find_splitters(keys, total, wanted) if total else []
    s1 = np.array([min(a, (1 << 63) - 1) for a, _ in splitters], np.int64)
    s2 = np.array([b for _, b in splitters], np.int64)
    shared = df.sparkSession.sparkContext.broadcast((s1, s2))

    @F.arrow_udf("int")
    def shard_of(k1: pa.Array, k2: pa.Array) -> pa.Array:
        return pa.array(place(k1.to_numpy(), k2.to_numpy(), *shared.value).astype(np.int32))

    def dealt(d: DataFrame) -> DataFrame:
        return d.withColumn("__shard", shard_of("__k1", "__k2")).withColumn("__slice", F.pmod(F.xxhash64("__k1", "__k2"), F.lit(per)))

    slices = dealt(keys).groupBy("__shard", "__slice").agg(F.count("*").alias("__many"))  # small rows, one for each slice
    before = Window.partitionBy("__shard").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    ahead = slices.select("__shard", "__slice", F.coalesce(F.sum("__many").over(before), F.lit(0)).alias("__ahead"))
    order = Window.partitionBy("__shard", "__slice").orderBy("__k1", "__k2", F.col(f"`{key}`"))
    numbered = dealt(rows).withColumn("__n", F.row_number().over(order)).join(ahead, ["__shard", "__slice"])
    return (
        numbered.withColumn("shard", F.col("__shard"))
        .withColumn("slot", F.col("__ahead") + F.col("__n") - F.lit(1).cast("long"))
        .select(*[F.col(f"`{c}`") for c in df.columns], "shard", "slot")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        "text",
        (F.octet_length(body) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
    )
    return shard_documents(docs).select(  # digests are made before the exchange, so texts don't travel
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
