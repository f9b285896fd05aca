import random
from collections import defaultdict

from pyspark.sql import functions as F

from evigraph.llm.shards import OVERHEAD, shard_documents, query


def _by_shard(rows):
    size, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        size[r.shard] += len((r.text or "").encode()) + OVERHEAD
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    return size


def test_sizes_near_equal_and_slots_gapless(spark):
    rnd = random.Random(1)
    rows = [(i, "x" * rnd.randint(0, 400) + str(i), "s") for i in range(4000)]
    rows += [(10_000 + i, "one text that a third of all rows share " * 5, "s") for i in range(2000)]
    rows += [(None, None, None), (None, None, None), (7, "x", "again"), (7, "x", "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, size string").repartition(5)
    got = shard_documents(df, 7, slice_bytes=20_000).collect()
    assert len(got) == len(rows)
    size = _by_shard(got)
    total = sum(size.values())
    assert set(size) == set(range(7))
    assert all(abs(v - total / 7) <= 2 * max(total / 7 * 0.0005, 450) for v in size.values())


def test_groups_stay_whole_where_the_tolerance_allows(spark):
    df = spark.createDataFrame([(i, f"text {i % 300}") for i in range(3000)], "doc_id long, text string")
    got = shard_documents(df, 4, tolerance=0.02).collect()
    where = defaultdict(set)
    for r in got:
        where[r.text].add(r.shard)
    assert all(len(v) == 1 for v in where.values())
    _by_shard(got)


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert shard_documents(none, 3).count() == 0
    one = spark.createDataFrame([(1, "a" * 200_000)], "doc_id long, text string")
    assert [(r.slot,) for r in shard_documents(one, 40).collect()] == [(0,)]
    same = spark.createDataFrame([(1, "a")] * 50, "doc_id long, text string")
    _by_shard(shard_documents(same, 4).collect())


def test_query_columns(spark, tmp_path):
    spark.createDataFrame([(1, "é"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in query(spark, str(tmp_path)).collect()}
    assert got[1].size == 18 and got[2].size == 16 and got[2].text_crc32 == 0 and got[1].grown_shard is None


def test_sizes_and_sums_equal_a_plain_count(spark, tmp_path):
    import zlib

    rnd = random.Random(2)
    texts = {i: rnd.choice(["é", "x", "漢"]) * rnd.randint(0, 50) for i in range(500)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = query(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r["size"], r.text_crc32) for r in got} == {k: (len(t.encode()) + 16, zlib.crc32(t.encode())) for k, t in texts.items()}
    total, size = sum(len(t.encode()) + 16 for t in texts.values()), defaultdict(int)
    for r in got:
        size[r.shard] += r["size"]
    assert all(abs(v - total / 40) <= 170 for v in size.values()) and len(size) == 40


def test_splitters_equal_sorted_sums(spark):
    from evigraph.llm import shards

    rnd = random.Random(6)
    rows = [(rnd.randrange(1 << 20), rnd.randrange(1 << 63), rnd.randint(1, 60)) for _ in range(3000)] + [(77, rnd.randrange(1 << 63), 30) for _ in range(1500)]
    keys = spark.createDataFrame(rows, "__k1 long, __k2 long, __size long")
    total = sum(r[2] for r in rows)
    wanted = [(total * i // 9, 40) for i in range(1, 9)]
    got = shards.find_splitters(keys, total, wanted)
    for at, (target, tol) in zip(got, wanted):
        assert abs(sum(n for a, b, n in rows if (a, b) < at) - target) <= max(tol, 60)
