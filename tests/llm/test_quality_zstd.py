import random

import pytest

from evigraph.llm import quality_zstd as q

GOOD = "the river ran past old stone houses and people walked along it in the evening light".split()
BAD = "WIN!!! $$$ click|here ### free%%% offer&&& BUY***".split()


def _doc(rnd, words):
    return " ".join(rnd.choice(words) for _ in range(rnd.randint(30, 200)))


@pytest.fixture(scope="module")
def tables(spark):
    rnd = random.Random(3)
    rows = [(i, _doc(rnd, BAD if i % 5 == 0 else GOOD), int(i % 5 != 0)) for i in range(600)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], 0) for r in rows], "doc_id long, quality int, toxic int")
    return docs, labels, {r[0]: r[2] for r in rows}


def test_held_out_accuracy_and_null_text(spark, tables, tmp_path):
    docs, labels, truth = tables
    docs.unionByName(spark.createDataFrame([(9001, None), (9002, ""), (None, "the river")], docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    labels.unionByName(spark.createDataFrame([(None, 1, 0), (5, None, None)], labels.schema)).write.parquet(f"{tmp_path}/labels.parquet")
    got = q.query(spark, str(tmp_path)).collect()
    assert len(got) == 603 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert held and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    empty = {r.doc_id: r.score for r in got if r.doc_id in (9001, 9002)}
    assert empty[9001] == empty[9002]


def test_held_out_labels_are_never_read(spark, tables):
    from evigraph.llm.labelled import is_held_out
    from pyspark.sql import functions as F

    docs, labels, _ = tables
    turned = labels.withColumn("quality", F.when(is_held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = q.fit(docs, labels), q.fit(docs, turned)
    assert (a.bad, a.good, a.slope, a.offset, a.prior) == (b.bad, b.good, b.slope, b.offset, b.prior)


def test_one_class_and_empty_tables(spark, tables):
    docs, labels, _ = tables
    only = q.fit(docs, labels.filter("quality = 1"))
    assert 0.9 < only.score(["x", None])[0] < 1
    none = q.fit(docs.limit(0), labels.limit(0))
    assert none.score(["x"])[0] == pytest.approx(0.5)
    assert q.score_documents(docs.limit(0), none).count() == 0


def test_repeated_labelled_rows_and_the_bounds_of_the_sample(spark, tables):
    from evigraph.llm import labelled

    docs, labels, truth = tables
    twice = docs.unionByName(docs.filter("doc_id < 50")).unionByName(docs.filter("doc_id < 50").selectExpr("doc_id", "concat('~', text) text"))
    a, b = q.fit(docs, labels), q.fit(twice, labels.unionByName(labels))
    assert (a.bad, a.good) == (b.bad, b.good)
    few = labelled.sample(twice, labels, 20).collect()
    assert len(few) == len({(r["__id"], r["__label"]) for r in few}) == 40
    long = docs.withColumnRenamed("text", "t").selectExpr("doc_id", "if(doc_id % 7 = 0, repeat(t, 300), t) text")
    kept = labelled.within(labelled.sample(long, labels, 100), 40_000).collect()
    whole = {r.doc_id: r.text for r in long.collect()}
    for y in (0, 1):
        mine = [r["__text"] for r in kept if r["__label"] == y]
        assert mine and (sum(map(len, mine)) <= 40_000 or len(mine) == 1)
    assert all(r["__text"] == whole[r["__id"]] for r in kept)
    assert q.fit(long, labels, 100, class_bytes=1).bad == b""


def test_scores_equal_a_plain_computation(spark, tables):
    import math

    import zstandard

    docs, labels, _ = tables
    m = q.fit(docs, labels)
    got = {r.doc_id: r.score for r in q.score_documents(docs.unionByName(spark.createDataFrame([(5000, "é" * 4000), (5001, "x")], docs.schema)), m).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()} | {5000: "é" * 4000, 5001: "x"}
    size = lambda d, b: len(zstandard.ZstdCompressor(level=q.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False).compress(b))
    for k, t in texts.items():
        b = t.encode()
        diff = sum(size(m.bad, b[i : i + q.PIECE]) - size(m.good, b[i : i + q.PIECE]) for i in range(0, len(b), q.PIECE)) / len(b)
        told = len(b) / (len(b) + q.HALF)
        assert got[k] == pytest.approx(1 / (1 + math.exp(-(told * (m.slope * diff + m.offset) + (1 - told) * m.prior))))
