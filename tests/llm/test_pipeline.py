import random

import pytest

import corpus_pipeline as p
from evigraph.llm import quality_zstd
from evigraph.llm.sp_wfst import Machine, read_model

GOOD = "the river ran past old stone houses and people walked along it in evening light".split()
BAD = "WIN!!! $$$ click|here ### free%%% offer&&& BUY***".split()


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(8)
    text = lambda words, n: " ".join(rnd.choice(words) + str(rnd.randint(0, 99)) for _ in range(n))
    rows, labels = [], []
    for i in range(300):
        bad = i % 6 == 0
        rows.append([i, text(BAD if bad else GOOD, rnd.randint(60, 150)), "en", "s", 0])
        labels.append((i, int(not bad), 0))
    item = text(GOOD, 30)
    near = rows[1][1].split()
    near[5] = "other"
    rows += [[1000, rows[1][1], "en", "s", 0], [1001, " ".join(near), "en", "s", 0], [1002, text(GOOD, 40) + " " + item.upper() + " " + text(GOOD, 40), "en", "s", 0]]
    rows += [[1003, text(GOOD, 50) + " mail me@x.org and +1 (555) 123-4567 " + text(GOOD, 20), None, None, None], [1004, None, "en", "s", None], [1005, "", "en", "s", 0]]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, {r[0]: r[1] for r in rows}


def test_stages_against_brute_force(spark, corpus):
    path, text = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    model = quality_zstd.fit(docs, spark.read.parquet(f"{path}/labels.parquet"))
    want = {k for k, t in text.items() if model.score([t])[0] >= quality_zstd.THRESHOLD}
    one = p.quality(spark, docs, path)
    assert one.columns == columns and {r.doc_id for r in one.collect()} == want
    assert {k for k in text if k % 6 and k < 300} - want == set()

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets, gone = {k: shingles(text[k]) for k in want}, set()
    for a in sorted(want):
        for b in sorted(want):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                gone.add(b)
    two = p.near_duplicates(spark, one, path)
    assert two.columns == columns and {r.doc_id for r in two.collect()} == want - gone and {1000, 1001} <= gone
    three = p.decontaminate(spark, two, path)
    assert three.columns == columns and {r.doc_id for r in three.collect()} == want - gone - {1002}
    four = {r.doc_id: r for r in p.redact(spark, three, path).collect()}
    assert "<EMAIL>" in four[1003].text and "<PHONE>" in four[1003].text and four[1003].n_chars == len(four[1003].text)
    assert all(four[k].text == text[k] for k in four if k != 1003)


def test_clashing_columns(spark, corpus):
    path, _ = corpus
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{path}/documents.parquet").filter("doc_id >= 1000")
    extra = ["score", "ids", "n_tokens", "tk", "component_id", "spans", "base", "tokens", "shard", "n", "c"]
    wide = docs.select("*", *[F.lit("x").alias(c) for c in extra])
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, wide, path)
        assert out.columns == wide.columns and out.count() <= wide.count()
    assert {r.doc_id for r in p.encode(spark, wide, path).collect()} == {r.doc_id for r in docs.collect()}


def test_run(spark, corpus):
    path, text = corpus
    m = Machine(read_model())
    got = p.run(spark, path).collect()
    assert {r.doc_id for r in got}.isdisjoint({1000, 1001, 1002})
    assert all(r.ids == m.encode(text[r.doc_id]) and r.n_tokens == len(r.ids) for r in got if r.doc_id != 1003)


def test_empty(spark, tmp_path):
    for name, kind in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/{name}.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0
