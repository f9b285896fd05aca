import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from evigraph.llm import gbt
from evigraph.llm import quality_rules as q
from evigraph.llm.textarrays import blocks

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    many = Counter(windows)
    covered = set()
    for i, w in enumerate(windows):
        if many[w] > 1:
            covered.update(range(i, i + 8))
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)]


def texts():
    rnd = random.Random(2)
    out = ["", None, "\n\n", " a", "a\n a\na\n", "é " * 30, "x" * 5000, "one\x0btwo\x0cthree\r\nfour"]
    for _ in range(300):
        line = [" ".join(rnd.choice(["aa", "b|", "é#", "<c>", "Dd", "漢", "7"]) for _ in range(rnd.randint(0, 12))) for _ in range(3)]
        out.append("\n".join(rnd.choice(line) for _ in range(rnd.randint(0, 12))))
    return out


def test_base_statistics_match_brute_force():
    t = texts()
    for limit in (64, 1 << 20):
        got = np.concatenate([q.statistics(b)[0] for b in blocks(pa.array(t), limit)])
        assert got.tolist() == [brute(x) for x in t]


def test_trees_keep_their_constraints():
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(800, 3))
    y = (x[:, 0] - x[:, 1] + rnd.normal(size=800) > 0).astype(float)
    t = gbt.fit(x, y, (1, -1, 0))
    assert ((t.probability(x) > 0.5) == y).mean() > 0.75
    grid = np.tile(rnd.normal(size=(50, 3)), (1, 1))
    for j, sign in ((0, 1), (1, -1)):
        runs = [t.margin(np.where(np.arange(3) == j, v, grid)) for v in np.linspace(-3, 3, 40)]
        assert (np.diff(runs, axis=0) * sign >= -1e-9).all()


def test_query(spark, tmp_path):
    rnd = random.Random(4)
    good, bad = "river stone houses people walked evening light".split(), "WIN!! $$$ |x ###a %%b".split()
    rows, labels = [], []
    for i in range(400):
        junk = i % 4 == 0
        rows.append((i, " ".join(rnd.choice(bad if junk else good) + str(rnd.randint(0, 99)) for _ in range(60))))
        labels.append((i, int(not junk), 0))
    rows += [(1000, None), (1001, ""), (None, "short text"), (1, rows[1][1])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels + [(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = q.query(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
    known = [r for r in got if r.doc_id is not None and r.doc_id < 400 and not r.base_failed]
    assert sum(r.kept == (r.doc_id % 4 != 0) for r in known) >= 0.97 * len(known)
    assert not any(r.kept for r in got if r.doc_id in (None, 1000, 1001))


def test_no_labels_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "word%d " * 3 + " ".join(map(str, range(40))))], "doc_id long, text string")
    trees = q.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert q.apply_rules(docs, trees).first().kept
    assert q.apply_rules(docs.limit(0), trees).count() == 0
    assert q.apply_rules(docs.withColumn("KEPT", docs.doc_id).withColumn("N_words", docs.text), trees).first().kept
