import random
import re

from pyspark.sql import functions as F

from evigraph.llm import decontaminate as d

WORD = re.compile(r"[a-z0-9\u0080-\U0010ffff]+")


def words(t):
    return WORD.findall((t or "").lower())


def brute(item, text):
    a, b = words(item), words(text)
    if not a or not b:
        return None
    prev = [0] * (len(b) + 1)
    for i, w in enumerate(a, 1):
        cur = [i]
        for j, v in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (w != v)))
        prev = cur
    e = min(prev)
    return e if e <= int(d.RATE * len(a)) else None


def corpus(seed=1):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["É" + str(i) for i in range(20)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(8, 60)))) for i in range(30)]
    items += [(100, "tiny"), (101, None), (102, "..."), (103, "three short words"), (None, items[0][1])]
    docs = []
    for k in range(240):
        w = [rnd.choice(vocab) for _ in range(rnd.randint(0, 300))]
        if k % 2 == 0:
            p = items[rnd.randrange(30)][1].split()
            for _ in range(int(len(p) * rnd.choice([0, 0, 0.05, 0.1]))):
                i = rnd.randrange(len(p))
                p[i : i + 1] = rnd.choice([[rnd.choice(vocab)], [], [p[i], rnd.choice(vocab)]])
            at = rnd.randint(0, len(w))
            w[at:at] = p
        docs.append((k, rnd.choice([" ", ", ", "\n"]).join(w).upper() if k % 5 == 0 else " ".join(w)))
    docs += [(900, None), (901, ""), (902, "a tiny thing, three short words"), (None, docs[0][1]), (0, docs[0][1])]
    return items, docs


def test_recall_and_exactness_against_brute_force(spark):
    items, docs = corpus()
    di = spark.createDataFrame(items, "item_id long, text string")
    dd = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = d.find_leaks(dd, di).collect()
    want = {}
    for i, t in items:
        for k, x in docs:
            e = brute(t, x)
            if e is not None:
                want[k, i] = min(e, want.get((k, i), 99))
    mine = {(r.doc_id, r.item_id): r.edits for r in got}
    assert set(mine) <= set(want)
    assert {k for k, e in want.items() if e == 0} <= set(mine)  # copies are never missed
    edited = [k for k, e in want.items() if e]
    assert edited and sum(k in mine for k in edited) >= 0.9 * len(edited)
    assert all(mine[k] >= want[k] for k in mine)
    text, item = dict(docs), dict(items)
    for r in got:
        if r.edits == 0:
            assert words(text[r.doc_id][r.start : r.end]) == words(item[r.item_id])


def test_drop_and_blocks_of_items(spark, monkeypatch):
    items, docs = corpus(2)
    di = spark.createDataFrame(items, "item_id long, text string")
    dd = spark.createDataFrame(docs, "doc_id long, text string").withColumn("extra", F.lit(1))
    flagged = {(r.doc_id) for r in d.find_leaks(dd, di).collect()}
    left = d.drop_leaks(dd, di)
    assert left.columns == dd.columns
    assert {r.doc_id for r in left.collect()} == {k for k, _ in docs} - flagged
    exact = lambda df: sorted((str(r.doc_id), str(r.item_id)) for r in df.collect() if r.edits == 0)
    assert exact(d.find_leaks(dd, di, most=7)) == exact(d.find_leaks(dd, di))
    assert d.find_leaks(dd, di.limit(0)).count() == 0 and d.drop_leaks(dd.limit(0), di).count() == 0
    assert d.drop_leaks(dd, di.limit(0)).count() == len(docs)


def test_recall_at_the_full_rate_and_for_long_items():
    import pyarrow as pa

    rnd = random.Random(4)
    word = lambda: f"w{rnd.randrange(5000)}"
    for m in (5, 7, 10, 15, 20, 40, 59, 100, 200, 220):
        items = [(i, " ".join(word() for _ in range(m))) for i in range(30)]
        texts, planted = [], []
        for i, t in items:
            for rate in (0.15, 0.2):
                p = t.split()
                for _ in range(int(m * rate)):
                    k = rnd.randrange(len(p))
                    p[k : k + 1] = rnd.choice([[word()], [], [p[k], word()]])
                texts.append(" ".join([word() for _ in range(rnd.randint(0, 50))] + p + [word() for _ in range(50)]))
                planted.append(i)
        index, found = d.Index(items), {}
        for block in d.blocks(d.folded(pa.array(texts))):
            found.update({(block.rows.start + k, index.ids[i]): e for k, i, e, *_ in index.search(block)})
        want = {(k, i): brute(items[i][1], texts[k]) for k, i in enumerate(planted)}
        assert None not in want.values()
        assert sum(x in found for x in want) >= 0.9 * len(want), m
        full = [(k, i) for k, i in want if k % 2]
        assert sum(x in found for x in full) >= 0.9 * len(full), m
        assert all(found[x] >= want[x] for x in want if x in found)


def plain_edits(item, text):
    """Every part of the text, by the textbook table."""
    best = None
    for a in range(len(text) + 1):
        prev = list(range(len(item) + 1))
        for b in range(a, len(text) + 1):
            if b > a:
                cur = [b - a]
                for i, w in enumerate(item, 1):
                    cur.append(min(prev[i] + 1, cur[-1] + 1, prev[i - 1] + (w != text[b - 1])))
                prev = cur
            best = min(best or (99, 0, 0), (prev[-1], b, -a))
    return best[0], -best[2], best[1]


def test_edits_equal_the_textbook():
    rnd = random.Random(8)
    for _ in range(300):
        item = [rnd.randrange(4) for _ in range(rnd.randint(1, 6))]
        text = [rnd.randrange(4) for _ in range(rnd.randint(0, 9))]
        want = plain_edits(item, text)
        for most in (want[0], want[0] + 2):
            assert d.edits(item, text, most) == want
        if want[0]:
            assert d.edits(item, text, want[0] - 1) is None


def test_very_long_items_and_clashing_columns(spark):
    import time

    rnd = random.Random(5)
    item = [f"w{rnd.randrange(9000)}" for _ in range(10_000)]
    near = list(item)
    for k in range(0, 10_000, 12):
        near[k] = "changed"
    docs = spark.createDataFrame([(1, "x " * 300 + " ".join(near), "a"), (2, "plain words", "b")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(7, " ".join(item), "c"), (8, "some other words here now", "d")], "item_id long, text string, doc_id string")
    began = time.time()
    got = d.find_leaks(docs, items).collect()
    assert [(r.doc_id, r.item_id, r.edits, r.item_words) for r in got] == [(1, 7, 834, 10_000)]
    assert time.time() - began < 30
    left = d.drop_leaks(docs, items, most_bytes=40_000)
    assert left.columns == docs.columns and [r.doc_id for r in left.collect()] == [2]
