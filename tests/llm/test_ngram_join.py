import random
import re

import numpy as np
import pytest

from evigraph.llm import ngram_join as j

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute(rows, k=4, num=85, den=100):
    s = []
    for _, t in rows:
        w = WORD.findall(lower(t or ""))
        s.append(set() if not w else {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)})
    p = list(range(len(rows)))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            i = len(s[a] & s[b])
            if i and den * i >= num * len(s[a] | s[b]):
                p[find(a)] = find(b)
    least = {}
    for a, (d, _) in enumerate(rows):
        if d is not None:
            r = find(a)
            least[r] = min(least.get(r, d), d)
    return sorted((d if d is not None else -1, len(s[a]), least.get(find(a), -1)) for a, (d, _) in enumerate(rows))


def corpus(seed, n=140):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    common = [rnd.choice(vocab) for _ in range(40)]
    rows, bases = [], []
    for i in range(n):
        kind = rnd.random()
        if kind < 0.35 or not bases:
            w = [rnd.choice(vocab) for _ in range(rnd.randint(0, 120))] + (common if rnd.random() < 0.4 else [])
            bases.append(w)
        else:
            w = list(rnd.choice(bases[:4] if kind < 0.8 else bases))
            for _ in range(rnd.choice([0, 0, 1, 2, 3, 5])):
                if w:
                    w[rnd.randrange(len(w))] = rnd.choice(vocab)
        rows.append((i, " ".join(w) if rnd.random() < 0.8 else "\n ".join(w).upper()))
    return rows + [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "One\ttwo"), (905, "One two three"), (3, rows[3][1]), (None, rows[5][1]), (None, "lone text of no id")]


@pytest.mark.parametrize("limit,seed,k,num", [(48, 1, 4, 85), (3, 2, 4, 85), (2, 3, 5, 80)])
def test_matches_brute_force(spark, monkeypatch, limit, seed, k, num):
    monkeypatch.setattr(j, "LIST", limit)
    monkeypatch.setattr(j, "BLOCK", 5 if limit < 48 else 512)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1)).repartition(3)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in j.link_documents(df, k, num).collect())
    assert got == brute(rows, k, num)


def test_keep_one(spark):
    base = " ".join(f"a{i}" for i in range(60))
    near = base.replace("a59", "b")
    rows = [(5, base, "n"), (3, near, "n"), (3, near, "n"), (9, "other words entirely here now", "x"), (10, None, "y"), (11, "", "z"), (None, base, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, tk string")
    got = sorted((r.doc_id, r.tk) for r in j.keep_one(df).collect())
    assert got == [(3, "n"), (9, "x"), (10, "y"), (11, "z")]
    assert j.keep_one(df).columns == df.columns
    assert j.keep_one(df.limit(0)).count() == 0


def test_prefix_lemma():
    rnd = np.random.default_rng(1)
    for _ in range(200):
        n = int(rnd.integers(7, 80))
        a = np.unique(rnd.integers(0, 1 << 60, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rnd.random(len(a)) > 0.08], rnd.integers(0, 1 << 60, int(rnd.integers(0, 4))).astype(np.uint64)]))
        i = len(np.intersect1d(a, b))
        if 100 * i < 85 * (len(a) + len(b) - i):
            continue
        x, y = (a, b) if len(a) >= len(b) else (b, a)
        grades = np.unique(a[::5]), np.ones(len(np.unique(a[::5])), np.uint8)
        tx, lx, ell = j.prefix(x, 85, 100, grades)
        ty, ly, _ = j.prefix(y, 85, 100, grades)
        assert len(np.intersect1d(tx[lx <= ell], ty[ly <= ell])) >= ell
