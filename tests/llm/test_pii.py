import hashlib
import random
import re

from evigraph.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (2 if i % 2 else 1)
        s += v - 9 if v > 9 else v
    return s % 10 == 0


def brute(t):
    t = t or ""
    digits = lambda m: re.sub("[^0-9]", "", m)
    tests = {
        "email": (EMAIL, lambda m: True),
        "ip": (IP, lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (CARD, lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (PHONE, lambda m: 9 <= len(digits(m)) <= 15),
    }
    return [f"{k}:{m.start()}:{m.end()}" for k, (p, ok) in tests.items() for m in p.finditer(t) if ok(m[0])]


def texts():
    rnd = random.Random(9)
    parts = ["a@b.c", "x", "@", ".", "12", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "+1 (555) 123-4567", "+", "-", " ", "é𓀀", "\n", "_d@e.f.g", "007.08.9.10", "00000000000000", "4111-1111-1111-1111", "(", ")", "0"]
    out = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(600)]
    return out + [None, "", "9" * 30000, "a" * 30000, "1." * 20000, "a." * 20000 + "@" + "b." * 20000 + "c", "+1 " + "2 " * 20000, "漢" * 1000 + " me@x.org"]


def test_base_spans_match_brute_force(spark, tmp_path):
    t = texts()
    df = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string").repartition(4)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    for r in pii.query(spark, str(tmp_path)).collect():
        want = brute(t[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (t[r.doc_id], want, r.spans)
        assert set(want) <= set(filter(None, r.spans.split(",")))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k + ":") for w in want) for k in ("email", "ip", "card", "phone")]


def test_added_spans_and_redaction(spark):
    key = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    rows = [
        (1, f'the token = "{key}" is here', "x"),
        (2, "clean words only, averyveryverylongcompoundword and 12345678 things", "x"),
        (3, "call (743) 555-3824 or me@x.org now", None),
        (4, None, "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, base string")
    got = {r.doc_id: r for r in pii.find_spans(df, base="b").collect()}
    assert [(s.kind, rows[0][1][s.start : s.end]) for s in got[1].spans] == [("secret", key)]
    assert got[2].spans == [] and got[4].spans == []
    assert {s.kind for s in got[3].spans} == {"email", "contact"}
    out = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert out[1] == 'the token = "<SECRET>" is here' and out[2] == rows[1][1] and out[4] is None
    assert out[3] == "call <CONTACT> or <EMAIL> now"
    assert pii.redact(df).columns == df.columns and pii.redact(df.limit(0)).count() == 0


def test_secrets_and_numbers_that_hold_base_spans_go_whole(spark):
    key = "ab4111111111111111cdef0123456789abcdef01"
    rows = [(1, f'the token = "{key}" is here'), (2, "ssn: 123-45-6789 1.2.3.4 and on")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: {(s.kind, rows[r.doc_id - 1][1][s.start : s.end]) for s in r.spans} for r in pii.find_spans(df).collect()}
    assert got[1] == {("card", "4111111111111111"), ("secret", key)} and ("ip", "1.2.3.4") in got[2]
    out = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert out[1] == 'the token = "<SECRET>" is here' and "6789" not in out[2] and "1.2.3.4" not in out[2]


def test_compiled_trees_equal_the_arrays(spark):
    import numpy as np
    from pyspark.sql import functions as F

    trees, _ = pii.fit(spark)
    made = pii._training_texts(99, 60)
    df = spark.createDataFrame([(t,) for t, _ in made], "text string")
    rows = df.select(F.explode(pii._candidates(F.col("text"))).alias("c")).select("c.*", pii.compiled(trees, F.col("c")).alias("m")).collect()
    x = np.array([[r[k] for k in pii.FEATURES] for r in rows], float)
    assert np.allclose(trees.margin(x), [r.m for r in rows])


def test_many_numbers_take_linear_time(spark):
    import time

    numbers = lambda n: " ".join(f"{(i * 7919) % 100000:05d}" + ("" if i % 3 else f" +1 555 {i % 1000:03d} {i % 10000:04d}, ") for i in range(n))
    took = {}
    for n in (2_000, 32_000, 32_000):
        df = spark.createDataFrame([(1, numbers(n))], "doc_id long, text string")
        began = time.time()
        assert pii.redact(df).selectExpr("length(text) n").first().n > 0
        took[n] = time.time() - began
    assert took[32_000] < 8


def test_clashing_columns_are_replaced_or_pass(spark):
    df = spark.createDataFrame([(1, "me@x.org", "old", 5, "k")], "doc_id long, text string, Base string, spans int, kind string")
    got = pii.find_spans(df)
    assert sorted(got.columns) == ["base", "doc_id", "kind", "spans", "text"] and [s.kind for s in got.first().spans] == ["email"]
    assert tuple(pii.redact(df).first()) == (1, "<EMAIL>", "old", 5, "k") and pii.redact(df).columns == df.columns


def plain_spans(found, m):
    """Base spans and passing candidates without those inside another, by pairs."""
    out = []
    for a in found:
        inside = lambda b: b[1] <= a[1] and a[2] <= b[2]
        if a[0] < len(pii.BASE) or not any(b is not a and inside(b) and (b[1:] != a[1:] or b[0] < a[0]) for b in found):
            out.append(a)
    return sorted(out)


def test_spans_and_redaction_equal_a_plain_selection(spark):
    import re as r_

    trees, least = pii.fit(spark)
    made = [t for t, _ in pii._training_texts(5, 150)] + [t for t in texts() if t and len(t) < 400][:200] + ["\U0001f600" * 700 + " me@x.org " + "é" * 600 + " 1.2.3.4"]
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(3)
    from pyspark.sql import functions as F

    cands = {}
    for r in df.select("doc_id", F.explode(pii._candidates(F.col("text"))).alias("c")).select("doc_id", "c.g", "c.start", "c.end", pii.compiled(trees, F.col("c")).alias("m")).collect():
        if r.m >= least[r.g]:
            cands.setdefault(r.doc_id, []).append((r.g + len(pii.BASE), r.start, r.end))
    found = {r.doc_id: r for r in pii.find_spans(df).collect()}
    red = {r.doc_id: r.text for r in pii.redact(df).collect()}
    names = list(pii.KINDS)
    for k, t in enumerate(made):
        base = [(names.index(x.split(":")[0]), *map(int, x.split(":")[1:])) for x in brute(t)]
        want = plain_spans(base + cands.get(k, []), None)
        assert [(names.index(s.kind), s.start, s.end) for s in found[k].spans] == want
        out, pos = "", 0
        for a, e, kind in sorted((a, -e, kind) for kind, a, e in want):
            if a >= pos:
                out += t[pos:a] + f"<{names[kind].upper()}>"
            pos = max(pos, -e)
        assert red[k] == out + t[pos:]
    assert r_.search("<EMAIL>", red[len(made) - 1])


def test_added_spans_against_labelled_texts(spark):
    made = pii._training_texts(1234, 400)
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(made)], "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind in pii.GENERATORS] for r in pii.find_spans(df).collect()}
    near = lambda a, b: min(a[1], b[1]) - max(a[0], b[0]) > 0.5 * (b[1] - b[0])
    truth = [(i, s) for i, (_, spans) in enumerate(made) for s in spans]
    added = [(i, s) for i, v in got.items() for s in v]
    recall = sum(any(near(g, s) for g in got[i]) for i, s in truth) / len(truth)
    precision = sum(any(near(s, g) for g in made[i][1]) for i, s in added) / len(added)
    assert recall >= 0.9 and precision >= 0.93, (recall, precision)
