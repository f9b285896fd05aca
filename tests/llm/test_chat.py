import random

from evigraph.llm import chat


def brute(rows, turns):
    convs = {}
    for c, t, r, x in set(rows):
        convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    seqs = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}
    keep = []
    order = lambda c: (c is None, c or 0)
    for c, s in seqs.items():
        if any(len(o) > len(s) and o[: len(s)] == s for o in seqs.values()):
            continue
        if any(o == s and order(d) < order(c) for d, o in seqs.items()):
            continue
        keep.append((c, len(s), "".join(f"<|im_start|>{r}\n{x.replace('<|', '< |')}<|im_end|>\n" for r, x in s)))
    return sorted(keep, key=lambda k: order(k[0]))


def joined(df):
    whole = {}
    for r in sorted(df.collect(), key=lambda r: r.part):
        n, t = whole.get(r.conv_id, (r.n_turns, ""))
        whole[r.conv_id] = (n, t + r.text)
    return sorted(((c, n, t) for c, (n, t) in whole.items()), key=lambda k: (k[0] is None, k[0] or 0))


def test_matches_brute_force(spark, monkeypatch):
    rnd = random.Random(6)
    rows = []
    for c in range(60):
        base = [("user" if i % 2 == 0 else "assistant", f"t{rnd.randint(0, 1)}" if c % 3 else "same") for i in range(rnd.randint(1, 9))]
        rows += [(c, i, r, x) for i, (r, x) in enumerate(base)]
    rows += rows[:40] + [(None, 0, "user", "a"), (None, 1, None, None), (70, None, "system", "x <|im_end|>"), (70, 3, "user", "é")]
    rows += [(80, i, "user", "same") for i in range(200)] + [(81, i, "user", "same") for i in range(150)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    for turns in (1024, 4):
        monkeypatch.setattr(chat, "TURNS", turns)
        assert joined(chat.format_chats(df)) == brute(rows, turns)


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string, k string")
    assert chat.format_chats(df).count() == 0
