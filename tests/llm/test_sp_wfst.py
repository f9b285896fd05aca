import random

import pytest

sp = pytest.importorskip("sentencepiece")
from evigraph.llm.sp_wfst import MODEL, Machine, decode_documents, encode_documents, read_model  # noqa: E402


@pytest.fixture(scope="module")
def both():
    return Machine(read_model()), sp.SentencePieceProcessor(model_file=MODEL)


def test_same_ids_as_the_library(both):
    ours, theirs = both
    rnd = random.Random(5)
    parts = [" ", "  ", "▁", "a", "th", "ing", "é", "漢", "\n", "\t", "12", ".", ",", "))", "the ", "𓀀", "\x00", "     ", "###", "ß"]
    for _ in range(4000):
        s = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30)))
        ids = ours.encode(s)
        assert ids == theirs.encode(s), s
        if "▁" not in s:
            assert ours.decode(ids) == s


def test_long_run_and_cache_turnover(both):
    ours, theirs = Machine(read_model(), memory=3), both[1]
    for s in ("ab" * 3000, " " * 500 + "x", "one two three four five six one two"):
        assert ours.encode(s) == theirs.encode(s)


def test_documents(spark, both):
    rows = [(1, "Hello  world", "x"), (2, None, "x"), (3, "", None), (1, "Hello  world", "x"), (4, "é漢\n" * 2000, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ok string")
    out = encode_documents(df, read_model(), check="same")
    got = {(r.doc_id, r.text): r for r in out.collect()}
    assert out.columns == ["doc_id", "text", "ok", "ids", "same"]
    assert got[(2, None)].ids == [] and got[(2, None)].same and all(r.same for r in got.values())
    assert got[(1, "Hello  world")].ids == both[1].encode("Hello  world")
    back = decode_documents(out, read_model())
    assert all(r.decoded == (r.text or "") for r in back.collect())
    assert encode_documents(df, read_model(), ids="OK").columns == ["doc_id", "text", "OK"]
    assert encode_documents(df.limit(0), read_model()).count() == 0


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
def test_compiled_character_maps(rule):
    model = read_model() + sp.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()
    theirs = sp.SentencePieceProcessor(model_proto=model)
    ours = Machine(model)
    rnd = random.Random(11)
    parts = [" ", "  ", "▁", "a", "Th", "ﬁ", "é", "e\u0301", "Ａ", "漢", "\n", "\t", "①", "½", "\u200b", "\u3000", "ß", "İ", "\x00", "한", "ᄒ", "ᅡ", "ᆫ", "𝔘", "™", "x"]
    for _ in range(2000):
        s = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 20)))
        assert ours.encode(s) == theirs.encode(s), (s, ours.normalise(s))


def test_runs_of_any_length_go_through_the_machine(both, monkeypatch):
    ours, theirs = both
    monkeypatch.setattr(ours, "_merged", (lambda f: lambda s: f(s) if len(s) < 64 else 1 / 0)(ours._merged))
    rnd = random.Random(3)
    for s in ("x" * 5000, "".join(rnd.choice("abcdeé漢") for _ in range(4000)), "=" * 3000, "𓀀" * 1500):
        assert ours.encode(s) == theirs.encode(s)
