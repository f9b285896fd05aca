"""Personal data: base patterns, and boosted trees over the candidates of high-recall generators. DataFrame functions only.

Base kinds, leftmost and non-overlapping within a kind: ``email``, ``ip`` (parts at most 255), ``card`` (13 to 19
digits that pass Luhn), ``phone`` (9 to 15 digits). A match that fails its test is dropped and not tried again. The patterns are
written with possessive repeats and start where a run starts, which leaves their matches as they are and keeps
matching linear in the text.

Generators propose further spans, which may overlap: ``secret`` (long runs of token characters), ``number`` (7 to 19
digits with separators), ``contact`` (phone-like groups without a plus sign) and ``address`` (e-mail with the
signs spelled out). Trees score each candidate from its format (length, shares of digits, letters and hex
digits, character variety, case changes, groups) and its context (key words, assignment and quote before it). They are fitted on
texts that this module writes itself from a seed (spans known), a quarter of which calibrates the margin (Platt) and sets,
for each generator, the threshold that reaches ``PRECISION``. The fitted trees are compiled to ``CASE`` expressions.
A candidate is added when it passes its threshold and lies inside no base span and no other candidate that passes (of equal ones the generator
listed first stays); it may overlap or hold base spans, which stay. All steps are linear in the text, but for sorting a text's spans.

Spans are in code points, ends exclusive. Null text counts as empty; repeated rows get equal results; whole texts, however long, are
searched; result columns replace columns of their names, the others pass through; an empty table gives no rows.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gbt
from .common import table, without

_LOCAL = "[A-Za-z0-9._%+-]"
_AT_START = r"(?:\G|(?<!{0}))"
#: The base patterns, by kind in order.
BASE = {
    "email": _AT_START.format(_LOCAL) + _LOCAL + r"++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": _AT_START.format("[0-9]") + r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_HOLDS = {"email": "@", "phone": "+"}
GENERATORS = {
    "secret": r"(?:\G|(?<![A-Za-z0-9_+/=-]))[A-Za-z0-9_+/-]{16,}+={0,2}+",
    "number": r"(?:\G|(?<![0-9]))[0-9](?:[\x20.-]?[0-9]){6,18}+",
    "contact": r"\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])",
    "address": r"[A-Za-z0-9._%+-]{2,64}\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[(\[]dot[)\]])\x20?[A-Za-z0-9-]++)++",
}
_MAY = {"secret": "[A-Za-z0-9_+/-]{16}", "number": "[0-9]", "contact": "[0-9]{3}", "address": r"[(\[]at[)\]]"}
KINDS = (*BASE, *GENERATORS)
#: Characters of context before a candidate, and code points of the parts that a text is cut into when it is rewritten.
CONTEXT, PART = 32, 512
_WORDS = r"(?i)(token|secret|api.?key|password|passwd|pwd|auth|bearer|credential|private.?key|access.?key)\W{0,8}$"
_PERSON = r"(?i)(tel|phone|call|mobile|fax|ssn|social security|passport|account|iban|card|contact|licen[cs]e no|id no)\W{0,8}(no|number|nr)?\W{0,6}$"
_MAIL = r"(?i)(mail|contact|write|reach)\W{0,8}(to|me|us)?\W{0,6}$"
FEATURES = ("generator", "length", "digits", "hexes", "uppers", "variety", "turns", "groups", "secret_word", "person_word", "mail_word", "assigned", "quoted", "luhn")
PRECISION, SEED, TEXTS = 0.97, 11, 1500
_SPAN = "array<struct<start:bigint,end:bigint,s:string,before:string>>"


def _scan(values: Column, join) -> Column:
    """The running ``join`` of an array, by doubling: n log n steps and no growing arrays."""
    step = lambda k: F.call_function("shiftleft", F.lit(1), k)

    def of(v: Column) -> Column:
        rounds = F.when(F.size(v) > 1, F.sequence(F.lit(0), F.ceil(F.log2(F.size(v))).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(rounds, v, lambda acc, k: F.transform(acc, lambda x, i: F.when(i >= step(k), join(x, F.get(acc, i - step(k)))).otherwise(x)))

    return _bound(values, of)


def _bound(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.transform(F.array(value), then)[0]


def _matches(text: Column, pattern: str, may: Column) -> Column:
    """Leftmost non-overlapping matches with places and the text before each. The pieces between matches place them, so no text is searched twice for a place."""

    def placed(x: Column) -> Column:
        size = F.transform(x["m"], lambda m, i: (F.length(m) + F.length(F.get(x["p"], i))).cast("long"))
        return _bound(_scan(size, lambda a, b: a + b), lambda ends: F.transform(x["m"], lambda m, i: F.struct((F.get(ends, i) - F.length(m)).alias("start"), F.get(ends, i).alias("end"), m.alias("s"), F.substring(F.get(x["p"], i), -CONTEXT, CONTEXT).alias("before"))))

    found = _bound(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p")), placed)
    return F.when(may, found).otherwise(F.array().cast(_SPAN))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(s, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    n = F.length(_digits(s))
    if kind == "card":
        return F.when(n.between(13, 19), F.call_function("luhn_check", _digits(s))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _share(s: Column, keep: str) -> Column:
    return F.length(F.regexp_replace(s, keep, "")) / F.greatest(F.length(s), F.lit(1))


def _features(generator: Column, s: Column, before: Column) -> dict[str, Column]:
    number = lambda c: c.cast("double")
    return {
        "generator": number(generator),
        "length": number(F.length(s)),
        "digits": _share(s, "[^0-9]"),
        "hexes": _share(s, "[^0-9a-fA-F]"),
        "uppers": _share(s, "[^A-Z]"),
        "variety": number(F.size(F.array_distinct(F.split(s, "")))) / F.greatest(F.length(s), F.lit(1)),
        "turns": number(F.size(F.regexp_extract_all(s, F.lit("[a-z][A-Z0-9]|[0-9][A-Za-z]"), F.lit(0)))) / F.greatest(F.length(s), F.lit(1)),
        "groups": number(F.size(F.split(s, r"[\x20._/-]+"))),
        "secret_word": number(before.rlike(_WORDS).cast("int")),
        "person_word": number(before.rlike(_PERSON).cast("int")),
        "mail_word": number(before.rlike(_MAIL).cast("int")),
        "assigned": number(before.rlike(r"[=:]\s*[\"'`]?$").cast("int")),
        "quoted": number(before.rlike(r"[\"'`]$").cast("int")),
        "luhn": number(F.when(F.length(_digits(s)).between(13, 19), F.call_function("luhn_check", _digits(s))).otherwise(False).cast("int")),
    }


def _candidates(text: Column) -> Column:
    """Array of (generator, start, end, features) over all generators."""
    parts = []
    for g, (kind, pattern) in enumerate(GENERATORS.items()):
        parts.append(_described(g, _matches(text, pattern, text.rlike(_MAY[kind]))))
    return F.concat(*parts)


def _described(g: int, found: Column) -> Column:
    def one(x: Column) -> Column:
        f = _features(F.lit(g), x["s"], x["before"])
        return F.struct(F.lit(g).alias("g"), x["start"].alias("start"), x["end"].alias("end"), *[f[k].alias(k) for k in FEATURES])

    return F.transform(found, one)


# --- fitting ------------------------------------------------------------------------------------

_PLAIN = "the river was long and people went over it when evening came with light from houses on hills near towns".split()


def _training_texts(seed: int = SEED, n: int = TEXTS) -> list[tuple[str, list[tuple[int, int]]]]:
    """Texts that hold spans to find, and look-alikes that are none."""
    rnd = random.Random(seed)
    pick = lambda chars, k: "".join(rnd.choice(chars) for _ in range(k))
    hexes, digits, lower = "0123456789abcdef", "0123456789", "abcdefghijklmnopqrstuvwxyz"
    mixed = lower + lower.upper() + digits
    secret_words = ["token", "secret", "api_key", "password", "auth", "Bearer", "access_key", "API key"]
    person_words = ["tel", "phone", "ssn", "account", "passport", "mobile", "call", "card no"]

    def secret() -> tuple[str, str]:
        w, body = rnd.choice(secret_words), rnd.choice([lambda: pick(hexes, rnd.choice([32, 40, 64])), lambda: pick(mixed, rnd.randint(20, 48)), lambda: pick(mixed + "_-", rnd.randint(20, 40))])()
        return rnd.choice([f'{w} = "', f"{w}: ", f"{w}='", f"{w} ", "", 'x = "', "key: "]), body

    def person() -> tuple[str, str]:
        d = rnd.choice([f"{pick(digits, 3)}-{pick(digits, 2)}-{pick(digits, 4)}", f"{pick(digits, 3)} {pick(digits, 3)} {pick(digits, 4)}", pick(digits, rnd.randint(8, 12))])
        return f"{rnd.choice(person_words)}{rnd.choice([': ', ' ', ' no. '])}", d

    def contact() -> tuple[str, str]:
        return rnd.choice(["", "tel ", "phone: "]), rnd.choice([f"({pick(digits, 3)}) {pick(digits, 3)}-{pick(digits, 4)}", f"({pick(digits, 3)}) 555-{pick(digits, 4)}"])

    def address() -> tuple[str, str]:
        return rnd.choice(["", "mail ", "write to "]), f"{pick(lower, 6)} {rnd.choice(['(at)', '[at]'])} {pick(lower, 7)}{rnd.choice(['.', ' (dot) ', ' [dot] '])}com"

    def other() -> str:
        return rnd.choice(
            [
                lambda: "".join(rnd.choice(_PLAIN) for _ in range(rnd.randint(4, 9))),
                lambda: "-".join(rnd.choice(_PLAIN) for _ in range(rnd.randint(4, 8))),
                lambda: "_".join(rnd.choice(_PLAIN) for _ in range(rnd.randint(4, 7))),
                lambda: "/" + "/".join(rnd.choice(_PLAIN) for _ in range(5)),
                lambda: pick(digits, rnd.randint(7, 19)),
                lambda: f"20{pick('012', 2)}-0{pick('123456789', 1)}-1{pick(digits, 1)} 1{pick(digits, 1)}",
                lambda: f"{pick(digits, 3)}.{pick(digits, 3)}.{pick(digits, 3)}",
                lambda: f"{pick(digits, 4)} {pick(digits, 4)} {pick(digits, 4)}",
                lambda: "".join(rnd.choice(_PLAIN) for _ in range(4)).upper(),
                lambda: "=" * rnd.randint(16, 60),
                lambda: "-" * rnd.randint(16, 60),
                lambda: "".join(rnd.choice(_PLAIN).title() for _ in range(rnd.randint(3, 6))),
            ]
        )()

    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rnd.randint(2, 5)):
            text += " ".join(rnd.choice(_PLAIN) for _ in range(rnd.randint(2, 6))) + rnd.choice([" ", ", ", "\n"])
            if rnd.random() < 0.5:
                lead, body = rnd.choice([secret, person, contact, address])()
                spans.append((len(text) + len(lead), len(text) + len(lead) + len(body)))
                text += lead + body + ('"' if lead.endswith('"') else "'" if lead.endswith("'") else "") + " "
            else:
                text += other() + " "
        out.append((text, spans))
    return out


_fitted: dict[tuple, tuple] = {}


def fit(spark: SparkSession, seed: int = SEED, texts: int = TEXTS) -> tuple[gbt.Trees, list[float]]:
    """Trees and the margin from which each generator's candidates are taken. The same seed gives the same model."""
    if (seed, texts) in _fitted:
        return _fitted[seed, texts]
    made = _training_texts(seed, texts)
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(made)], "i int, text string")
    rows = df.select("i", F.explode(_candidates(F.col("text"))).alias("c")).select("i", "c.*").collect()
    rows.sort(key=lambda r: (r["i"], r["g"], r["start"]))
    x = np.array([[r[k] for k in FEATURES] for r in rows], float)
    y = np.array([any(s <= r["start"] and r["end"] <= e and 2 * (r["end"] - r["start"]) > e - s for s, e in made[r["i"]][1]) for r in rows], float)
    rest = np.array([r["i"] % 4 == 0 for r in rows])
    trees = gbt.fit(x[~rest], y[~rest], trees=40, depth=3, rate=0.2, bins=32)
    margin, truth, kind = trees.margin(x[rest]), y[rest], x[rest, 0]
    slope, offset = _platt(margin, truth)
    least = []
    for g in range(len(GENERATORS)):
        m, t = margin[kind == g], truth[kind == g]
        order = np.argsort(-m)
        right = np.cumsum(t[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(right >= PRECISION)
        sharp = m[order][good[-1]] if len(good) else np.inf
        even = (np.log(0.5 / 0.5) - offset) / slope  # probability one half is asked for in any case
        least.append(float(max(sharp, even)))
    _fitted[seed, texts] = trees, least
    return trees, least


def _platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    w = np.array([1.0, 0.0])
    a = np.column_stack([margin, np.ones_like(margin)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag([1e-2, 1e-3])
        w += np.clip(np.linalg.solve(h, a.T @ (y - p) - np.array([1e-2 * (w[0] - 1), 1e-3 * w[1]])), -1, 1)
    return max(float(w[0]), 0.05), float(w[1])


def compiled(trees: gbt.Trees, row: Column) -> Column:
    """The margin of a struct of features as nested CASE expressions."""

    def walk(k: int) -> Column:
        f = int(trees.feature[k])
        if f < 0:
            return F.lit(float(trees.value[k]))
        return F.when(row[FEATURES[f]] <= float(trees.threshold[k]), walk(int(trees.left[k]))).otherwise(walk(int(trees.right[k])))

    total = F.lit(trees.base)
    for root in trees.roots:
        total = total + walk(int(root))
    return total


# --- applying ---------------------------------------------------------------------------------


def _base_spans(k: int, kind: str, found: Column) -> Column:
    good = F.filter(found, lambda x: _valid(kind, x["s"]))
    return F.transform(good, lambda x: F.struct(F.lit(k).alias("k"), x["start"].alias("start"), x["end"].alias("end")))


def find_spans(df: DataFrame, text: str = "text", base: str = "base", spans: str = "spans") -> DataFrame:
    """All columns of ``df`` with two arrays of (kind, start, end): base spans, and all spans, by kind as listed and start."""
    trees, least = fit(df.sparkSession)
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    named = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        may = F.contains(body, F.lit(_HOLDS[kind])) if kind in _HOLDS else body.rlike("[0-9]")
        named.append(_base_spans(k, kind, _matches(body, pattern, may)))
    with_base = df.withColumn("__base", F.concat(*named)).withColumn("__cand", _candidates(body))
    scored = F.transform("__cand", lambda c: F.struct(c["g"].alias("g"), c["start"].alias("start"), c["end"].alias("end"), compiled(trees, c).alias("m")))
    enough = F.array(*[F.lit(x) for x in least])
    passed = F.filter(scored, lambda c: c["m"] >= F.get(enough, c["g"]))
    spans_of = F.concat(F.col("__base"), F.transform(passed, lambda c: F.struct((c["g"] + len(BASE)).alias("k"), c["start"].alias("start"), c["end"].alias("end"))))

    def outer(items: Column) -> Column:
        """Spans in order of start, the longest first; a candidate inside one before it goes."""
        far = _scan(F.transform(items, lambda x: -x["less"]), F.greatest)
        return _bound(far, lambda tops: F.filter(items, lambda x, i: (x["k"] < len(BASE)) | (i == 0) | (F.get(tops, i - 1) < -x["less"])))

    ordered = F.array_sort(F.transform(spans_of, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("less"), x["k"].alias("k"))))
    every = F.transform(_bound(ordered, outer), lambda x: F.struct(x["k"].alias("k"), x["start"].alias("start"), (-x["less"]).alias("end")))
    names = F.array(*[F.lit(k) for k in KINDS])
    show = lambda a: F.transform(F.array_sort(a), lambda x: F.struct(F.get(names, x["k"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    out = with_base.withColumn("__every", show(every)).withColumn("__base", show(F.col("__base")))
    return without(out, base, spans).withColumnsRenamed({"__base": base, "__every": spans}).drop("__cand")


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with each span of its text replaced by ``<KIND>``; overlapping spans of several kinds become one mark, that of the first. Null stays null.

    Texts are cut into parts of ``PART`` code points first, so that what lies between two spans is found without reading from the text's beginning.
    """
    found = find_spans(df, text, "__b", "__s")
    body = F.col(f"`{text}`").cast("string")
    ordered = F.array_sort(F.transform("__s", lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("less"), x["kind"].alias("kind"))))

    def rewritten(x: Column) -> Column:
        def between(a: Column, b: Column) -> Column:
            first = F.floor(a / PART).cast("int")
            near = F.array_join(F.slice(x["parts"], first + 1, F.floor(b / PART).cast("int") - first + 1), "")
            return F.substring(near, (a - first * PART + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))

        def marked(far: Column) -> Column:
            before = lambda i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(far, i - 1))
            opens = F.filter(F.transform(x["spans"], lambda s, i: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), before(i).alias("before"))), lambda s: s["start"] >= s["before"])
            pieces = F.transform(opens, lambda s: F.concat(between(s["before"], s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">")))
            return F.concat(F.array_join(pieces, ""), between(F.element_at(far, -1), x["n"]))

        return _bound(_scan(F.transform(x["spans"], lambda s: -s["less"]), F.greatest), marked)

    parts = F.regexp_extract_all(body, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))
    done = _bound(F.struct(ordered.alias("spans"), parts.alias("parts"), F.length(body).cast("long").alias("n")), rewritten)
    return found.withColumn(text, F.when(F.size("__s") > 0, done).otherwise(body)).drop("__b", "__s")


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_spans(docs)
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
