"""Quality rules: document statistics, hard base rules, and boosted trees over the statistics.

Statistics are counted over whole texts in array form (see ``textarrays``), many documents at a time:

* ``n_words``: runs outside white space (``[^\\x20\\x09-\\x0D]+``); ``word_chars``: their code points;
* ``n_symbols``: characters of ``[#*$%&|<>]``;
* ``n_dup_lines``: lines (split at ``\\n``) that hold a word and equal an earlier line of the text;
* ``n_repeat_words``: words inside windows of 8 words that occur twice or more in the text.

``base_failed`` is ``n_words < 20 or 100 * n_repeat_words > 30 * n_words``. A document that passes is kept when the
boosted trees give it at least ``KEEP``. The trees are fitted on labelled documents of a bounded
sample (``PER_CLASS`` of each class; held-out rows are never read), with monotonic constraints:
more symbols, repeated words, duplicate lines, capitals or marks can only lower the probability. They are
flattened into node arrays and scored for a whole batch at once.

Null text counts as empty: all statistics are 0 and the base rules fail it. Without labels of both classes the trees are
a constant and the base rules alone decide. Repeated rows get equal verdicts; other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gbt, labelled
from .common import table, without
from .textarrays import Block, blocks, mix, rolling, span_hashes, starts_of

PER_CLASS = 3000
#: Least probability of label 1 that keeps a document.
KEEP = 0.3
WINDOW = 8
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_length", "symbols_per_word", "dup_line_share", "repeat_share", "capital_share", "digit_share", "mark_share", "words_per_line", "distinct_share", "pipe_share")
MONOTONE = (0, 0, -1, -1, -1, -1, 0, -1, 0, 1, -1)
_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
_CAPITAL = np.zeros(256, np.uint8)
_CAPITAL[65:91] = 1
_DIGIT = np.zeros(256, np.uint8)
_DIGIT[48:58] = 1
_MARK = np.zeros(256, np.uint8)
_MARK[[ord(c) for c in "!?@^_~=+\\/{}[]"]] = 1


def _per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[at[1:]] - sums[at[:-1]]


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = np.zeros(len(s), bool)
    if len(s) > 1:
        eq = s[1:] == s[:-1]
        same[1:] |= eq
        same[:-1] |= eq
    out = np.zeros(len(keys), bool)
    out[order] = same
    return out


def _later(keys: np.ndarray) -> np.ndarray:
    """Which keys equal an earlier one."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    out = np.zeros(len(keys), bool)
    if len(s) > 1:
        out[order[1:]] = s[1:] == s[:-1]
    return out


def statistics(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(base statistics, features) with a row for each text of the block."""
    data, at, n = block.data, block.at, len(block)
    w = block.words(fold=False)
    owner, words = w.owners(), w.counts.astype(np.int64)
    tag = mix(np.arange(1, n + 1).astype(np.uint64))
    head = starts_of(data)
    heads = np.zeros(len(data) + 1, np.int64)
    np.cumsum(head, out=heads[1:])
    length = heads[w.ends] - heads[w.starts]
    word_chars = np.bincount(owner, length, n).astype(np.int64)
    symbols = _per_text(_SYMBOL[data], at)
    # lines: cut at newlines and at the ends of texts
    newline = np.flatnonzero(data == 10)
    begin = np.concatenate([at[:-1], newline + 1])
    end_of = np.concatenate([newline, at[1:]])
    begin, end = np.sort(begin, kind="stable"), np.sort(end_of, kind="stable")
    line_owner = np.searchsorted(at, begin, "right") - 1
    line_owner = np.minimum(line_owner, n - 1) if n else line_owner
    held = np.searchsorted(w.starts, end) > np.searchsorted(w.starts, begin)
    begin, end, line_owner = begin[held], end[held], line_owner[held]
    dup = _later(span_hashes(data, begin, end) ^ tag[line_owner])
    dup_lines = np.bincount(line_owner, dup, n).astype(np.int64)
    lines = np.bincount(line_owner, minlength=n)
    # windows of words within one text
    h = w.hashes()
    repeat = np.zeros(n, np.int64)
    if len(h) >= WINDOW:
        inside = owner[: len(h) - WINDOW + 1] == owner[WINDOW - 1 :]
        first = np.flatnonzero(inside)
        twice = first[_repeated(rolling(h, WINDOW)[first] ^ tag[owner[first]])]
        if len(twice):
            cover = np.zeros(len(h) + 1, np.int64)
            np.add.at(cover, twice, 1)
            np.add.at(cover, twice + WINDOW, -1)
            repeat = np.bincount(owner, np.cumsum(cover[:-1]) > 0, n).astype(np.int64)
    fresh = ~_later(h ^ tag[owner]) if len(h) else np.zeros(0, bool)
    distinct = np.bincount(owner, fresh, n)
    base = np.column_stack([words, word_chars, symbols, dup_lines, repeat])
    nw, nc, nl = np.maximum(words, 1), np.maximum(word_chars, 1), np.maximum(lines, 1)
    features = np.column_stack(
        [
            np.log1p(words), word_chars / nw, symbols / nw, dup_lines / nl, repeat / nw, _per_text(_CAPITAL[data], at) / nc, _per_text(_DIGIT[data], at) / nc,
            _per_text(_MARK[data], at) / nw, words / nl, distinct / np.maximum(words, 1) ** 0.85, _per_text((data == 124).astype(np.uint8), at) / nw,
        ]
    )
    return base, features


def _struct(columns: list[np.ndarray], names: tuple[str, ...]) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], list(names))


def _over(texts: pa.Array, then) -> pa.Array:
    """``then`` of the statistics of an Arrow array of texts."""
    parts = [then(*statistics(b)) for b in blocks(texts)]
    return pa.concat_arrays(parts) if parts else then(np.empty((0, len(BASE)), np.int64), np.empty((0, len(FEATURES))))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, label: str = "quality") -> gbt.Trees:
    """Trees from at most ``2 * per_class`` labelled documents; only their features reach the driver."""
    @F.arrow_udf(", ".join(f"{k} double" for k in FEATURES))
    def features(texts: pa.Array) -> pa.Array:
        return _over(texts, lambda b, f: _struct(list(f.T), FEATURES))

    chosen = labelled.sample(docs, labels, per_class, label)
    rows = sorted(tuple(r) for r in chosen.withColumn("f", features("__text")).select("__id", "__label", "f.*").collect())
    x = np.array([r[2:] for r in rows], float).reshape(-1, len(FEATURES))
    y = np.array([r[1] for r in rows], float)
    if len(set(y)) < 2:
        return gbt.fit(np.empty((0, len(FEATURES))), [], MONOTONE)
    return gbt.fit(x, y, MONOTONE)


def apply_rules(df: DataFrame, trees: gbt.Trees, text: str = "text", keep: float = KEEP) -> DataFrame:
    """All columns of ``df``, the base statistics, ``base_failed``, ``probability`` and ``kept``, which replace columns of these names. One pass, no shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(trees)
    names = (*BASE, "probability")
    df = without(df, *names, "base_failed", "kept")

    @F.arrow_udf(", ".join(f"{k} {'double' if k == 'probability' else 'long'}" for k in names))
    def run(texts: pa.Array) -> pa.Array:
        return _over(texts, lambda b, f: _struct([*b.T, shared.value.probability(f)], names))

    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    scored = df.withColumn("__q", run(F.col(f"`{text}`").cast("string")))
    return (
        scored.select(*[F.col(f"`{c}`") for c in df.columns], "__q.*")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= keep))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = fit(docs, table(spark, sf_dir, "labels"))
    return apply_rules(docs, trees).select("doc_id", *BASE, "base_failed", "kept", "probability")
