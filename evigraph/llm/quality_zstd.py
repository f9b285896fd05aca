"""Quality by compression: dictionaries of good and of bad text, and which of the two compresses a text better.

Two zstandard dictionaries are trained on labelled text. A text is cut into pieces of ``PIECE`` bytes
(all of it; short pieces keep the text's own history from hiding what the dictionaries add), each piece
is compressed with both, and ``(bytes with bad - bytes with good) / bytes of text`` is the normalised
difference. A logistic curve fitted on labelled rows that the dictionaries have not seen, weighed as
the classes are in all labels, makes it a score. A short text says little, so its margin is drawn to that of the
classes' shares: ``HALF`` bytes have half the weight of a long text.

Fitting takes a sample of labelled documents, each of them whole: of each class at most ``PER_CLASS``, in order of the ids' hashes, and no more
than fit into ``CLASS_BYTES`` (the first one in any case). Scoring takes every whole text. Null and empty texts score
the share of good labels. Where a class has fewer than ``LEAST`` sampled documents with text, there is nothing to calibrate with and every score is the smoothed share of
good labels. Where zstandard refuses to train on so little text, the last ``DICTIONARY`` bytes of the class's texts are its dictionary.
An id that several documents have counts once when fitting. Repeated rows get equal scores; other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import labelled
from .common import over_texts, table

#: The sample: documents of each class, and bytes of their texts.
PER_CLASS, CLASS_BYTES = 3000, 24 << 20
#: Documents with text that each class needs.
LEAST = 4
DICTIONARY, PIECE, LEVEL = 32768, 1500, 3
THRESHOLD = 0.7
HALF = 150


class Model:
    """Dictionaries and calibration; small enough to travel with a task."""

    def __init__(self, bad: bytes, good: bytes, slope: float, offset: float, prior: float):
        self.bad, self.good, self.slope, self.offset, self.prior = bad, good, slope, offset, prior
        self._pair = None

    def __getstate__(self):
        return self.__dict__ | {"_pair": None}

    def difference(self, text: str | None) -> tuple[float, int]:
        """The normalised difference of a text and its bytes."""
        if not text or not self.bad:
            return 0.0, 0
        if self._pair is None:
            self._pair = [
                zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False)
                for d in (self.bad, self.good)
            ]
        body = text.encode("utf-8", "surrogatepass")
        bad, good = self._pair
        total = 0
        for i in range(0, len(body), PIECE):
            piece = body[i : i + PIECE]
            total += len(bad.compress(piece)) - len(good.compress(piece))
        return total / len(body), len(body)

    def score(self, texts) -> np.ndarray:
        x, n = np.array([self.difference(t) for t in texts], float).reshape(-1, 2).T
        told = n / (n + HALF)
        margin = told * (self.slope * x + self.offset) + (1 - told) * self.prior
        return 1.0 / (1.0 + np.exp(-np.clip(margin, -30, 30)))


def _train(texts: list[bytes]) -> bytes:
    parts = [t[i : i + 2000] for t in texts for i in range(0, len(t), 2000)]
    try:
        return zstandard.train_dictionary(DICTIONARY, parts, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: its end is the dictionary
        return b"".join(texts)[-DICTIONARY:]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Newton's method with a slight ridge on the slope, which is in units of the spread of ``x``."""
    scale = float(np.std(x)) or 1.0
    z = np.clip(x / scale, -6, 6)
    a = np.column_stack([z, np.ones_like(z)])
    w, ridge = np.zeros(2), np.diag([1e-2, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + ridge
        step = np.linalg.solve(h, a.T @ (weight * (y - p)) - ridge @ w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, label: str = "quality", class_bytes: int = CLASS_BYTES) -> Model:
    chosen = labelled.within(labelled.sample(docs, labels, per_class, label), class_bytes)
    rows = sorted(tuple(r) for r in chosen.select("__id", "__label", "__text").collect())
    sides: dict[int, list[str]] = {0: [], 1: []}
    for _, y, t in rows:
        if t:
            sides[y].append(t)
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~labelled.is_held_out())
    count = {0: 1, 1: 1} | {r[0]: r[1] + 1 for r in known.groupBy(label).count().collect()}
    prior = float(np.log(count[1] / count[0]))
    if min(map(len, sides.values())) < LEAST:
        return Model(b"", b"", 0.0, prior, prior)
    # three of four rows train the dictionaries, the fourth calibrates
    for_dictionary = {y: [t.encode("utf-8", "surrogatepass") for k, t in enumerate(v) if k % 4] for y, v in sides.items()}
    model = Model(_train(for_dictionary[0]), _train(for_dictionary[1]), 1.0, 0.0, prior)
    rest = [(*model.difference(t), c) for c, v in sides.items() for k, t in enumerate(v) if k % 4 == 0]
    x, n, y = np.array(rest, float).T
    weight = n / (n + HALF) * np.where(y == 1, count[1] / max((y == 1).sum(), 1), count[0] / max((y == 0).sum(), 1))
    model.slope, model.offset = _logistic(x, y, weight / weight.mean())
    return model


def score_documents(df: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """All columns of ``df`` and ``score`` (double, 0 to 1), which replaces a column of that name. One pass, no shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    run = over_texts(lambda col: pa.array(shared.value.score(col.to_pylist()), pa.float64()), "double")
    return df.withColumn(score, run(F.col(f"`{text}`").cast("string")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, model).select(
        "doc_id",
        labelled.is_held_out().alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )
