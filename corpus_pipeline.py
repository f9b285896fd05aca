"""From raw documents to token ids: five operators, each over all that the one before kept.

1. ``quality``: documents that the compression classifier rejects go.
2. ``near_duplicates``: of documents linked by five-word shingles at Jaccard 0.8 or more, the least doc_id stays.
3. ``decontaminate``: documents that hold a benchmark passage go.
4. ``redact``: personal data becomes a mark of its kind; n_chars follows.
5. ``encode``: SentencePiece ids of the text.

Each function takes (spark, docs, sf_dir); all but the last return the columns of ``docs``. Nulls in any column
are kept as they are; null text counts as empty. An empty table passes through. Repeated rows (equal id and text) are scored and redacted alike, and one of
them stays after stage 2; of a group the least doc_id stays, and of several texts with that id one row each. Very long texts are taken whole; further columns pass through
up to stage 4.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm import decontaminate as leaks
from evigraph.llm import ngram_join, pii, quality_zstd, sp_wfst
from evigraph.llm.common import discard, materialise, table

#: Words of a shingle, and the similarity as a fraction.
SHINGLE, SIMILAR = 5, (80, 100)
#: Chunks that an encoding worker remembers: fewer than alone, as workers have other stages behind them.
REMEMBERED = 160_000
MODEL = sp_wfst.MODEL


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_zstd.fit(docs, table(spark, sf_dir, "labels"))
    return quality_zstd.score_documents(docs, model, score="__score").filter(F.col("__score") >= quality_zstd.THRESHOLD).drop("__score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs, SHINGLE, *SIMILAR)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return leaks.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = sp_wfst.encode_documents(docs, sp_wfst.read_model(MODEL), keep=["doc_id", "lang", "source"], memory=REMEMBERED)
    return out.select("doc_id", "lang", "source", F.size("ids").alias("n_tokens"), "ids")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("redact", redact), ("encode", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), name)
        discard(before)  # written by a stage; the input tables are not
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier and the encoder are not expressible in SQL; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None
