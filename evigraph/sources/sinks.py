"""Sinks: checked snapshots, result envelopes and fingerprints."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import Versions
from ..operators.integrity import orphans, status

SCHEMA_VERSION = "1"
TABLES = ("nodes", "edges", "evidence", "warnings")


def write_snapshot(path: str, nodes: DataFrame, edges: DataFrame, evidence: DataFrame, warnings: DataFrame) -> None:
    """A snapshot of four tables and metadata: written beside the one before, checked for foreign keys, then named as the one that counts.

    A failure at any place leaves the snapshot before it.
    """
    spark = nodes.sparkSession
    versions, name = Versions(spark, path), uuid.uuid4().hex
    stage = versions.place(name)
    try:
        nodes.write.partitionBy("kind").parquet(f"{stage}/nodes")
        edges.write.partitionBy("kind").parquet(f"{stage}/edges")
        evidence.write.parquet(f"{stage}/evidence")
        warnings.write.parquet(f"{stage}/warnings")
        n, e, v = (spark.read.parquet(f"{stage}/{t}") for t in TABLES[:3])
        ends = e.select(F.col("source_id").alias("node_id")).union(e.select("target_id"))
        if not orphans(ends, "node_id", n, "node_id").isEmpty() or not orphans(v, "edge_id", e, "edge_id").isEmpty():
            raise ValueError("the snapshot has rows without a parent")
        counts = [(f"{t}_count", str(spark.read.parquet(f"{stage}/{t}").count())) for t in TABLES]
        spark.createDataFrame([("schema_version", SCHEMA_VERSION), *counts], "key string, value string").coalesce(1).write.parquet(f"{stage}/metadata")
        versions.name(name)
    except BaseException:
        versions.place(name)
        raise


def read_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a snapshot of the known version."""
    at = Versions(spark, path).current()
    if at is None:
        raise ValueError(f"no snapshot at {path}")
    meta = dict(map(tuple, spark.read.parquet(f"{at}/metadata").collect()))
    if meta.get("schema_version") != SCHEMA_VERSION:
        raise ValueError(f"snapshot version {meta.get('schema_version')} is not supported")
    return {t: spark.read.parquet(f"{at}/{t}") for t in TABLES}


#: Facts and problems that an envelope may hold.
ENVELOPE = 100_000


def envelope(facts: DataFrame, problems: DataFrame, schema_version: str, responsibility: str, boundaries: list[str], most: int = ENVELOPE) -> dict:
    """The result document of a tool: sorted facts, validation and limits. Results over ``most`` rows are refused; write them as a snapshot."""
    if max(facts.limit(most + 1).count(), problems.limit(most + 1).count()) > most:
        raise ValueError(f"a result document has at most {most} facts and problems")
    rows = sorted((json.loads(r[0]) for r in facts.select(F.to_json(F.struct(*facts.columns), {"ignoreNullFields": "false"})).collect()), key=lambda x: json.dumps(x, sort_keys=True))
    found = sorted((r.asDict() for r in problems.collect()), key=lambda x: json.dumps(x, sort_keys=True))
    s = status(problems).first()
    return {
        "schema_version": schema_version,
        "facts": rows,
        "validation": {"status": s.status, "problem_count": s.problem_count, "problems": found},
        "limits": {"responsibility": responsibility, "boundaries": boundaries, "analysis_engines": ["spark"]},
    }


def error_envelope(kind: str, message: str) -> tuple[dict, int]:
    """An envelope with one problem and exit code 2; kinds are argument and input."""
    if kind not in ("argument", "input"):
        raise ValueError(kind)
    problem = {"severity": "error", "code": f"{kind}-error", "message": message}
    return {"request": {"status": "failed", "kind": kind}, "validation": {"status": "error", "problem_count": 1, "problems": [problem]}}, 2


def dump(document: dict) -> str:
    return json.dumps(document, ensure_ascii=False, indent=2)


def exit_code(document: dict) -> int:
    return 1 if document["validation"]["status"] == "error" else 0


def fingerprint(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rel, sha256, bytes) of files with contents, and (top, file_count, bytes) by top directory."""
    each = files.select("rel", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("bytes"))
    return each, each.groupBy(F.substring_index("rel", "/", 1).alias("top")).agg(F.count("*").alias("file_count"), F.sum("bytes").alias("bytes"))
