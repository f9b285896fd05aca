"""File scans: names and contents of a tree, strict and relaxed JSON documents, projects and descriptors."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import in_skipped, leaf


def iter_files(spark: SparkSession, root: str, suffixes: list[str] | None = None, names: list[str] | None = None, content: bool = False) -> DataFrame:
    """(path, length[, content]) of files below ``root`` by suffix or exact name, any case; skipped directories, by exact name, are left out.

    The listing is Spark's own, so any file system that it reads will do; contents are read only where asked for.
    """
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), f"^{re.escape(base)}/", "")
    df = df.withColumn("rel", rel).filter(~in_skipped(F.col("rel")))
    name = F.lower(leaf(F.col("path")))
    if suffixes:
        df = df.filter(F.exists(F.array(*[F.lit(s.lower()) for s in suffixes]), lambda s: F.endswith(name, s)))
    if names:
        df = df.filter(name.isin([n.lower() for n in names]))
    return df.select("path", "rel", "length", *(["content"] if content else []))


def _no_duplicates(pairs):
    out = {}
    for k, v in pairs:
        if k in out:
            raise ValueError(f"duplicate key {k}")
        out[k] = v
    return out


def _refuse(value):
    raise ValueError(f"{value} is not JSON")


def strict_json(text: str) -> dict:
    """An object from JSON text; duplicate keys, NaN and Infinity, and other roots are errors."""
    out = json.loads(text.removeprefix("\ufeff"), object_pairs_hook=_no_duplicates, parse_constant=_refuse)
    if not isinstance(out, dict):
        raise ValueError("the root is not an object")
    return out


def without_comments(text: str) -> str:
    """Comments become spaces, so lines and columns stay; strings are left alone."""
    blank = lambda m: m[0] if m[0].startswith('"') else re.sub(r"[^\n]", " ", m[0])
    return re.sub(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?(?:\*/|\Z)', blank, text, flags=re.S)


def without_trailing_commas(text: str) -> str:
    return re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m[1] or " ", text)


def relaxed_json(text: str) -> tuple[dict, list[dict]]:
    """(object, duplicates) of descriptor JSON with comments and trailing commas; the last duplicate wins and is reported with its pointer and count."""
    found: list[dict] = []

    def escape(k: str) -> str:
        return k.replace("~", "~0").replace("/", "~1")

    class Pairs(list):
        pass

    raw = json.loads(without_trailing_commas(without_comments(text.removeprefix("\ufeff"))), object_pairs_hook=Pairs)

    def build(v, at):
        if isinstance(v, Pairs):
            count: dict[str, int] = {}
            for k, _ in v:
                count[k] = count.get(k, 0) + 1
            found.extend({"pointer": f"{at}/{escape(k)}", "count": n} for k, n in count.items() if n > 1)
            return {k: build(x, f"{at}/{escape(k)}") for k, x in dict(v).items()}
        if isinstance(v, list):
            return [build(x, f"{at}/{i}") for i, x in enumerate(v)]
        return v

    out = build(raw, "")
    if not isinstance(out, dict):
        raise ValueError("the root is not an object")
    return out, found


_DOC = T.StructType([T.StructField("document", T.StringType()), T.StructField("duplicates", T.ArrayType(T.StructType([T.StructField("pointer", T.StringType()), T.StructField("count", T.IntegerType())]))), T.StructField("error", T.StringType())])


def read_json(df: DataFrame, content: str = "content", relaxed: bool = False) -> DataFrame:
    """``df`` with document (canonical JSON text), duplicates and error; a bad file is a row with an error, not a failed job."""

    def one(b) -> dict:
        try:
            text = bytes(b).decode("utf-8-sig")
            out, twice = relaxed_json(text) if relaxed else (strict_json(text), [])
            return {"document": json.dumps(out, ensure_ascii=False, sort_keys=True), "duplicates": twice, "error": None}
        except (ValueError, UnicodeDecodeError, TypeError) as e:
            return {"document": None, "duplicates": [], "error": str(e)}

    kind = pa.struct([("document", pa.string()), ("duplicates", pa.list_(pa.struct([("pointer", pa.string()), ("count", pa.int32())]))), ("error", pa.string())])

    @F.arrow_udf(_DOC)
    def parse(contents: pa.Array) -> pa.Array:
        return pa.array([one(b) for b in contents.to_pylist()], kind)

    return df.withColumn("json", parse(content)).select(*[c for c in df.columns if c != content], "json.*")


def find_projects(files: DataFrame) -> DataFrame:
    """(status, count, path): resolved with one project file, ambiguous with more, missing with none."""
    p = files.filter(F.endswith(F.lower("path"), F.lit(".uproject")))
    c = p.agg(F.countDistinct(F.lower("path")).alias("count"), F.min("path").alias("path"))
    return c.select(F.when(F.col("count") == 1, "resolved").when(F.col("count") > 1, "ambiguous").otherwise("missing").alias("status"), "count", F.when(F.col("count") == 1, F.col("path")).alias("path"))


def find_build_descriptor(files: DataFrame, module: str | None = None, plugin: str | None = None) -> DataFrame:
    """The rules file of a module or the descriptor of a plugin, by folded name: exactly one of the two is asked for."""
    if (module is None) == (plugin is None):
        raise ValueError("give a module or a plugin")
    want = f"{module}.build.cs".lower() if module else f"{plugin}.uplugin".lower()
    hit = files.filter(F.lower(leaf(F.col("path"))) == want)
    c = hit.agg(F.countDistinct(F.lower("path")).alias("count"), F.min("path").alias("path"))
    code = F.when(F.col("count") == 0, "build-descriptor-not-found").when(F.col("count") > 1, "build-descriptor-ambiguous")
    return c.select(code.alias("code"), "count", F.when(F.col("count") == 1, F.col("path")).alias("path"))


def engine_version(documents: DataFrame) -> DataFrame:
    """(major, minor, patch, branch) of a version file's JSON."""
    get = lambda k: F.get_json_object("document", f"$.{k}")
    return documents.select(*[get(f"{k}Version").cast("int").alias(k.lower()) for k in ("Major", "Minor", "Patch")], get("BranchName").alias("branch"))


def resolve_engine(candidates: DataFrame) -> DataFrame:
    """The first existing engine of (source, path, exists) in the order override, path, registry, ancestor; else not-found."""
    order = F.array_position(F.array(*[F.lit(x) for x in ("override", "path", "registry", "ancestor")]), F.col("source"))
    best = candidates.filter("exists").agg(F.min_by(F.struct("source", "path"), order).alias("b"))
    return best.select(F.when(F.col("b").isNull(), "engine-not-found").otherwise("resolved").alias("status"), "b.*")
