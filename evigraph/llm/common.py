"""Helpers that the training-data operators share: tables, shared storage, array views of text."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the synthetic tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only in a local session that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    import tempfile

    own = f"file://{tempfile.mkdtemp(prefix='evigraph-ckpt-')}"
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


_written: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(df: DataFrame) -> None:
    """Remove the table behind a materialised DataFrame that nothing will read again."""
    for spark, path in [w for w in _written if w[1] == getattr(df, "_written_to", None)]:
        _delete(spark, path)
        _written.remove((spark, path))


def _forget() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone; the folder is scratch space
            pass


atexit.register(_forget)


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and read it back: lineage is cut, every
    executor sees the rows, and a lost executor costs nothing but a reread."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/evigraph/{what}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that results of these names replace, in any case."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])


def give_back() -> None:
    """Hand memory that a task is done with back to the system: workers are used again, and what one stage freed must not count in the next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library; it keeps what it has
        pass


#: Rows of a batch that are turned into Python objects at a time.
ROWS = 128


def over_texts(f: Callable[[pa.Array], pa.Array], kind: str):
    """An Arrow UDF over a string column that sees a few rows at a time, so a batch of long texts never exists twice."""

    @F.arrow_udf(kind)
    def run(col: pa.Array) -> pa.Array:
        if len(col) == 0:
            return f(col)
        parts = [f(col.slice(i, ROWS)) for i in range(0, len(col), ROWS)]
        return pa.concat_arrays(parts)

    return run
