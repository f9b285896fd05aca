"""Content-addressed identities, canonical JSON and folded keys as columns."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def file_id(prefix: str, *parts: Column) -> Column:
    """``prefix:`` and 24 hex digits of the SHA-256 of the parts joined by NUL; null parts count as empty."""
    joined = F.concat_ws("\0", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(f"{prefix}:"), F.substring(F.sha2(joined, 256), 1, 24))


def json_string(c: Column) -> Column:
    """A JSON string literal with lower-case escapes, as Python's json writes without ASCII escaping."""
    out = F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit('"'), F.lit('\\"'))
    named = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}
    odd = {i: named.get(i, f"\\u{i:04x}") for i in range(32)}
    fixed = out
    for code, text in odd.items():
        fixed = F.replace(fixed, F.lit(chr(code)), F.lit(text))
    return F.concat(F.lit('"'), F.when(out.rlike("[\\x00-\\x1f]"), fixed).otherwise(out), F.lit('"'))


def json_array(*parts: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *[F.coalesce(json_string(p), F.lit("null")) for p in parts]), F.lit("]"))


def logical_id(kind: str | Column, *parts: Column, digits: int = 32) -> Column:
    """``kind:`` and 32 hex digits of the SHA-256 of the compact JSON array of the parts."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat(kind, F.lit(":"), F.substring(F.sha2(json_array(*parts), 256), 1, digits))


def message_id(kind: str, *parts: Column) -> Column:
    """``kind:`` and the whole SHA-256 of the compact JSON array of the kind and the parts."""
    return F.concat(F.lit(f"{kind}:"), F.sha2(json_array(F.lit(kind), *parts), 256))


def per_text(f):
    """An Arrow UDF of a function over texts; null stays null."""

    @F.arrow_udf(T.StringType())
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if x is None else f(x) for x in texts.to_pylist()], pa.string())

    return run


#: Nested JSON with sorted keys, compact, non-ASCII kept.
canonical_json = per_text(lambda x: json.dumps(json.loads(x), ensure_ascii=False, sort_keys=True, separators=(",", ":")))


def fold(c: Column) -> Column:
    """Key for case-insensitive matching."""
    return F.lower(c)


#: Unicode case folding, for names where lower-casing is not enough.
full_fold = per_text(str.casefold)
