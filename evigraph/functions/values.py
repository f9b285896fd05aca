"""Nested values: field paths, tagged unions and references inside them."""

from __future__ import annotations

import json
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text
from .ids import per_text


def walk(value, path: str = "$"):
    """(path, leaf) of a JSON value in order; dotted for fields, indexed for items."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from walk(v, f"{path}.{k}")
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from walk(v, f"{path}[{i}]")
    elif value is not None:
        yield path, value


def field_paths(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, field, value) of every leaf of a JSON text column; flat objects of scalars stay in the JVM as maps, nested ones are walked by batch."""
    flat = df.filter(~F.coalesce(F.col(column), F.lit("{}")).rlike(r"[\[]|\{.*\{"))
    one = flat.select(key, F.explode(F.from_json(column, "map<string,string>")).alias("k", "value")).filter("value is not null")
    out = one.select(key, F.concat(F.lit("$."), F.col("k")).alias("field"), "value")

    @F.pandas_udf("array<struct<field:string,value:string>>")
    def leaves(texts):
        return texts.map(lambda t: [{"field": p, "value": v if isinstance(v, str) else json.dumps(v)} for p, v in walk(json.loads(t))])

    deep = df.filter(F.coalesce(F.col(column), F.lit("{}")).rlike(r"[\[]|\{.*\{"))
    return out.unionByName(deep.select(key, F.explode(leaves(column)).alias("x")).select(key, "x.*"))


def tagged(value, depth: int = 8, items: int = 1000, _seen: tuple = ()) -> dict:
    """A Python value as a tagged union; booleans come before integers, depth and item limits are marked, cycles are cut."""
    if value is None:
        return {"kind": "null"}
    if isinstance(value, bool):
        return {"kind": "boolean", "value": value}
    if isinstance(value, int):
        return {"kind": "integer", "value": value}
    if isinstance(value, float):
        return {"kind": "number", "value": value} if math.isfinite(value) else {"kind": "text", "value": str(value)}
    if isinstance(value, str):
        return {"kind": "string", "value": value}
    if isinstance(value, (bytes, bytearray)):
        cut = bytes(value[:items])
        return {"kind": "bytes", "value": cut.hex(), "truncated_count": len(value) - len(cut)}
    if id(value) in _seen:
        return {"kind": "cycle"}
    if depth <= 0:
        return {"kind": "truncated"}
    deeper = (*_seen, id(value))
    if isinstance(value, dict):
        pairs = list(value.items())
        kept = [{"key": tagged(k, depth - 1, items, deeper), "value": tagged(v, depth - 1, items, deeper)} for k, v in pairs[:items]]
        return {"kind": "map", "entries": kept, "truncated_count": len(pairs) - len(kept)}
    if isinstance(value, (list, tuple, set)):
        every = sorted(value, key=repr) if isinstance(value, set) else list(value)
        kept = [tagged(v, depth - 1, items, deeper) for v in every[:items]]
        return {"kind": "array", "items": kept, "truncated_count": len(every) - len(kept)}
    return {"kind": "text", "value": str(value)}


#: JSON text to the JSON of its tagged union.
tag_json = per_text(lambda x: json.dumps(tagged(json.loads(x)), sort_keys=True, separators=(",", ":")))


_PATH, _TAG = re.compile(text.OBJECT_PATH), re.compile(text.TAG)


def string_references(value: str) -> set[tuple[str, str]]:
    """(kind, target) of the references in a string, as ``text.references`` finds them."""
    found = set()
    for wrapper, path in _PATH.findall(value):
        path = path.strip().strip("\"'").replace("\\", "/")
        found.add(("class" if path.startswith("/Script/") or wrapper.endswith("Class") else "asset", path))
    return found | {("gameplay_tag", t.strip()) for t in _TAG.findall(value) if t.strip()}


def _below(path: str, field: str) -> str:
    return f"{path}.{field}" if path else field


def _strings(value, path: str = ""):
    """(path, text) of the strings in a nested value."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from _strings(v, _below(path, str(k)))
    elif isinstance(value, (list, tuple)):
        for i, v in enumerate(value):
            yield from _strings(v, f"{path}[{i}]")
    elif isinstance(value, str):
        yield path, value


def value_references(value) -> list[tuple[str, str, str]]:
    """Sorted distinct (kind, target, field) of the references inside a nested value."""
    return sorted({(*r, path) for path, leaf in _strings(value) for r in string_references(leaf)})


def typed_references(value) -> list[tuple[str, str, str]]:
    """References of a tagged value: those of its strings, those that its kinds tell, and objects inside an asset instead of the asset."""
    found = set(value_references(value))

    def visit(item, path: str) -> None:
        if isinstance(item, dict):
            kind = item.get("kind")
            if kind == "object" and ":" in str(item.get("path") or ""):
                at = _below(path, "path")
                found.discard(("asset", str(item["path"]), at))
                found.add(("object", str(item["path"]), at))
            elif kind == "gameplay_tag" and item.get("tag"):
                found.add(("gameplay_tag", str(item["tag"]), path))
            elif kind == "gameplay_tag_container":
                found.update(("gameplay_tag", str(t), f"{_below(path, 'tags')}[{i}]") for i, t in enumerate(item.get("tags", [])))
            elif kind == "primary_asset_id" and item.get("id"):
                found.add(("primary_asset", str(item["id"]), path))
            for k, v in item.items():
                visit(v, _below(path, str(k)))
        elif isinstance(item, list):
            for i, v in enumerate(item):
                visit(v, f"{path}[{i}]")

    visit(value, "")
    return sorted(found)


_REFERENCE = T.ArrayType(T.StructType([T.StructField(k, T.StringType()) for k in ("kind", "target", "field")]))


def _over_json(f):
    """An Arrow UDF that gives (kind, target, field) rows for JSON texts; nested values have no built-in walk."""
    kind = pa.list_(pa.struct([(k, pa.string()) for k in ("kind", "target", "field")]))

    @F.arrow_udf(_REFERENCE)
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([[] if t is None else [dict(zip(("kind", "target", "field"), r)) for r in f(json.loads(t))] for t in texts.to_pylist()], kind)

    return run


json_references = _over_json(value_references)
json_typed_references = _over_json(typed_references)
