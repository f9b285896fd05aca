"""Fact documents to one logical graph: an adapter for each document schema, and their union.

An adapter returns rows of nodes (kind, key, name, properties map, seq) and relations (source kind and key, kind, target kind and
key, certainty, detail map). Ids, upserts and evidence follow in ``assemble``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import logical_id
from ..functions.text import object_path
from . import messages
from .resolve import deltas_only
from .upsert import first_by, merge_maps, union

DEPENDENCY_RELATION = {"hard_package": "DEPENDS_ON", "soft_package": "SOFT_REFERENCES", "hard_manage": "MANAGES", "soft_manage": "MANAGES", "searchable_name": "REFERENCES"}
NO_MAP = "map<string,string>"


def node(df: DataFrame, kind: str | Column, key: Column, name: Column | None = None, properties: Column | None = None, seq: Column | None = None) -> DataFrame:
    return df.select((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), key.alias("key"), (name if name is not None else key).alias("name"), (properties if properties is not None else F.create_map().cast(NO_MAP)).alias("properties"), (seq if seq is not None else F.lit(0)).cast("long").alias("seq")).filter("key is not null")


def relation(df: DataFrame, sk: str | Column, s: Column, kind: str | Column, tk: str | Column, t: Column, detail: Column | None = None, certainty: Column | None = None) -> DataFrame:
    c = lambda x: F.lit(x) if isinstance(x, str) else x
    none = F.create_map().cast(NO_MAP)
    return df.select(c(sk).alias("sk"), s.alias("s"), c(kind).alias("kind"), c(tk).alias("tk"), t.alias("t"), (certainty if certainty is not None else F.lit("confirmed")).alias("certainty"), (detail if detail is not None else none).alias("detail")).filter("s is not null and t is not null")


#: Kinds of references whose targets are nodes of that kind; others are assets.
REFERRED = ("gameplay_tag", "primary_asset", "object", "class")


def target_kind(kind: Column) -> Column:
    """Type of a reference's target, by the kind of the reference: tag, primary asset, object, class, else the package that holds it."""
    return F.when(kind.isin(*REFERRED), kind).otherwise("asset")


def target_key(kind: Column, target: Column) -> Column:
    """Assets are keyed by their package, the text before the first dot; the others by the whole target."""
    path = object_path(target)
    return F.when(target_kind(kind) == "asset", F.substring_index(path, ".", 1)).otherwise(path)


def target_name(kind: Column, target: Column) -> Column:
    key = target_key(kind, target)
    after = lambda sep: F.substring_index(key, sep, -1)
    return F.when(kind == "gameplay_tag", key).when(kind == "primary_asset", F.regexp_replace(key, "^[^:]*:", "")).when(kind == "object", after(":")).when(kind == "class", after(".")).otherwise(after("/"))


def target_node(df: DataFrame, kind: Column, target: Column) -> DataFrame:
    key = target_key(kind, target)
    field = F.when(kind == "gameplay_tag", "tag").when(kind == "primary_asset", "id").when(kind.isin("object", "class"), "path").otherwise("package")
    return node(df.filter(target.isNotNull()), target_kind(kind), key, target_name(kind, target), F.create_map(field, key))


def leaf(package: Column) -> Column:
    return F.substring_index(package, "/", -1)


def asset_graph(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows: package, class, generated_class, parent_class, dependencies map<kind, array<target>>."""
    a = F.col("package")
    detail = F.create_map(F.lit("asset"), a)
    deps = rows.select("package", F.explode("dependencies").alias("dk", "ts")).select("package", "dk", F.explode("ts").alias("t"))
    known = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in DEPENDENCY_RELATION.items() for x in kv]), F.col("dk")), F.lit("REFERENCES"))
    nodes = [node(rows, "asset", a, leaf(a)), node(rows, "asset_class", F.col("class")), node(rows, "class", F.col("generated_class")), node(rows, "class", F.col("parent_class")), node(deps, "asset", F.col("t"), leaf(F.col("t")))]
    rels = [
        relation(rows, "asset", a, "INSTANCE_OF", "asset_class", F.col("class"), detail),
        relation(rows, "asset", a, "GENERATES_CLASS", "class", F.col("generated_class"), detail),
        relation(rows, "class", F.col("generated_class"), "INHERITS", "class", F.col("parent_class"), detail),
        relation(deps, "asset", a, known, "asset", F.col("t"), F.create_map(F.lit("asset"), a, F.lit("dependency_kind"), F.col("dk"))),
    ]
    return union(nodes), union(rels)


def blueprint(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows: package, generated_class, part, name, parent, implemented.

    Parts: variable, function, event, component (parent: its node; ``class_path``, where there is such a column, its class), graph, node (parent: its graph), interface, base (the
    class that the generated one inherits) and reference (parent: the kind of the reference). Without a generated class the asset stands for it.
    """
    owner = F.coalesce("generated_class", "package")
    own_kind = F.when(F.col("generated_class").isNotNull(), "class").otherwise("asset")
    said = rows.filter(~(F.col("implemented").eqNullSafe(F.lit(False))))
    p = lambda x: said.filter(F.col("part") == x)
    key = F.concat_ws("|", owner, "name")
    call = F.concat_ws("|", owner, "part", "name")
    component = F.concat_ws("|", owner, "name", "parent")
    kinds = {"variable": ("blueprint_variable", key, "DECLARES_VARIABLE"), "function": ("blueprint_function", call, "DECLARES_FUNCTION"), "event": ("blueprint_event", call, "DECLARES_EVENT"), "component": ("blueprint_component", component, "OWNS_COMPONENT"), "interface": ("interface", F.col("name"), "IMPLEMENTS")}
    nodes = [node(rows, "asset", F.col("package"), leaf(F.col("package"))), node(rows, "class", F.col("generated_class"))]
    rels = [relation(rows, "asset", F.col("package"), "GENERATES_CLASS", "class", F.col("generated_class"))]
    for part, (kind, k, rel) in kinds.items():
        nodes.append(node(p(part), kind, k, F.col("name")))
        rels.append(relation(p(part), own_kind, owner, rel, kind, k))
    ref, target = F.col("parent"), F.col("name")
    nodes += [node(p("graph"), "blueprint_graph", F.col("name")), node(p("node"), "blueprint_node", F.col("name")), node(p("base"), "class", F.col("name")), target_node(p("reference"), ref, target)]
    rels += [
        relation(p("base"), own_kind, owner, "INHERITS", "class", F.col("name")),
        relation(p("graph"), "asset", F.col("package"), "CONTAINS", "blueprint_graph", F.col("name")),
        relation(p("node"), "blueprint_graph", F.col("parent"), "CONTAINS", "blueprint_node", F.col("name")),
        relation(p("reference"), "asset", F.col("package"), "REFERENCES", target_kind(ref), target_key(ref, target)),
    ]
    if "class_path" in rows.columns:
        nodes.append(node(p("component"), "class", F.col("class_path")))
        rels.append(relation(p("component"), "blueprint_component", component, "INSTANCE_OF", "class", F.col("class_path")))
    return union(nodes), union(rels)


def data_table(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows: asset, row_struct, name, references array<struct<kind, target>>."""
    key = F.concat_ws("|", "asset", "name")
    refs = rows.select("asset", "name", F.explode("references").alias("r"))
    k, t = F.col("r.kind"), F.col("r.target")
    nodes = [node(rows, "data_table", F.col("asset"), leaf(F.col("asset"))), node(rows, "row_struct", F.col("row_struct")), node(rows, "data_table_row", key, F.col("name")), target_node(refs, k, t)]
    rels = [relation(rows, "data_table", F.col("asset"), "USES_ROW_STRUCT", "row_struct", F.col("row_struct")), relation(rows, "data_table", F.col("asset"), "CONTAINS_ROW", "data_table_row", key), relation(refs, "data_table_row", key, "REFERENCES", target_kind(k), target_key(k, t), F.create_map(F.lit("asset"), F.col("asset"), F.lit("row"), F.col("name")))]
    return union(nodes), union(rels)


def data_asset(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows: asset, asset_class, path, comparison, references; properties that say nothing new are left out."""
    told = deltas_only(rows)
    key = F.concat_ws("|", "asset", "path")
    refs = told.select("asset", "path", F.explode("references").alias("r"))
    k, t = F.col("r.kind"), F.col("r.target")
    nodes = [node(rows, "asset", F.col("asset"), leaf(F.col("asset"))), node(rows, "class", F.col("asset_class")), node(told, "data_asset_property", key, F.col("path"), F.create_map(F.lit("comparison"), F.col("comparison"))), target_node(refs, k, t)]
    rels = [relation(rows, "asset", F.col("asset"), "INSTANCE_OF", "class", F.col("asset_class")), relation(told, "asset", F.col("asset"), "DECLARES_PROPERTY", "data_asset_property", key), relation(refs, "data_asset_property", key, "REFERENCES", target_kind(k), target_key(k, t))]
    return union(nodes), union(rels)


def primary_asset(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows: type, name, object_path, rules, directories array, bundle."""
    key = F.concat_ws(":", "type", "name")
    rule, bundle = F.concat_ws("|", F.lit("type"), "type", "rules"), F.concat_ws("|", key, "bundle")
    dirs = rows.select("type", F.explode("directories").alias("d"))
    ruled, bundled, named = rows.filter("rules is not null"), rows.filter("bundle is not null"), rows.filter("name is not null")
    nodes = [node(rows, "primary_asset_type", F.col("type")), node(named, "primary_asset", key, F.col("name")), node(ruled, "primary_asset_rule", rule), node(dirs, "content_path", F.col("d")), node(bundled, "asset_bundle", bundle), node(named, "asset", F.substring_index("object_path", ".", 1))]
    rels = [relation(ruled, "primary_asset_rule", rule, "APPLIES_TO", "primary_asset_type", F.col("type")), relation(dirs, "primary_asset_type", F.col("type"), "SCANS_PATH", "content_path", F.col("d")), relation(named, "primary_asset", key, "PRIMARY_ASSET_OF_TYPE", "primary_asset_type", F.col("type")), relation(named, "primary_asset", key, "RESOLVES_TO", "asset", F.substring_index("object_path", ".", 1)), relation(bundled, "primary_asset", key, "DECLARES_BUNDLE", "asset_bundle", bundle)]
    return union(nodes), union(rels)


def config(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows: file, line, section, key, operator, value, references; each declaration overrides the one before it of its section and key."""
    from pyspark.sql import Window

    sec, key, dec = F.concat_ws("|", "file", "section"), F.concat_ws("|", "section", "key"), F.concat_ws("|", "file", F.col("line").cast("string"), "section", "key")
    rows = rows.withColumn("prev", F.lag(dec).over(Window.partitionBy("section", "key").orderBy("file", "line")))
    place = F.create_map(F.lit("path"), F.col("file"), F.lit("line"), F.col("line").cast("string"))
    refs = rows.select("file", "line", "section", "key", F.explode("references").alias("r"))
    k, t = F.col("r.kind"), F.col("r.target")
    rel = F.when(k == "gameplay_tag", "DECLARES_TAG").when(k == "class", "SELECTS_CLASS").otherwise("REFERENCES")
    nodes = [node(rows, "config_file", F.col("file"), leaf(F.col("file"))), node(rows, "config_section", sec, F.col("section")), node(rows, "config_key", key, F.col("key")), node(rows, "config_declaration", dec, F.col("key"), F.create_map(F.lit("operator"), F.col("operator"), F.lit("value"), F.col("value"))), target_node(refs, k, t)]
    rels = [relation(rows, "config_file", F.col("file"), "DECLARES", "config_section", sec, place), relation(rows, "config_section", sec, "DECLARES", "config_declaration", dec, place), relation(rows, "config_declaration", dec, "CONFIGURES", "config_key", key, place), relation(rows, "config_declaration", dec, "OVERRIDES", "config_declaration", F.col("prev"), place), relation(refs, "config_declaration", dec, rel, target_kind(k), target_key(k, t), place)]
    return union(nodes), union(rels)


def cxx_messages(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows: operation, path, function, line, status, tag, expression, payload_type."""
    fn = F.concat_ws("|", "path", "function")
    static = F.col("status") == "static"
    chan = F.when(static, F.col("tag")).otherwise(F.concat_ws("|", F.concat_ws(":", "path", F.col("line").cast("string")), "expression"))
    ck = F.when(static, "gameplay_tag").otherwise("message_channel_expression")
    rel = F.when(F.col("operation") == "publish", "PUBLISHES_EVENT").when(F.col("operation") == "subscribe", "SUBSCRIBES_EVENT").otherwise("UNSUBSCRIBES_EVENT")
    place = F.create_map(F.lit("path"), F.col("path"), F.lit("line"), F.col("line").cast("string"))
    nodes = [node(rows, "cxx_function", fn, F.col("function")), node(rows, ck, chan), node(rows, "payload_type", F.col("payload_type"))]
    certainty = F.when(static, "confirmed").otherwise("unresolved")
    return union(nodes), union([relation(rows, "cxx_function", fn, rel, ck, chan, place, certainty), relation(rows, "cxx_function", fn, "USES_TYPE", "payload_type", F.col("payload_type"), place)])


def graph_import(tables: tuple[DataFrame, DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """A graph made elsewhere: (nodes, relations, evidence) with ids of its own.

    ``nodes``: node_id, kind, name, canonical_key, properties; ``relations``: relation_id, source_id, kind, target_id, certainty; ``evidence``: relation_id and any
    details. A node's key here is the first of its properties package, tag, object_path and type, else its canonical key, name or id. A relation without
    evidence has one empty row.
    """
    n, r, e = tables
    own = F.coalesce(*[F.nullif(F.col("properties")[k], F.lit("")) for k in ("package", "tag", "object_path", "type")], F.nullif("canonical_key", F.lit("")), F.nullif("name", F.lit("")), F.col("node_id"))
    keyed = n.select("node_id", "kind", own.alias("key"), F.coalesce("name", own).alias("name"), "properties")
    at = lambda p: keyed.select(F.col("node_id").alias(f"{p}_id"), F.col("kind").alias(f"{p}_kind"), F.col("key").alias(f"{p}_key"))
    details = [c for c in e.columns if c not in ("evidence_id", "relation_id")]
    detail = F.map_filter(F.create_map(*[x for c in details for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]), lambda k, v: v.isNotNull()) if details else F.create_map().cast(NO_MAP)
    told = r.join(e.select("relation_id", detail.alias("detail")), "relation_id", "left").withColumn("detail", F.coalesce("detail", F.create_map().cast(NO_MAP)))
    bound = told.join(at("source"), "source_id").join(at("target"), "target_id")
    nodes = node(keyed, F.col("kind"), F.col("key"), F.col("name"), F.col("properties"))
    return nodes, relation(bound, F.col("source_kind"), F.col("source_key"), F.col("kind"), F.col("target_kind"), F.col("target_key"), F.col("detail"), F.col("certainty"))


def message_scan(tables: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(operations, referencers) as ``messages.export`` takes them: exported first, then imported."""
    return graph_import(messages.export(*tables))


#: Adapter of each document schema. Those of a message scan and of a graph take a tuple of tables, the others one table.
ADAPTERS: dict[str, Callable] = {
    "asset-graph": asset_graph,
    "blueprint-structure": blueprint,
    "data-table": data_table,
    "data-asset": data_asset,
    "primary-asset": primary_asset,
    "config-graph": config,
    "cxx-messages": cxx_messages,
    "message-scan": message_scan,
    "message-graph": graph_import,
}


def assemble(nodes: DataFrame, relations: DataFrame, project: str, producer: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Node, relation and evidence tables with ids: the first name and certainty win, properties that say something override, evidence is a set.

    The order is that of column ``doc``, if there is one, then of ``seq``; of equal places the least name counts. The producer is ``producer`` or, with ``doc``, a column.
    """
    slashed = lambda c: F.replace(c, F.lit("\\"), F.lit("/"))
    key = lambda kind, k: F.concat_ws("|", F.lit(project.replace("\\", "/")), kind, slashed(k))
    nid = lambda kind, k: logical_id("node", key(kind, k))
    one = lambda d: d if "doc" in d.columns else d.withColumns({"doc": F.lit(0), "producer": F.lit(producer)})
    n = one(nodes).withColumn("node_id", nid(F.col("kind"), F.col("key"))).withColumn("canonical_key", key(F.col("kind"), F.col("key"))).withColumn("at", F.struct("doc", "seq"))
    heads = n.groupBy("node_id").agg(F.min("kind").alias("kind"), F.min("canonical_key").alias("canonical_key"), first_by("name", F.struct("at", "name")).alias("name"))
    props = merge_maps(n.select("node_id", "at", "properties"), seq="at", nulls_override=False)
    table = heads.join(props, "node_id", "left").withColumn("properties", F.coalesce("properties", F.create_map().cast(NO_MAP)))
    r = one(relations).select("doc", "producer", nid(F.col("sk"), F.col("s")).alias("source_id"), "kind", nid(F.col("tk"), F.col("t")).alias("target_id"), "certainty", "detail")
    r = r.withColumn("relation_id", logical_id("relation", F.col("source_id"), F.col("kind"), F.col("target_id")))
    rels = r.groupBy("relation_id", "source_id", "kind", "target_id").agg(first_by("certainty", F.struct("doc", "certainty")).alias("certainty"))
    text = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("detail"))))
    ev = r.select("relation_id", "producer", text.alias("detail")).distinct()
    return table, rels, ev.withColumn("evidence_id", logical_id("evidence", F.col("relation_id"), F.col("producer"), F.col("detail")))


def build(documents: dict[str, DataFrame | tuple], project: str, projects: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame, list[dict]]:
    """One graph from fact tables by schema, in their order. Documents of several projects are refused; unknown schemas are warnings."""
    if projects is not None and len({p.replace("\\", "/").lower() for p in projects}) > 1:
        raise ValueError("project-identity-mismatch")
    problems, nodes, relations = [], [], []
    for i, (schema, rows) in enumerate(documents.items()):
        if schema not in ADAPTERS:
            problems.append({"severity": "warning", "code": "unsupported-input-schema", "subject": schema})
            continue
        n, r = (d.withColumns({"doc": F.lit(i), "producer": F.lit(schema)}) for d in ADAPTERS[schema](rows))
        nodes.append(n)
        relations.append(r)
    if not nodes:
        raise ValueError("no document that an adapter takes")
    return (*assemble(union(nodes), union(relations), project), problems)
