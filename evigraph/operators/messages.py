"""Message operations: classification, channels and export to a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import message_id
from .upsert import union

#: Classes, pins and titles that make a node a message operation.
LISTENER, CALL, BROADCASTER, BROADCAST = "K2Node_AsyncAction_ListenForGameplayMessage", "K2Node_CallFunction", "GameplayMessageSubsystem", "broadcastmessage"
CHANNEL, BROADCAST_PINS = "Channel", ("self", "Channel", "Message")
RELATION = {"publish": "PUBLISHES_EVENT", "subscribe": "SUBSCRIBES_EVENT", "unsubscribe": "UNSUBSCRIBES_EVENT"}


def channel_status(connections: Column, tag: Column) -> Column:
    """dynamic with any connection, even beside a default; static with a tag; else unresolved."""
    return F.when(connections > 0, "dynamic").when(tag.isNotNull() & (tag != ""), "static").otherwise("unresolved")


def classify(node_class: Column, inputs: Column, self_title: Column, type_id: Column) -> Column:
    """What a graph node does, or null: listeners with a channel pin subscribe; calls of the message subsystem's broadcast with all its pins publish.

    ``inputs``: names of input pins; ``self_title``: schema title of the self pin; ``type_id``: parts between bars, the last one names the call.
    """
    called = F.regexp_replace(F.lower(F.substring_index(type_id, "|", -1)), "[^a-z0-9]", "")
    lacking = F.array_except(F.array(*[F.lit(p) for p in BROADCAST_PINS]), inputs)
    return (
        F.when(F.startswith(node_class, F.lit(LISTENER)) & F.array_contains(inputs, CHANNEL), "subscribe")
        .when((node_class == CALL) & (F.size(lacking) == 0) & (self_title == BROADCASTER) & F.startswith(called, F.lit(BROADCAST)), "publish")
    )


def payload_type(operation: Column, pins: Column) -> Column:
    """The payload of an operation, from its pins (map of name to struct<value, title>): the value of the payload pin, else its schema's title."""
    pin = pins[F.when(operation == "subscribe", "PayloadType").otherwise("Message")]
    return F.coalesce(F.nullif(pin["value"], F.lit("")), F.nullif(pin["title"], F.lit("")))


def channel_of(expression: Column, known: Column) -> Column:
    """(status, tag) of a channel expression in code: a literal tag, else a known name (map of name to tag), whole or by its last part."""
    literal = F.nullif(F.regexp_extract(expression, r"\"([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+)\"", 1), F.lit(""))
    name = F.regexp_replace(F.trim(expression), "^[&*]+", "")
    tag = F.coalesce(literal, known[name], known[F.substring_index(name, "::", -1)])
    return F.struct(F.when(tag.isNotNull(), "static").otherwise("unresolved").alias("status"), tag.alias("tag"))


def _leaf(c: Column, sep: str) -> Column:
    return F.substring_index(c, sep, -1)


def export(operations: DataFrame, referencers: DataFrame, project: str = "unknown-project") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, relations, evidence) of message operations and tag referencers (tag, referencer).

    ``operations``: asset, graph, graph_path, node, node_type, node_class, operation, channel_status, tag, payload_type, match_type. An asset contains its graph, the
    graph its node; the node publishes to or subscribes to the tag, or to an expression of its own where no tag is known, and uses the payload's type.
    Nodes and relations are the first of their id (operations come before referencers); evidence is kept by id.
    """
    none = F.lit(None).cast("string")
    nid = lambda kind, key: message_id(kind, F.lit(project), key)
    properties = lambda **kv: F.map_filter(F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v.cast("string"))]), lambda k, v: v.isNotNull())
    o = operations.withColumn("told", F.coalesce(F.col("tag") != "", F.lit(False)))
    channel_kind = F.when(F.col("told"), "gameplay_tag").otherwise("message_channel_expression")
    channel_key = F.when(F.col("told"), F.col("tag")).otherwise(F.concat("node", F.lit("|Channel")))
    channel_id = F.when(F.col("told"), nid("gameplay_tag", channel_key)).otherwise(nid("message_channel_expression", channel_key))
    ids = {"asset": nid("asset", F.col("asset")), "graph": nid("blueprint_graph", F.col("graph_path")), "node": nid("blueprint_node", F.col("node")), "payload": nid("payload_type", F.col("payload_type"))}

    def node(df: DataFrame, kind, key: Column, name: Column, seq: int, props: Column, node_id: Column) -> DataFrame:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return df.select(node_id.alias("node_id"), kind.alias("kind"), name.alias("name"), F.concat_ws("|", F.lit(project), kind, key).alias("canonical_key"), props.alias("properties"), F.lit(seq).alias("seq"))

    paid = o.filter(F.coalesce(F.col("payload_type") != "", F.lit(False)))
    nodes = [
        node(o, "asset", F.col("asset"), _leaf(F.col("asset"), "/"), 0, properties(package=F.col("asset")), ids["asset"]),
        node(o, "blueprint_graph", F.col("graph_path"), F.col("graph"), 0, properties(asset=F.col("asset"), object_path=F.col("graph_path")), ids["graph"]),
        node(o, "blueprint_node", F.col("node"), F.col("node_type"), 0, properties(asset=F.col("asset"), graph=F.col("graph"), object_path=F.col("node"), **{"class": F.col("node_class")}, operation=F.col("operation")), ids["node"]),
        node(o, channel_kind, channel_key, F.when(F.col("told"), F.col("tag")).otherwise("Dynamic Channel"), 0, F.when(F.col("told"), properties(tag=F.col("tag"))).otherwise(properties(status=F.col("channel_status"))), channel_id),
        node(paid, "payload_type", F.col("payload_type"), _leaf(F.col("payload_type"), "."), 0, properties(type=F.col("payload_type")), ids["payload"]),
        node(referencers, "gameplay_tag", F.col("tag"), F.col("tag"), 1, properties(tag=F.col("tag")), nid("gameplay_tag", F.col("tag"))),
        node(referencers, "asset", F.col("referencer"), _leaf(F.col("referencer"), "/"), 1, properties(package=F.col("referencer")), nid("asset", F.col("referencer"))),
    ]

    def relation(df: DataFrame, s: Column, kind: Column, t: Column, seq: int, asset: Column, graph: Column = none, node_: Column = none, certainty: Column | None = None, props: Column | None = None) -> DataFrame:
        cols = {"source_id": s, "kind": kind, "target_id": t, "certainty": certainty if certainty is not None else F.lit("confirmed"), "properties": props if props is not None else F.create_map().cast("map<string,string>"), "asset": asset, "graph": graph, "node": node_, "seq": F.lit(seq)}
        return df.select(*[c.alias(k) for k, c in cols.items()])

    a, g, n = F.col("asset"), F.col("graph"), F.col("node")
    does = F.when(F.col("operation") == "publish", RELATION["publish"]).otherwise(RELATION["subscribe"])
    relations = [
        relation(o, ids["asset"], F.lit("CONTAINS"), ids["graph"], 0, a, g),
        relation(o, ids["graph"], F.lit("CONTAINS"), ids["node"], 0, a, g, n),
        relation(o, ids["node"], does, channel_id, 0, a, g, n, F.when(F.col("told"), "confirmed").otherwise("unresolved"), properties(channel_status=F.col("channel_status"), match_type=F.col("match_type"))),
        relation(paid, ids["node"], F.lit("USES_TYPE"), ids["payload"], 0, a, g, n),
        relation(referencers, nid("asset", F.col("referencer")), F.lit("REFERENCES"), nid("gameplay_tag", F.col("tag")), 1, F.col("referencer"), props=properties(reference_kind=F.lit("searchable_name"))),
    ]
    every = union(relations).withColumn("relation_id", message_id("relation", F.col("source_id"), F.col("kind"), F.col("target_id")))
    first = lambda df, key, cols: df.groupBy(key).agg(F.min_by(F.struct(*cols), F.struct("seq", *[F.to_json(c) if c == "properties" else F.col(c) for c in cols])).alias("r")).select(key, "r.*")
    evidence = every.select(message_id("evidence", F.col("relation_id"), F.col("asset"), F.col("graph"), F.col("node")).alias("evidence_id"), "relation_id", "asset", "graph", "node").distinct()
    return first(union(nodes), "node_id", ["kind", "name", "canonical_key", "properties"]), first(every, "relation_id", ["source_id", "kind", "target_id", "certainty", "properties"]), evidence
