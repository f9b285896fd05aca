"""Graphs, declarations, files and snapshots read from the driver's tables, and the same as SQL.

``CTE`` holds the SQL of each adapter; a query's SQL starts with the ones that it needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import file_id


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def node_id(kind: str, key) -> object:
    return file_id("node", F.lit(kind), key)


_TABLES = (("region", "region", "r_regionkey", "r_name"), ("nation", "nation", "n_nationkey", "n_name"), ("customer", "customer", "c_custkey", "c_name"), ("supplier", "supplier", "s_suppkey", "s_name"), ("part", "part", "p_partkey", "p_name"))


def pg_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """node_id, kind, name, path: one node per key of six tables."""
    out = None
    for kind, t, key, name in (*_TABLES, ("order", "orders", "o_orderkey", None)):
        k = F.col(key).cast("string")
        n = F.col(name) if name else F.concat(F.lit("Order#"), k)
        part = read(spark, sf, t).select(node_id(kind, k).alias("node_id"), F.lit(kind).alias("kind"), n.alias("name"), F.concat(F.lit(f"{kind}/"), k).alias("path"))
        out = part if out is None else out.unionByName(part)
    return out


def pg_links(spark: SparkSession, sf: str) -> DataFrame:
    """kind, source kind and key, target kind and key of each foreign key, once."""
    li = read(spark, sf, "lineitem")

    def link(df, kind, sk, s, tk, t):
        return df.select(F.lit(kind).alias("kind"), F.lit(sk).alias("sk"), F.col(s).cast("string").alias("s"), F.lit(tk).alias("tk"), F.col(t).cast("string").alias("t"))

    parts = [
        link(read(spark, sf, "nation"), "IN_REGION", "nation", "n_nationkey", "region", "n_regionkey"),
        link(read(spark, sf, "customer"), "IN_NATION", "customer", "c_custkey", "nation", "c_nationkey"),
        link(read(spark, sf, "supplier"), "IN_NATION", "supplier", "s_suppkey", "nation", "s_nationkey"),
        link(read(spark, sf, "orders"), "ORDERED_BY", "order", "o_orderkey", "customer", "o_custkey"),
        link(li.select("l_orderkey", "l_partkey").distinct(), "CONTAINS", "order", "l_orderkey", "part", "l_partkey"),
        link(li.select("l_partkey", "l_suppkey").distinct(), "SUPPLIED_BY", "part", "l_partkey", "supplier", "l_suppkey"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def pg_edges(spark: SparkSession, sf: str) -> DataFrame:
    """edge_id, kind, source_id, target_id."""
    x = pg_links(spark, sf)
    s, t = file_id("node", F.col("sk"), F.col("s")), file_id("node", F.col("tk"), F.col("t"))
    return x.select(file_id("edge", F.col("kind"), F.col("sk"), F.col("s"), F.col("tk"), F.col("t")).alias("edge_id"), "kind", s.alias("source_id"), t.alias("target_id"))


def pg_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """evidence_id, edge_id, path, line: one row for each distinct place of a lineitem."""
    c = lambda x: F.col(x).cast("string")
    places = read(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").distinct()
    return places.select(
        file_id("evidence", c("l_orderkey"), c("l_partkey"), c("l_suppkey"), c("l_linenumber")).alias("evidence_id"),
        file_id("edge", F.lit("CONTAINS"), F.lit("order"), c("l_orderkey"), F.lit("part"), c("l_partkey")).alias("edge_id"),
        F.concat(F.lit("order/"), c("l_orderkey")).alias("path"),
        F.col("l_linenumber").alias("line"),
    )


def ring(spark: SparkSession, sf: str) -> DataFrame:
    """(src, dst): customer k to k + 7 inside its block of ten, round it; every tenth block passes on to the next one, so nodes have one way out or two."""
    k = read(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    base, last = F.col("k") - F.col("k") % 10, F.col("k") % 10
    round_ = k.select(F.col("k").alias("s"), (base + (last + 7) % 10).alias("t"))
    on = k.filter("k % 100 = 5").select(F.col("k").alias("s"), (F.col("k") + 10).alias("t"))
    e = round_.unionByName(on).filter("s <> t").join(k.withColumnRenamed("k", "t"), "t", "left_semi")
    name = lambda c: F.concat(F.lit("c"), F.lpad(F.col(c).cast("string"), 12, "0"))
    return e.select(name("s").alias("src"), name("t").alias("dst"))


def tree(spark: SparkSession, sf: str) -> DataFrame:
    """(name, base): customer k below k div 10."""
    k = read(spark, sf, "customer").filter("c_custkey > 0")
    return k.select(F.col("c_custkey").alias("name"), F.floor(F.col("c_custkey") / 10).cast("long").alias("base"))


def declarations(spark: SparkSession, sf: str) -> DataFrame:
    """section, key, seq, operator, value from events."""
    r = F.col("event_id") % 50
    op = F.when(r == 0, "!").when(r == 1, "set").when(r <= 11, "-").when(r <= 20, ".").otherwise("+")
    return read(spark, sf, "events").select(F.col("event_type").alias("section"), (F.col("user_id") % 20).alias("key"), F.col("event_id").alias("seq"), op.alias("operator"), (F.col("event_id") % 7).cast("string").alias("value"))


def snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(canonical_key, properties) of orders before and after."""
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus", "o_custkey")
    key = F.concat(F.lit("p|order|"), F.col("k").cast("string")).alias("canonical_key")
    old = o.filter("k % 10 <> 0").select(key, F.col("o_orderstatus").alias("properties"), "o_custkey")
    new = o.filter("k % 11 <> 0").select(key, F.when(F.col("k") % 13 == 0, F.concat(F.lit("X"), "o_orderstatus")).otherwise(F.col("o_orderstatus")).alias("properties"), "o_custkey")
    return old, new


def url_paths(spark: SparkSession, sf: str) -> DataFrame:
    """page_id and the url's host and path without scheme, query and fragment."""
    return read(spark, sf, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("path"))


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, line (from 1), text."""
    d = read(spark, sf, "documents").filter("doc_id is not null")
    return d.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("p", "text")).select("doc_id", (F.col("p") + 1).alias("line"), "text")


_ID = "'node:' || substr(sha256({k} || chr(0) || {c}), 1, 24)"


def _nid(kind: str, col: str) -> str:
    return _ID.format(k=kind, c=f"CAST({col} AS VARCHAR)")


_EID = "'edge:' || substr(sha256(kind || chr(0) || sk || chr(0) || s || chr(0) || tk || chr(0) || t), 1, 24)"
CTE = {
    "nodes": "nodes AS ("
    + " UNION ALL ".join(f"SELECT {_nid(repr(k), c)} AS node_id, '{k}' AS kind, {n} AS name, '{k}/' || {c} AS path FROM {t}" for k, t, c, n in (*_TABLES, ("order", "orders", "o_orderkey", "'Order#' || o_orderkey")))
    + ")",
    "links": """links AS (
 SELECT 'IN_REGION' AS kind, 'nation' AS sk, CAST(n_nationkey AS VARCHAR) AS s, 'region' AS tk, CAST(n_regionkey AS VARCHAR) AS t FROM nation
 UNION ALL SELECT 'IN_NATION', 'customer', CAST(c_custkey AS VARCHAR), 'nation', CAST(c_nationkey AS VARCHAR) FROM customer
 UNION ALL SELECT 'IN_NATION', 'supplier', CAST(s_suppkey AS VARCHAR), 'nation', CAST(s_nationkey AS VARCHAR) FROM supplier
 UNION ALL SELECT 'ORDERED_BY', 'order', CAST(o_orderkey AS VARCHAR), 'customer', CAST(o_custkey AS VARCHAR) FROM orders
 UNION ALL SELECT DISTINCT 'CONTAINS', 'order', CAST(l_orderkey AS VARCHAR), 'part', CAST(l_partkey AS VARCHAR) FROM lineitem
 UNION ALL SELECT DISTINCT 'SUPPLIED_BY', 'part', CAST(l_partkey AS VARCHAR), 'supplier', CAST(l_suppkey AS VARCHAR) FROM lineitem)""",
    "edges": f"edges AS (SELECT {_EID} AS edge_id, kind, {_ID.format(k='sk', c='s')} AS source_id, {_ID.format(k='tk', c='t')} AS target_id FROM links)",
    "evidence": """evidence AS (SELECT DISTINCT 'evidence:' || substr(sha256(l_orderkey || chr(0) || l_partkey || chr(0) || l_suppkey || chr(0) || l_linenumber), 1, 24) AS evidence_id,
 'edge:' || substr(sha256('CONTAINS' || chr(0) || 'order' || chr(0) || l_orderkey || chr(0) || 'part' || chr(0) || l_partkey), 1, 24) AS edge_id,
 'order/' || l_orderkey AS path, l_linenumber AS line FROM lineitem)""",
    "ring": """k AS (SELECT c_custkey AS k FROM customer), l AS (SELECT k AS s, k - k % 10 + (k % 10 + 7) % 10 AS t FROM k UNION ALL SELECT k, k + 10 FROM k WHERE k % 100 = 5),
ring AS (SELECT 'c' || lpad(CAST(s AS VARCHAR), 12, '0') AS src, 'c' || lpad(CAST(t AS VARCHAR), 12, '0') AS dst FROM l WHERE s <> t AND t IN (SELECT k FROM k))""",
    "tree": "tree AS (SELECT c_custkey AS name, CAST(floor(c_custkey / 10) AS BIGINT) AS base FROM customer WHERE c_custkey > 0)",
    "decl": """decl AS (SELECT event_type AS section, user_id % 20 AS key, event_id AS seq, CASE WHEN event_id % 50 = 0 THEN '!' WHEN event_id % 50 = 1 THEN 'set' WHEN event_id % 50 <= 11 THEN '-' WHEN event_id % 50 <= 20 THEN '.' ELSE '+' END AS operator, CAST(event_id % 7 AS VARCHAR) AS value FROM events)""",
    "old": "old AS (SELECT 'p|order|' || o_orderkey AS canonical_key, o_orderstatus AS properties, o_custkey FROM orders WHERE o_orderkey % 10 <> 0)",
    "new": "new AS (SELECT 'p|order|' || o_orderkey AS canonical_key, CASE WHEN o_orderkey % 13 = 0 THEN 'X' || o_orderstatus ELSE o_orderstatus END AS properties, o_custkey FROM orders WHERE o_orderkey % 11 <> 0)",
    "paths": "paths AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages)",
    "lines": "lines AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS line, unnest(x) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))",
}


def sql(body: str, *parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(CTE[p] for p in parts)} {body}"
