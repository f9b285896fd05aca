"""Graph queries on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import closure, cycles, graph, integrity, upsert
from . import adapters as a

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _c(x: str, kind: str = "BIGINT") -> str:
    return f"CAST({x} AS {kind})"


@query(a.sql("SELECT * FROM nodes", "nodes"))
def pg_nodes(spark, sf):
    return a.pg_nodes(spark, sf)


@query(a.sql("SELECT * FROM edges", "links", "edges"))
def pg_edges(spark, sf):
    return a.pg_edges(spark, sf)


@query(a.sql("SELECT * FROM evidence", "evidence"))
def pg_evidence(spark, sf):
    return a.pg_evidence(spark, sf)


@query(
    a.sql(
        """SELECT node_id, kind, name, path, (SELECT count(*) FROM edges e WHERE e.source_id = n.node_id) AS out_degree, (SELECT count(*) FROM edges e WHERE e.target_id = n.node_id) AS in_degree FROM nodes n""",
        "nodes",
        "links",
        "edges",
    )
)
def degree(spark, sf):
    return graph.degrees(a.pg_nodes(spark, sf), a.pg_edges(spark, sf))


@query(a.sql("SELECT 'nodes' AS what, count(*) AS count FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'evidence', count(*) FROM evidence", "nodes", "links", "edges", "evidence"))
def graph_summary(spark, sf):
    return graph.totals(nodes=a.pg_nodes(spark, sf), edges=a.pg_edges(spark, sf), evidence=a.pg_evidence(spark, sf))


@query(a.sql("SELECT kind, count(*) AS count FROM nodes GROUP BY 1", "nodes"))
def kind_histogram(spark, sf):
    return graph.kind_histogram(a.pg_nodes(spark, sf))


_SEARCH = "supplier#00000001"


@query(a.sql(f"SELECT * FROM nodes WHERE contains(lower(name), '{_SEARCH}') OR contains(lower(path), '{_SEARCH}') ORDER BY CASE WHEN lower(name) = '{_SEARCH}' THEN 0 ELSE 1 END, kind, lower(name), node_id LIMIT 30", "nodes"))
def search_topk(spark, sf):
    return graph.search(a.pg_nodes(spark, sf), _SEARCH)


@query(a.sql("SELECT * FROM nodes WHERE kind = 'order' ORDER BY path, node_id LIMIT 1", "nodes"))
def root_node(spark, sf):
    return graph.root_node(a.pg_nodes(spark, sf), "order")


@query(a.sql("SELECT e.* FROM edges e JOIN nodes s ON s.node_id = source_id JOIN nodes t ON t.node_id = target_id WHERE s.kind NOT IN ('order', 'region') AND t.kind NOT IN ('order', 'region')", "nodes", "links", "edges"))
def hide_kinds(spark, sf):
    return graph.hide_kinds(a.pg_nodes(spark, sf), a.pg_edges(spark, sf), ["order", "region"])[1]


@query(
    a.sql(
        "SELECT e.edge_id, count(evidence_id) AS n, coalesce(string_agg(lower(v.path) || ':' || v.line || ':' || v.evidence_id, ';' ORDER BY lower(v.path), v.line, v.path, v.evidence_id), '') AS evidence FROM edges e LEFT JOIN evidence v USING (edge_id) WHERE e.kind IN ('CONTAINS', 'SUPPLIED_BY') GROUP BY 1",
        "links",
        "edges",
        "evidence",
    )
)
def edge_evidence(spark, sf):
    e = a.pg_edges(spark, sf).filter("kind in ('CONTAINS', 'SUPPLIED_BY')")
    out = graph.attach_evidence(e, a.pg_evidence(spark, sf))
    text = F.array_join(F.transform("evidence", lambda x: F.concat_ws(":", x["order"], x["line"].cast("string"), x["evidence_id"])), ";")
    return out.select("edge_id", F.size("evidence").cast("long").alias("n"), text.alias("evidence"))


@query(
    a.sql(
        f"SELECT e.*, CASE WHEN source_id = {a._nid(repr('nation'), '7')} THEN 'outgoing' ELSE 'incoming' END AS direction FROM edges e WHERE {a._nid(repr('nation'), '7')} IN (source_id, target_id)",
        "links",
        "edges",
    )
)
def node_relations(spark, sf):
    return graph.node_relations(a.pg_edges(spark, sf), a.node_id("nation", F.lit("7")))


# --- traversal: the place graph (customers, suppliers, nations, regions) -------------------------

_PLACE = "places AS (SELECT sk || '|' || s AS src, tk || '|' || t AS dst, kind FROM links WHERE tk IN ('nation', 'region'))"


def _places(spark, sf):
    x = a.pg_links(spark, sf).filter("tk in ('nation', 'region')")
    return x.select(F.concat_ws("|", "sk", "s").alias("src"), F.concat_ws("|", "tk", "t").alias("dst"))


@query(
    a.sql(
        f", {_PLACE}, r(node, depth) AS (SELECT 'region|1', 0 UNION SELECT p.src, r.depth + 1 FROM r JOIN places p ON p.dst = r.node WHERE r.depth < 3) SELECT node, min(depth) AS depth FROM r GROUP BY 1 HAVING min(depth) > 0",
        "links",
        recursive=True,
    )
)
def impact(spark, sf):
    return closure.impact(_places(spark, sf), "region|1", 3)


@query(
    a.sql(
        f", {_PLACE}, both_ AS (SELECT src, dst FROM places UNION SELECT dst, src FROM places), r(node, depth) AS (SELECT 'nation|3', 0 UNION SELECT b.dst, r.depth + 1 FROM r JOIN both_ b ON b.src = r.node WHERE r.depth < 2) SELECT node, min(depth) AS depth FROM r GROUP BY 1",
        "links",
        recursive=True,
    )
)
def neighbourhood(spark, sf):
    seed = spark.createDataFrame([("nation|3",)], "node string")
    return closure.reach(closure.both_ways(_places(spark, sf)), seed, 2)


_CAPPED = f""", pe AS (SELECT * FROM edges WHERE kind IN ('IN_NATION', 'IN_REGION')), both_ AS (SELECT kind, edge_id, source_id AS x, target_id AS y FROM pe UNION ALL SELECT kind, edge_id, target_id, source_id FROM pe),
l0 AS (SELECT node_id AS n, 0 AS d FROM nodes WHERE node_id = {a._nid(repr('nation'), '3')}),
m1 AS (SELECT y AS n, min(kind || '|' || edge_id) AS o FROM both_ WHERE x IN (SELECT n FROM l0) AND y NOT IN (SELECT n FROM l0) GROUP BY 1),
l1 AS (SELECT n, 1 AS d FROM (SELECT *, row_number() OVER (ORDER BY o) AS r FROM m1) WHERE r <= 40 - (SELECT count(*) FROM l0)), s1 AS (SELECT * FROM l0 UNION ALL SELECT * FROM l1),
m2 AS (SELECT y AS n, min(kind || '|' || edge_id) AS o FROM both_ WHERE x IN (SELECT n FROM l1) AND y NOT IN (SELECT n FROM s1) GROUP BY 1),
l2 AS (SELECT n, 2 AS d FROM (SELECT *, row_number() OVER (ORDER BY o) AS r FROM m2) WHERE r <= 40 - (SELECT count(*) FROM s1)), s2 AS (SELECT * FROM s1 UNION ALL SELECT * FROM l2),
m3 AS (SELECT y AS n, min(kind || '|' || edge_id) AS o FROM both_ WHERE x IN (SELECT n FROM l2) AND y NOT IN (SELECT n FROM s2) GROUP BY 1),
l3 AS (SELECT n, 3 AS d FROM (SELECT *, row_number() OVER (ORDER BY o) AS r FROM m3) WHERE r <= 40 - (SELECT count(*) FROM s2)), s3 AS (SELECT * FROM s2 UNION ALL SELECT * FROM l3)"""


@query(a.sql(f"{_CAPPED} SELECT nodes.*, d AS distance FROM nodes JOIN s3 ON n = node_id", "nodes", "links", "edges"))
def neighbourhood_capped(spark, sf):
    center = spark.range(1).select(a.node_id("nation", F.lit("3"))).first()[0]
    return closure.neighbourhood(a.pg_nodes(spark, sf), a.pg_edges(spark, sf).filter("kind in ('IN_NATION', 'IN_REGION')"), center, 3, 40)[0]


@query(a.sql(f"{_CAPPED} SELECT pe.* FROM pe WHERE source_id IN (SELECT n FROM s3) AND target_id IN (SELECT n FROM s3) AND (source_id IN (SELECT n FROM s2) OR target_id IN (SELECT n FROM s2))", "nodes", "links", "edges"))
def neighbourhood_edges(spark, sf):
    center = spark.range(1).select(a.node_id("nation", F.lit("3"))).first()[0]
    return closure.neighbourhood(a.pg_nodes(spark, sf), a.pg_edges(spark, sf).filter("kind in ('IN_NATION', 'IN_REGION')"), center, 3, 40)[1]


@query(a.sql(", r(node) AS (SELECT name FROM tree WHERE base = 3 UNION SELECT t.name FROM r JOIN tree t ON t.base = r.node) SELECT node FROM r", "tree", recursive=True))
def descendants(spark, sf):
    return closure.descendants(a.tree(spark, sf), 3)


@query(a.sql(", r(hop, base) AS (SELECT 1, base FROM tree WHERE name = 98 UNION ALL SELECT r.hop + 1, t.base FROM r JOIN tree t ON t.name = r.base WHERE r.hop < 20) SELECT hop, base FROM r", "tree", recursive=True))
def ancestor_chain(spark, sf):
    return closure.ancestor_chain(a.tree(spark, sf), 98)


# a node has at most two ways out and blocks are joined one way only, so cycles lie inside blocks of ten
_WALK = ", w(start, node, path) AS (SELECT src, dst, [src] FROM ring UNION ALL SELECT w.start, e.dst, list_append(w.path, w.node) FROM w JOIN ring e ON e.src = w.node WHERE w.node <> w.start AND w.node > w.start AND len(w.path) < 12 AND left(e.dst, 12) = left(w.start, 12))"


@query(a.sql(f"{_WALK} SELECT array_to_string(list_append(path, start), '>') AS cycle FROM w WHERE node = start", "ring", recursive=True))
def cycles_exact(spark, sf):
    return cycles.cycles(a.ring(spark, sf)).select(F.array_join("cycle", ">").alias("cycle"))


@query(a.sql(f"{_WALK}, c AS (SELECT start, path FROM w WHERE node = start) SELECT DISTINCT unnest(path) AS node, start AS component FROM c", "ring", recursive=True))
def scc_members(spark, sf):
    return cycles.scc_members(a.ring(spark, sf))


_CALLS = "calls AS (SELECT DISTINCT user_id AS owner, CAST(user_id * 7 + event_id % 3 AS BIGINT) % 1000 AS callee FROM events)"


@query(f"WITH RECURSIVE {_CALLS}, r(node) AS (SELECT CAST(1 AS BIGINT) UNION SELECT c.callee FROM r JOIN calls c ON c.owner = r.node) SELECT node FROM r")
def call_reachability(spark, sf):
    e = a.read(spark, sf, "events").select(F.col("user_id").cast("long").alias("src"), ((F.col("user_id") * 7 + F.col("event_id") % 3).cast("long") % 1000).alias("dst"))
    return closure.reach(e, spark.createDataFrame([(1,)], "node long")).select("node")


@query(
    a.sql(
        """, up(name, a_t, d) AS (SELECT name, name, 0 FROM tree UNION ALL SELECT u.name, t.base, u.d + 1 FROM up u JOIN tree t ON t.name = u.a_t),
v AS (SELECT c_custkey AS name, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment END AS value, c_custkey % 3 AS item FROM customer)
SELECT u.name, arg_min(v.value, u.d) FILTER (WHERE v.value IS NOT NULL) AS value, count(DISTINCT v.item) AS items FROM up u JOIN v ON v.name = u.a_t GROUP BY 1""",
        "tree",
        recursive=True,
    )
)
def inherited_values(spark, sf):
    c = a.read(spark, sf, "customer")
    values = c.select(F.col("c_custkey").alias("name"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_mktsegment")).alias("value"), F.array((F.col("c_custkey") % 3).cast("string")).alias("items")).filter("name > 0")
    root = c.filter("c_custkey = 0").select(F.col("c_custkey").alias("name"), F.col("c_mktsegment").alias("value"), F.array(F.lit("0")).alias("items"))
    out = closure.inherited(a.tree(spark, sf), values.unionByName(root)).filter("name > 0")
    return out.select("name", "value", F.size("items").cast("long").alias("items"))


# --- integrity ------------------------------------------------------------------------------------

_DAMAGED = """dn AS (SELECT node_id FROM nodes WHERE NOT (kind = 'supplier' AND path LIKE '%7') UNION ALL SELECT node_id FROM nodes WHERE kind = 'region'),
dr AS (SELECT edge_id AS relation_id, source_id, target_id FROM edges WHERE kind <> 'ORDERED_BY' UNION ALL SELECT edge_id, source_id, target_id FROM edges WHERE kind = 'IN_REGION'),
dv AS (SELECT evidence_id, edge_id AS relation_id FROM evidence UNION ALL SELECT 'evidence:lost', 'edge:lost')"""


def _damaged(spark, sf):
    n, e, v = a.pg_nodes(spark, sf), a.pg_edges(spark, sf), a.pg_evidence(spark, sf)
    nodes = n.filter("not (kind = 'supplier' and path like '%7')").select("node_id").unionByName(n.filter("kind = 'region'").select("node_id"))
    rel = e.select(F.col("edge_id").alias("relation_id"), "source_id", "target_id", "kind")
    relations = rel.filter("kind <> 'ORDERED_BY'").unionByName(rel.filter("kind = 'IN_REGION'")).drop("kind")
    lost = spark.createDataFrame([("evidence:lost", "edge:lost")], "evidence_id string, relation_id string")
    return nodes, relations, v.select("evidence_id", F.col("edge_id").alias("relation_id")).unionByName(lost)


@query(
    a.sql(
        f""", {_DAMAGED}, ends AS (SELECT relation_id, source_id AS node_id FROM dr UNION ALL SELECT relation_id, target_id FROM dr)
SELECT 'error' AS severity, 'duplicate-node-id' AS code, node_id AS subject, NULL AS detail FROM dn GROUP BY node_id HAVING count(*) > 1
UNION ALL SELECT 'error', 'duplicate-relation-id', relation_id, NULL FROM dr GROUP BY relation_id HAVING count(*) > 1
UNION ALL SELECT 'error', 'dangling-relation-endpoint', relation_id, string_agg(DISTINCT node_id, ',' ORDER BY node_id) FROM ends WHERE node_id NOT IN (SELECT node_id FROM dn) GROUP BY relation_id
UNION ALL SELECT 'error', 'dangling-evidence', evidence_id, NULL FROM dv WHERE relation_id NOT IN (SELECT relation_id FROM dr)
UNION ALL SELECT DISTINCT 'warning', 'relation-evidence-missing', relation_id, NULL FROM dr WHERE relation_id NOT IN (SELECT relation_id FROM dv)
UNION ALL SELECT 'error', 'graph-count-mismatch', 'nodes', '1/' || count(DISTINCT node_id) FROM dn""",
        "nodes",
        "links",
        "edges",
        "evidence",
    )
)
def graph_validate(spark, sf):
    return integrity.validate_graph(*_damaged(spark, sf), {"nodes": 1})


@query(a.sql(f", {_DAMAGED} SELECT DISTINCT target_id, relation_id FROM dr WHERE target_id NOT IN (SELECT node_id FROM dn)", "nodes", "links", "edges", "evidence"))
def fk_orphans(spark, sf):
    nodes, relations, _ = _damaged(spark, sf)
    return integrity.orphans(relations, "target_id", nodes, "node_id").select("target_id", "relation_id").distinct()


@query(a.sql(f", {_DAMAGED} SELECT r.relation_id, count(evidence_id) AS evidence_count FROM (SELECT DISTINCT relation_id FROM dr) r LEFT JOIN dv USING (relation_id) GROUP BY 1", "nodes", "links", "edges", "evidence"))
def evidence_missing(spark, sf):
    _, relations, evidence = _damaged(spark, sf)
    return integrity.evidence_counts(relations, evidence)


@query(
    a.sql(
        f""", {_DAMAGED} SELECT 'error' AS status, (SELECT count(*) FROM (SELECT node_id FROM dn GROUP BY 1 HAVING count(*) > 1)) + (SELECT count(*) FROM (SELECT relation_id FROM dr GROUP BY 1 HAVING count(*) > 1))
+ (SELECT count(DISTINCT relation_id) FROM dr WHERE source_id NOT IN (SELECT node_id FROM dn) OR target_id NOT IN (SELECT node_id FROM dn)) + (SELECT count(*) FROM dv WHERE relation_id NOT IN (SELECT relation_id FROM dr))
+ (SELECT count(DISTINCT relation_id) FROM dr WHERE relation_id NOT IN (SELECT relation_id FROM dv)) AS problem_count""",
        "nodes",
        "links",
        "edges",
        "evidence",
    )
)
def max_severity(spark, sf):
    return integrity.status(integrity.validate_graph(*_damaged(spark, sf)))


@query(a.sql("SELECT canonical_key, CASE WHEN o.properties IS NULL THEN 'added' WHEN n.properties IS NULL THEN 'removed' ELSE 'changed' END AS change FROM old o FULL JOIN new n USING (canonical_key) WHERE o.properties IS DISTINCT FROM n.properties", "old", "new"))
def graph_diff_nodes(spark, sf):
    return integrity.diff_nodes(*a.snapshots(spark, sf))


@query(
    a.sql(
        ", x AS (SELECT canonical_key AS source_key, 'ORDERED_BY' AS kind, 'p|customer|' || o_custkey AS target_key FROM old), y AS (SELECT canonical_key AS source_key, 'ORDERED_BY' AS kind, 'p|customer|' || o_custkey AS target_key FROM new) SELECT *, 'removed' AS change FROM (SELECT * FROM x EXCEPT SELECT * FROM y) UNION ALL SELECT *, 'added' FROM (SELECT * FROM y EXCEPT SELECT * FROM x)",
        "old",
        "new",
    )
)
def graph_diff_relations(spark, sf):
    def triples(d):  # relation_triples joins the ends of a relation table with a node table
        nodes = d.select("canonical_key").unionByName(d.select(F.concat(F.lit("p|customer|"), F.col("o_custkey").cast("string")).alias("canonical_key"))).distinct().withColumn("node_id", F.xxhash64("canonical_key"))
        rel = d.select(F.xxhash64("canonical_key").alias("source_id"), F.lit("ORDERED_BY").alias("kind"), F.xxhash64(F.concat(F.lit("p|customer|"), F.col("o_custkey").cast("string"))).alias("target_id"))
        return integrity.relation_triples(nodes, rel)

    old, new = a.snapshots(spark, sf)
    return integrity.diff_relations(triples(old), triples(new))


@query(a.sql("SELECT canonical_key FROM new EXCEPT SELECT canonical_key FROM old", "old", "new"))
def keys_added(spark, sf):
    return integrity.key_sets(*a.snapshots(spark, sf), "canonical_key").filter("change = 'added'").select("canonical_key")


@query(a.sql("SELECT canonical_key FROM old EXCEPT SELECT canonical_key FROM new", "old", "new"))
def keys_removed(spark, sf):
    return integrity.key_sets(*a.snapshots(spark, sf), "canonical_key").filter("change = 'removed'").select("canonical_key")


@query(a.sql("SELECT canonical_key FROM old INTERSECT SELECT canonical_key FROM new", "old", "new"))
def keys_common(spark, sf):
    return integrity.key_sets(*a.snapshots(spark, sf), "canonical_key").filter("change = 'common'").select("canonical_key")


@query("SELECT o_custkey AS node_id, arg_min(o_orderstatus, o_orderkey) AS name, coalesce(arg_max(o_orderpriority, o_orderkey) FILTER (WHERE o_orderkey % 3 <> 0), '') AS note FROM orders GROUP BY 1")
def upsert_properties(spark, sf):
    o = a.read(spark, sf, "orders").select(F.col("o_custkey").alias("node_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("name"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderpriority")).alias("note"))
    return upsert.upsert_nodes(o, first=("name",), last=("note",))


@query("SELECT relation_id, arg_min(p, s) AS priority FROM (SELECT o_custkey || '|' || o_orderstatus AS relation_id, o_orderkey AS s, o_orderpriority AS p FROM orders) GROUP BY 1")
def relation_first_wins(spark, sf):
    o = a.read(spark, sf, "orders").select(F.concat_ws("|", F.col("o_custkey").cast("string"), "o_orderstatus").alias("relation_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("priority"))
    return upsert.upsert_relations(o)


@query(
    "WITH r AS (SELECT DISTINCT l_orderkey || '>' || l_partkey AS relation_id, l_orderkey AS s, l_partkey AS t FROM lineitem), e AS (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus <> 'F') SELECT r.relation_id, 'local:order:' || r.s AS source_id, 'local:part:' || r.t AS target_id FROM r JOIN e ON e.k = r.s JOIN part ON p_partkey = r.t"
)
def id_remap_import(spark, sf):
    li = a.read(spark, sf, "lineitem").select("l_orderkey", "l_partkey").distinct()
    s = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    relations = li.select(F.concat_ws(">", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string")).alias("relation_id"), s("o:", "l_orderkey").alias("source_id"), F.lit("CONTAINS").alias("kind"), s("p:", "l_partkey").alias("target_id"))
    orders = a.read(spark, sf, "orders").filter("o_orderstatus <> 'F'").select(s("o:", "o_orderkey").alias("foreign_id"), s("local:order:", "o_orderkey").alias("local_id"))
    parts = a.read(spark, sf, "part").select(s("p:", "p_partkey").alias("foreign_id"), s("local:part:", "p_partkey").alias("local_id"))
    none = spark.createDataFrame([], "relation_id string, detail string")
    return integrity.import_graph(relations, relations, none, orders.unionByName(parts))[0].select("relation_id", "source_id", "target_id")
