"""Resolution, pairing and comparison queries on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import connections, integrity, resolve
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


_OFFERS = "offers AS (SELECT DISTINCT 'Part' || l_partkey AS name, n_regionkey AS rank, 'S' || l_suppkey AS path FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey)"


def _offers(spark, sf):
    li = a.read(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct()
    s = a.read(spark, sf, "supplier").join(a.read(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    out = li.join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return out.select(F.concat(F.lit("Part"), F.col("l_partkey").cast("string")).alias("name"), F.col("n_regionkey").alias("rank"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("path"))


@query(f"WITH {_OFFERS} SELECT lower(name) AS key, arg_min(rank, (rank, lower(path))) AS rank, arg_min(path, (rank, lower(path))) AS path FROM offers GROUP BY 1")
def overlay_resolve(spark, sf):
    return resolve.overlay(_offers(spark, sf)).select("key", "rank", "path")


@query(f"WITH {_OFFERS}, o AS (SELECT lower(name) AS key, path, row_number() OVER (PARTITION BY lower(name) ORDER BY rank, lower(path)) AS r FROM offers) SELECT key, count(*) - 1 AS n, coalesce(string_agg(path, ',' ORDER BY r) FILTER (WHERE r > 1), '') AS alternates FROM o GROUP BY 1")
def overlay_alternates(spark, sf):
    return resolve.overlay(_offers(spark, sf)).select("key", F.size("alternates").cast("long").alias("n"), F.array_join("alternates", ",").alias("alternates"))


_DECLARED = "d AS (SELECT 'C' || o_custkey AS name FROM orders), u AS (SELECT 'c' || c_custkey AS name FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT 'C' || c_custkey FROM customer WHERE c_acctbal < 1000)"


def _declared(spark, sf):
    s = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string")).alias("name")
    d = a.read(spark, sf, "orders").select(s("C", "o_custkey"))
    c = a.read(spark, sf, "customer")
    return d, c.filter("c_mktsegment <> 'BUILDING'").select(s("c", "c_custkey")).unionByName(c.filter("c_acctbal < 1000").select(s("C", "c_custkey")))


@query(
    f"""WITH {_DECLARED}, x AS (SELECT lower(name) AS key, count(*) AS n FROM d GROUP BY 1), y AS (SELECT lower(name) AS key, count(*) AS n FROM u GROUP BY 1)
SELECT key, coalesce(x.n, 0) AS declared, coalesce(y.n, 0) AS rules, CASE WHEN coalesce(x.n, 0) > 1 THEN 'duplicate' WHEN x.n IS NULL THEN 'undeclared' WHEN y.n IS NULL THEN 'missing' WHEN y.n > 1 THEN 'ambiguous' ELSE 'resolved' END AS status FROM x FULL JOIN y USING (key)"""
)
def module_reconcile(spark, sf):
    return resolve.reconcile(*_declared(spark, sf))


@query(
    f"""WITH {_DECLARED}, c AS (SELECT lower(name) AS k, count(*) AS n, min(name) AS id FROM u GROUP BY 1)
SELECT d.name, coalesce(n, 0) AS candidates, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'external' END AS resolution_status, CASE WHEN n = 1 THEN id ELSE 'external:' || lower(d.name) END AS target FROM d LEFT JOIN c ON k = lower(d.name)"""
)
def candidate_status(spark, sf):
    d, u = _declared(spark, sf)
    return resolve.reference_status(d, u.withColumn("id", F.col("name")))


@query(f"WITH {_DECLARED}, c AS (SELECT lower(name) AS k, count(*) AS n FROM u GROUP BY 1) SELECT DISTINCT 'external:' || lower(d.name) AS node_id, 'external_module' AS kind, lower(d.name) AS name FROM d LEFT JOIN c ON k = lower(d.name) WHERE n IS DISTINCT FROM 1")
def synthetic_externals(spark, sf):
    d, u = _declared(spark, sf)
    return resolve.synthetic_nodes(resolve.reference_status(d, u.withColumn("id", F.col("name"))))


@query("SELECT 'suffix' AS status, min(p_name) AS name, count(*) AS matches FROM part WHERE p_partkey = 17 AND NOT EXISTS (SELECT 1 FROM part WHERE p_name = '17')")
def selection_status(spark, sf):
    names = a.read(spark, sf, "part").select(F.concat(F.lit("Part::"), F.col("p_partkey").cast("string")).alias("name"), "p_name", "p_partkey")
    chosen = resolve.select_symbol(names, "17")
    return chosen.join(names, "name").select("status", F.col("p_name").alias("name"), "matches")


_OWN = "own AS (SELECT DISTINCT split_part(path, '/', 1) AS root FROM paths UNION SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) FROM paths WHERE page_id % 3 = 0 AND path LIKE '%/%')"


@query(a.sql(f", {_OWN} SELECT page_id, arg_max(root, length(root)) AS owner FROM paths JOIN own ON path = root OR starts_with(path, root || '/') GROUP BY 1", "paths"))
def deepest_owner(spark, sf):
    p = a.url_paths(spark, sf)
    host = p.select(F.substring_index("path", "/", 1).alias("root"))
    two = p.filter("page_id % 3 = 0 and contains(path, '/')").select(F.substring_index("path", "/", 2).alias("root"))
    return resolve.deepest_owner(p, host.union(two)).select("page_id", "owner")


# an order beside its cheapest and its dearest part
_PAIRS = "e AS (SELECT l_orderkey AS header, min(l_partkey) + 100000000 AS source FROM lineitem GROUP BY 1 UNION SELECT l_orderkey, max(l_partkey) + 100000000 FROM lineitem GROUP BY 1)"


def _pairs(spark, sf):
    ends = a.read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("header")).agg(F.array(F.min("l_partkey"), F.max("l_partkey")).alias("s"))
    return ends.select("header", F.explode("s").alias("s")).select("header", (F.col("s") + 100000000).alias("source")).distinct()


@query(f"WITH {_PAIRS} SELECT header, source FROM e WHERE header IN (SELECT header FROM e GROUP BY 1 HAVING count(*) = 1) AND source IN (SELECT source FROM e GROUP BY 1 HAVING count(*) = 1)")
def pairing(spark, sf):
    return resolve.pairing(_pairs(spark, sf)).select("header", "source")


@query(f"WITH {_PAIRS} SELECT o_orderkey AS path FROM orders WHERE o_orderkey NOT IN (SELECT header FROM e) UNION ALL SELECT p_partkey + 100000000 FROM part WHERE p_partkey + 100000000 NOT IN (SELECT source FROM e)")
def pair_leftovers(spark, sf):
    files = a.read(spark, sf, "orders").select(F.col("o_orderkey").alias("path")).unionByName(a.read(spark, sf, "part").select((F.col("p_partkey") + 100000000).alias("path")))
    return resolve.pair_leftovers(files, _pairs(spark, sf))


@query(
    """WITH x AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN [] WHEN o_orderkey % 4 = 1 THEN ['Win64'] WHEN o_orderkey % 4 = 2 THEN ['Linux'] END AS pa, CASE WHEN o_orderkey % 3 = 0 THEN ['Linux', 'Mac'] ELSE ['Win64', 'Mac'] END AS sp,
CASE WHEN o_orderkey % 5 = 0 THEN ['Win64'] ELSE [] END AS pd, CASE WHEN o_orderkey % 6 = 0 THEN ['Game'] WHEN o_orderkey % 6 = 1 THEN ['Editor'] END AS ta, CASE WHEN o_orderkey % 7 = 0 THEN ['Editor'] END AS td FROM orders),
y AS (SELECT *, CASE WHEN pa IS NULL OR len(pa) = 0 THEN sp ELSE pa END AS al FROM x)
SELECT id, (len(al) = 0 OR list_contains(al, 'Win64')) AND NOT list_contains(pd, 'Win64') AND (ta IS NULL OR list_contains(ta, 'Editor')) AND NOT coalesce(list_contains(td, 'Editor'), false) AS applies FROM y"""
)
def applicability(spark, sf):
    k = F.col("o_orderkey")
    lst = lambda *v: F.array(*[F.lit(x) for x in v]).cast("array<string>")
    x = a.read(spark, sf, "orders").select(
        k.alias("id"),
        F.when(k % 4 == 0, lst()).when(k % 4 == 1, lst("Win64")).when(k % 4 == 2, lst("Linux")).alias("platform_allow"),
        F.when(k % 3 == 0, lst("Linux", "Mac")).otherwise(lst("Win64", "Mac")).alias("supported_platforms"),
        F.when(k % 5 == 0, lst("Win64")).otherwise(lst()).alias("platform_deny"),
        F.when(k % 6 == 0, lst("Game")).when(k % 6 == 1, lst("Editor")).alias("target_allow"),
        F.when(k % 7 == 0, lst("Editor")).alias("target_deny"),
    )
    return x.select("id", resolve.applicable("Win64", "Editor").alias("applies"))


@query(
    """WITH r AS (SELECT l_orderkey AS usr, CASE l_returnflag WHEN 'N' THEN 'declaration' WHEN 'R' THEN 'definition' ELSE 'inline' END AS role FROM lineitem),
c AS (SELECT usr, count(*) FILTER (WHERE role = 'declaration') AS declarations, count(*) FILTER (WHERE role = 'definition') AS definitions, count(*) FILTER (WHERE role = 'inline') AS inlines FROM r GROUP BY 1)
SELECT *, CASE WHEN definitions + inlines > 1 OR declarations > 1 THEN 'ambiguous' WHEN declarations = 1 AND definitions = 1 THEN 'matched' WHEN inlines = 1 THEN 'inline_definition' WHEN definitions = 1 THEN 'source_only' ELSE 'declaration_only' END AS status FROM c"""
)
def decl_def_relation(spark, sf):
    li = a.read(spark, sf, "lineitem")
    role = F.when(F.col("l_returnflag") == "N", "declaration").when(F.col("l_returnflag") == "R", "definition").otherwise("inline")
    return resolve.declaration_relation(li.select(F.col("l_orderkey").alias("usr"), role.alias("role")))


@query(
    a.sql(
        "SELECT canonical_key, CASE WHEN o.canonical_key IS NULL THEN 'baseline_property_missing' WHEN n.properties IS NOT DISTINCT FROM o.properties THEN 'matches_default' ELSE 'differs_from_default' END AS comparison FROM new n LEFT JOIN old o USING (canonical_key)",
        "old",
        "new",
    )
)
def property_delta(spark, sf):
    old, new = a.snapshots(spark, sf)
    out = resolve.property_delta(new.select("canonical_key", "properties"), old, ["canonical_key"], "properties")
    return out.select("canonical_key", "comparison")


@query("SELECT name, min(value) AS value FROM (SELECT o_custkey || ':' || o_orderdate AS name, o_orderpriority AS value FROM orders) GROUP BY 1 HAVING min(value) = max(value)")
def unique_global_values(spark, sf):
    o = a.read(spark, sf, "orders").select(F.concat_ws(":", F.col("o_custkey").cast("string"), F.col("o_orderdate").cast("string")).alias("name"), F.col("o_orderpriority").alias("value"))
    return resolve.unique_values(o)


@query("SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, count(*) FILTER (WHERE o_orderstatus <> 'F') AS unfinished, count(*) FILTER (WHERE o_orderstatus = 'O' AND o_orderkey % 2 = 0) AS open_even FROM orders")
def conditional_counts(spark, sf):
    o = a.read(spark, sf, "orders")
    done = F.col("o_orderstatus") == "F"
    return o.agg(F.count("*").alias("total"), F.count_if(done).alias("finished"), F.count_if(~done).alias("unfinished"), F.count_if((F.col("o_orderstatus") == "O") & (F.col("o_orderkey") % 2 == 0)).alias("open_even"))


_URL_SCOPES = "u AS (SELECT page_id AS use_id, replace(path, '/', '::') AS scope, CAST(page_id % 10 AS VARCHAR) AS expression FROM paths), t AS (SELECT DISTINCT replace(regexp_replace(path, '/[^/]*$', ''), '/', '::') || '::' || (page_id % 10) AS q FROM paths WHERE page_id % 2 = 0 AND path LIKE '%/%')"


@query(
    a.sql(
        f""", {_URL_SCOPES}, s AS (SELECT use_id, expression, scope, unnest(range(1, len(string_split(scope, '::')) + 1)) AS n FROM u),
i AS (SELECT use_id, len(string_split(scope, '::')) - n + 1 AS r, array_to_string(string_split(scope, '::')[1:n], '::') || '::' || expression AS q FROM s),
c AS (SELECT use_id, 0 AS r, expression AS q FROM u WHERE expression IN (SELECT q FROM t) UNION ALL SELECT use_id, r, q FROM i WHERE q IN (SELECT q FROM t)
UNION ALL SELECT use_id, 1000, (SELECT min(q) FROM t WHERE string_split(q, '::')[-1] = expression) FROM u WHERE (SELECT count(*) FROM t WHERE string_split(q, '::')[-1] = expression) = 1)
SELECT u.use_id, arg_min(c.q, c.r) AS qualified FROM u LEFT JOIN c USING (use_id) GROUP BY 1""",
        "paths",
    )
)
def scope_resolution(spark, sf):
    p = a.url_paths(spark, sf)
    uses = p.select(F.col("page_id").alias("use_id"), F.replace("path", F.lit("/"), F.lit("::")).alias("scope"), (F.col("page_id") % 10).cast("string").alias("expression"))
    types = p.filter("page_id % 2 = 0 and contains(path, '/')").select(F.concat_ws("::", F.replace(F.regexp_replace("path", "/[^/]*$", ""), F.lit("/"), F.lit("::")), (F.col("page_id") % 10).cast("string")).alias("qualified"))
    return resolve.scoped(uses, types).select("use_id", "qualified")


@query(
    """WITH c AS (SELECT l_orderkey * 10 + l_linenumber AS call_id, l_suppkey AS owner, l_partkey AS name, l_returnflag AS ns FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_returnflag FROM lineitem)),
m AS (SELECT DISTINCT l_suppkey AS owner, l_partkey AS name FROM lineitem WHERE l_quantity < 10), f AS (SELECT p_partkey AS name FROM part WHERE p_size < 25)
SELECT call_id, c.owner, c.name, CASE WHEN m.owner IS NOT NULL THEN 'method' WHEN f.name IS NOT NULL AND ns = 'N' THEN 'function' ELSE 'unknown' END AS kind FROM c LEFT JOIN m ON m.owner = c.owner AND m.name = c.name LEFT JOIN f ON f.name = c.name"""
)
def call_targets(spark, sf):
    li = a.read(spark, sf, "lineitem")
    calls = li.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_returnflag").distinct()
    calls = calls.select(F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("c"), F.col("l_suppkey").alias("o"), F.col("l_partkey").alias("n")).alias("call_id"), F.col("l_suppkey").alias("owner_type"), F.col("l_partkey").alias("name"), F.col("l_returnflag").alias("namespace"))
    methods = li.filter("l_quantity < 10").select(F.col("l_suppkey").alias("owner"), F.col("l_partkey").alias("name")).distinct().withColumn("id", F.col("name"))
    functions = a.read(spark, sf, "part").filter("p_size < 25").select(F.lit("N").alias("namespace"), F.col("p_partkey").alias("name"), F.col("p_partkey").alias("id"))
    out = resolve.call_targets(calls, methods, functions)
    return out.select(F.col("call_id.c").alias("call_id"), F.col("call_id.o").alias("owner"), F.col("call_id.n").alias("name"), "kind")


@query(
    a.sql(
        """, f AS (SELECT DISTINCT path FROM paths WHERE page_id % 2 = 0), r AS (SELECT DISTINCT split_part(path, '/', 1) AS root FROM paths),
i AS (SELECT DISTINCT path AS source, regexp_replace(path, '/?[^/]*$', '') AS dir, regexp_replace(path, '^[^/]*/?', '') AS target FROM paths WHERE path LIKE '%/%'),
c AS (SELECT source, target, dir || '/' || target AS p FROM i UNION SELECT source, target, root || '/' || target FROM i, r)
SELECT i.source, i.target, count(f.path) AS candidates, min(f.path) AS path FROM i JOIN c USING (source, target) LEFT JOIN f ON f.path = c.p GROUP BY 1, 2""",
        "paths",
    )
)
def include_resolution(spark, sf):
    p = a.url_paths(spark, sf)
    inc = p.filter("contains(path, '/')").select(F.col("path").alias("source"), F.regexp_replace("path", "/?[^/]*$", "").alias("dir"), F.regexp_replace("path", "^[^/]*/?", "").alias("target")).distinct()
    roots = p.select(F.substring_index("path", "/", 1).alias("root")).distinct()
    files = p.filter("page_id % 2 = 0").select("path").distinct()
    return resolve.include_candidates(inc, roots, files).select("source", "target", "candidates", "path")


@query(
    "SELECT 'C' || c_custkey AS name, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 'project' WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN 'engine' ELSE 'missing' END AS found FROM customer"
)
def declared_files(spark, sf):
    name = lambda c: F.concat(F.lit("C"), F.col(c).cast("string")).alias("name")
    o = a.read(spark, sf, "orders")
    of = lambda status: o.filter(F.col("o_orderstatus") == status).select(name("o_custkey"))
    return resolve.declared_files(a.read(spark, sf, "customer").select(name("c_custkey")), of("P"), of("F")).select("name", "found")


_SERVERS = """s AS (SELECT s_suppkey AS k, 'srv' || s_suppkey AS server_id, s_suppkey % 4 <> 0 AS healthy, CASE WHEN s_suppkey % 3 = 0 THEN 'asset_list,blueprint_read' WHEN s_suppkey % 3 = 1 THEN 'asset_list' ELSE 'other' END AS tools, CASE WHEN s_suppkey % 5 = 0 THEN '5.' || (s_suppkey % 2) || '.1' END AS v FROM supplier)"""


def _servers(spark, sf):
    k = F.col("s_suppkey")
    s = a.read(spark, sf, "supplier")
    tools = F.when(k % 3 == 0, F.array(F.lit("asset_list"), F.lit("blueprint_read"))).when(k % 3 == 1, F.array(F.lit("asset_list"))).otherwise(F.array(F.lit("other")))
    named = s.select(F.explode(F.transform(tools, lambda t: F.concat(F.lit("mcp__srv"), k.cast("string"), F.lit("__"), t))).alias("name"))
    meta = s.select(F.concat(F.lit("srv"), k.cast("string")).alias("server_id"), F.concat(F.lit("srv"), k.cast("string")).alias("display_name"), F.when(k % 5 == 0, F.create_map(F.lit("engine_version"), F.concat(F.lit("5."), (k % 2).cast("string"), F.lit(".1")))).otherwise(F.create_map().cast("map<string,string>")).alias("metadata"), (k % 4 != 0).alias("healthy"))
    return connections.inventory(named, meta)


@query(
    f"WITH {_SERVERS} SELECT server_id, concat_ws(',', CASE WHEN NOT healthy THEN 'connection-unhealthy' END, CASE WHEN v IS NULL THEN 'engine-version-not-declared' END, CASE WHEN v IS NOT NULL AND v NOT LIKE '5.0%' THEN 'engine-version-mismatch' END, CASE WHEN NOT (contains(tools, 'asset') AND contains(tools, 'blueprint')) THEN 'capabilities-missing' END) AS reasons FROM s"
)
def capability_match(spark, sf):
    out = connections.compatible(_servers(spark, sf), ["assets", "blueprints"], version=(5, 0))
    return out.select("server_id", F.array_join("reasons", ",").alias("reasons"))


@query(
    f"WITH {_SERVERS}, g AS (SELECT *, healthy AND v LIKE '5.0%' AND contains(tools, 'asset') AND contains(tools, 'blueprint') AS good FROM s) SELECT CASE WHEN count(*) = 0 THEN 'missing' WHEN count(*) FILTER (WHERE good) > 1 THEN 'ambiguous' WHEN count(*) FILTER (WHERE good) = 1 THEN 'available' WHEN bool_and(NOT healthy) THEN 'unhealthy' ELSE 'incompatible' END AS status, CASE WHEN count(*) FILTER (WHERE good) = 1 THEN min(server_id) FILTER (WHERE good) END AS server_id, count(*) AS n, count(*) FILTER (WHERE good) AS good FROM g"
)
def connection_status(spark, sf):
    return connections.connection_status(connections.compatible(_servers(spark, sf), ["assets", "blueprints"], version=(5, 0)))
