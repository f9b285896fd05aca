"""Reachability in all its forms, by frontiers that grow level by level.

Each level is one join of the frontier with the edges and one anti-join with what was reached. Lineage is cut by a
reliable checkpoint, and a level that reaches nothing ends the loop, so the driver learns one bit per level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import cut, numbered


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, depth) of what ``seeds`` (node) reach over ``edges`` (src, dst), least depth first; seeds have depth 0."""
    frontier = cut(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    seen, depth = frontier, 0
    step = edges.select("src", "dst").distinct()
    while max_depth is None or depth < max_depth:
        depth += 1
        fresh = frontier.join(step, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = cut(fresh.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if depth % 8 == 0:
            seen = cut(seen)
    return seen


def impact(edges: DataFrame, name, max_depth: int = 3) -> DataFrame:
    """(node, depth) of what depends on ``name`` within ``max_depth`` steps; the start itself is left out."""
    if max_depth < 1:
        raise ValueError("max_depth must be at least 1")
    seed = edges.sparkSession.createDataFrame([(name,)], f"node {dict(edges.dtypes)['dst']}")
    return reach(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), seed, max_depth).filter("depth > 0")


def impact_ordered(edges: DataFrame, name, max_depth: int = 3) -> DataFrame:
    """As ``impact`` with ``rank``, the place in breadth-first discovery order (dependents of one node by name). A level is ranked by ranges, not in one task."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()
    spark = edges.sparkSession
    frontier = cut(spark.createDataFrame([(name, 0, 0)], f"node {dict(edges.dtypes)['dst']}, depth int, rank long"))
    seen, done = frontier, 0
    for depth in range(1, max_depth + 1):
        found = frontier.join(back, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min("rank").alias("above"))
        fresh = found.join(seen.select("node"), "node", "left_anti")
        frontier = cut(numbered(fresh, [F.col("above"), F.col("node")]).select("node", F.lit(depth).alias("depth"), (F.col("n") + 1 + done).alias("rank")))
        n = frontier.count()
        if not n:
            break
        done += n
        seen = seen.unionByName(frontier)
    return seen.filter("depth > 0")


def descendants(bases: DataFrame, name) -> DataFrame:
    """Names below ``name`` in ``bases`` (name, base); the start appears where inheritance is cyclic."""
    down = bases.select(F.col("base").alias("src"), F.col("name").alias("dst"))
    first = down.filter(F.col("src") == name).select(F.col("dst").alias("node"))
    return reach(down, first).select("node")


def ancestor_chain(bases: DataFrame, name, hops: int = 20) -> DataFrame:
    """(hop, base): the least base, then its least base, ...; a name that is no node ends the chain and is part of it."""
    least = cut(bases.groupBy("name").agg(F.min("base").alias("base")))
    spark = bases.sparkSession
    at, chain = name, []
    for hop in range(1, hops + 1):  # a chain is one row a step, bounded by hops
        row = least.filter(F.col("name") == at).select("base").first()
        if row is None or row.base is None or row.base == name or row.base in [b for _, b in chain]:
            break
        chain.append((hop, row.base))
        at = row.base
    return spark.createDataFrame(chain, f"hop int, base {dict(bases.dtypes)['base']}")


def neighbourhood(nodes: DataFrame, edges: DataFrame, center: str, depth: int = 2, cap: int = 200) -> tuple[DataFrame, DataFrame, bool]:
    """Nodes (with distance) and edges around ``center``, and whether the cap refused any.

    Undirected and breadth-first; depth is clamped to 1..5 and the cap to 20..600. A level admits its new nodes in the order of the
    (kind, edge_id) of the first edge that meets them. Edges are those at a node whose neighbours were looked at,
    with both ends admitted.
    """
    depth, cap = min(max(depth, 1), 5), min(max(cap, 20), 600)
    ends = edges.select("edge_id", "kind", F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    both = ends.unionByName(ends.select("edge_id", "kind", F.col("b").alias("a"), F.col("a").alias("b")))
    known = nodes.select(F.col("node_id").alias("node"))
    seen = cut(known.filter(F.col("node") == center).withColumn("distance", F.lit(0)))
    frontier, looked, refused = seen, None, False
    for d in range(1, depth + 1):
        size = seen.count()  # at most the cap
        met = both.join(frontier.select(F.col("node").alias("a")), "a").join(seen.select(F.col("node").alias("b")), "b", "left_anti")
        met = met.join(known.select(F.col("node").alias("b")), "b", "left_semi")
        first = met.groupBy(F.col("b").alias("node")).agg(F.min(F.struct("kind", "edge_id")).alias("o"))
        best = first.orderBy("o").limit(cap - size + 1)  # the level's admissions, and one more that tells whether any was refused
        ranked = cut(best.withColumn("r", F.row_number().over(Window.orderBy("o"))))
        refused = refused or ranked.count() > cap - size
        looked = frontier if looked is None else looked.unionByName(frontier)
        frontier = cut(ranked.filter(F.col("r") <= cap - size).select("node", F.lit(d).alias("distance")))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier))
    ids = seen.select("node")
    inner = edges.join(ids.withColumnRenamed("node", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("node", "target_id"), "target_id", "left_semi")
    at = F.broadcast(looked.select("node"))  # at most the cap
    kept = inner.join(at, (F.col("source_id") == F.col("node")) | (F.col("target_id") == F.col("node")), "left_semi").select(*edges.columns)
    return nodes.join(seen.withColumnRenamed("node", "node_id"), "node_id"), kept, refused


def inherited(bases: DataFrame, values: DataFrame) -> DataFrame:
    """Resolved values along first bases: the nearest non-null ``value``, and the united ``items``, the farthest first.

    ``bases``: (name, base), at most one base a name. ``values``: (name, value, items array<string>). ``cyclic`` tells names that
    meet themselves. A walk goes on, however deep, until it has no base or comes to a name that it had.
    """
    pairs = cut(values.select("name").withColumn("at", F.col("name")).withColumn("d", F.lit(0)))
    every, frontier = pairs, pairs
    one = bases.groupBy(F.col("name").alias("at")).agg(F.min("base").alias("up"))
    met, d = pairs.limit(0), 0
    while not frontier.isEmpty():
        d += 1
        above = cut(frontier.join(one, "at").select("name", F.col("up").alias("at"), F.lit(d).alias("d")))
        met = met.unionByName(above.filter("at = name"))
        frontier = cut(above.join(every, ["name", "at"], "left_anti"))
        every = every.unionByName(frontier)
        if d % 8 == 0:
            every, met = cut(every), cut(met)
    cyclic = met.select("name").distinct().withColumn("cyclic", F.lit(True))
    told = every.join(values.withColumnRenamed("name", "at"), "at")
    out = told.groupBy("name").agg(
        F.min_by("value", F.when(F.col("value").isNotNull(), F.col("d"))).alias("value"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("d")).alias("o"), "items"))), lambda x: F.coalesce(x["items"], F.array().cast("array<string>"))))).alias("items"),
    )
    return out.join(cyclic, "name", "left").withColumn("cyclic", F.coalesce("cyclic", F.lit(False)))


#: Marks, in any case, of nodes without a meaning of their own, and of sinks.
STRUCTURAL = ("k2node_event", "k2node_customevent", "k2node_componentboundevent", "k2node_functionentry", "k2node_functionresult", "k2node_knot", "k2node_tunnel", "animgraphnode_root")
SINKS = ("result", "root", "tunnel")


def semantic_nodes(nodes: DataFrame) -> DataFrame:
    """(node, semantic) of graph nodes that can act, from nodes with pins.

    ``nodes``: object_path, class, pins array<struct<name, direction, type, connections array<struct<node, pin>>>>, perhaps class_path and type_id, whose
    marks count too. Roots have a connected exec output and no exec input, or are sinks with a connected input; the walk goes against all inputs
    and along exec outputs; structural nodes are walked through but are not semantic.
    """
    said = F.lower(F.concat_ws(" ", *[c for c in ("class", "class_path", "type_id") if c in nodes.columns]))
    marked = lambda marks: F.exists(F.array(*[F.lit(m) for m in marks]), lambda m: F.contains(F.col("said"), m))
    every = nodes.select("object_path", "pins", said.alias("said"))
    p = every.select("object_path", "said", F.explode("pins").alias("p"))
    exec_ = F.contains(F.lower(F.coalesce("p.type", F.lit(""))), F.lit("exec"))
    way = F.lower(F.col("p.direction"))
    out, into = way == "output", way == "input"
    tied = F.size("p.connections") > 0
    known = p.groupBy("object_path", "said").agg(F.max((exec_ & out & tied).cast("int")).alias("starts"), F.max((exec_ & into).cast("int")).alias("entered"), F.max((into & tied).cast("int")).alias("fed"))
    roots = known.filter((F.col("starts") == 1) & (F.col("entered") == 0) | marked(SINKS) & (F.col("fed") == 1)).select(F.col("object_path").alias("node"))
    walk = p.filter(into | (exec_ & out)).select(F.col("object_path").alias("src"), F.explode("p.connections.node").alias("dst"))
    found = reach(walk, roots).select("node")
    return found.join(every.select(F.col("object_path").alias("node"), "said"), "node").select("node", (~marked(STRUCTURAL)).alias("semantic"))
