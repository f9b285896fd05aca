"""Cycles: the exact back-edge cycles of one depth-first search, and scalable cycle membership."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import cut


#: Edges above which sinks are peeled off before one task searches, and edges of what is left that one task may search.
LARGE, MOST = 2_000_000, 30_000_000


def _search(names: list[str], edges: dict[str, list[str]]) -> list[list[str]]:
    """One closed cycle for each back edge of a depth-first search in name order, least rotation first."""
    state: dict[str, int] = {}
    found = set()
    for start in names:
        if state.get(start):
            continue
        path, place = [start], {start: 0}
        ways = [iter(edges.get(start, ()))]
        state[start] = 1
        while ways:
            nxt = next(ways[-1], None)
            if nxt is None:
                state[path[-1]] = 2
                place.pop(path.pop())
                ways.pop()
            elif state.get(nxt) == 1:
                ring = path[place[nxt] :]
                k = ring.index(min(ring))
                best = min(tuple(ring[i:] + ring[:i]) for i in range(len(ring)) if ring[i] == ring[k])
                found.add((*best, best[0]))
            elif not state.get(nxt):
                state[nxt] = 1
                place[nxt] = len(path)
                path.append(nxt)
                ways.append(iter(edges.get(nxt, ())))
    return [list(c) for c in sorted(found)]


def cyclic_core(edges: DataFrame) -> DataFrame:
    """Edges (src, dst) that can lie on a cycle: sources and sinks are peeled off until none is left, a round for each node of the longest tail."""
    core = cut(edges.filter("src <> dst").select("src", "dst").distinct())
    n = core.count()
    while n:
        heads, tails = core.select(F.col("dst").alias("src")).distinct(), core.select(F.col("src").alias("dst")).distinct()
        core = cut(core.join(heads, "src", "left_semi").join(tails, "dst", "left_semi").select("src", "dst"))
        m = core.count()
        if m == n:
            break
        n = m
    return core


def cycles(edges: DataFrame, nodes: DataFrame | None = None, most: int = MOST) -> DataFrame:
    """``cycle``: closed node lists, one for each back edge of a depth-first search in name order; exact, so one task searches.

    Nodes that reach no cycle do not change what the search finds, so above ``LARGE`` edges they are peeled off first by
    distributed rounds (edges into nodes without an edge out go). More than ``most`` edges that are left are an error; ``scc_members`` answers
    which nodes lie on cycles without any single task.
    """
    all_edges = edges.select("src", "dst")
    if nodes is not None:  # edges to unknown names do not count
        known = nodes.select(F.col("name"))
        all_edges = all_edges.join(known.withColumnRenamed("name", "src"), "src", "left_semi").join(known.withColumnRenamed("name", "dst"), "dst", "left_semi")
    heads = all_edges.filter("src <> dst").distinct()
    heads = cut(heads)
    n = heads.count()
    while n > LARGE:  # a round for each node of the longest tail
        heads = cut(heads.join(heads.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        n, before = heads.count(), n
        if n == before:
            break
    if n > most:
        raise ValueError(f"{n} edges can lie on cycles, more than one task searches ({most}); use scc_members")
    kind = dict(edges.dtypes)["src"]

    def run(t):
        import pyarrow as pa

        src, dst = t.column("src"), t.column("dst")
        ways: dict = {}
        for a, b in zip(src.to_pylist(), dst.to_pylist()):
            ways.setdefault(a, set()).add(b)
        names = sorted({*ways, *dst.to_pylist()})
        found = _search(names, {k: sorted(v) for k, v in ways.items()})
        return pa.table({"cycle": pa.array(found, pa.list_(src.type))})

    return heads.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(run, f"cycle array<{kind}>")


def _components(edges: dict) -> list[tuple]:
    """(node, least node of its component) for the nodes on cycles, by one depth-first search."""
    index, low, on, stack, out = {}, {}, set(), [], []
    for start in sorted(edges):
        if start in index:
            continue
        index[start] = low[start] = len(index)
        stack.append(start)
        on.add(start)
        work = [(start, iter(edges.get(start, ())))]
        while work:
            at, ways = work[-1]
            nxt = next(ways, None)
            if nxt is None:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[at])
                if low[at] == index[at]:
                    members = []
                    while True:
                        members.append(stack.pop())
                        on.discard(members[-1])
                        if members[-1] == at:
                            break
                    if len(members) > 1:
                        out += [(m, min(members)) for m in members]
            elif nxt not in index:
                index[nxt] = low[nxt] = len(index)
                stack.append(nxt)
                on.add(nxt)
                work.append((nxt, iter(edges.get(nxt, ()))))
            elif nxt in on:
                low[at] = min(low[at], index[nxt])
    return out


def scc_members(edges: DataFrame, large: int | None = None) -> DataFrame:
    """(node, component) of the nodes on cycles; the component is its least node.

    Up to ``large`` (``LARGE``) edges one task searches depth first. More are settled by label propagation forwards and backwards over the cyclic core, which
    scales out: names are ranked by hash, so that no order of names along the edges makes rounds many; each round settles at least the least node, with its
    component or as lying on no cycle (between two cycles, say), and rounds go on until the core has so few edges or is empty. A round spreads labels a hop at a time.
    """
    large = LARGE if large is None else large
    out, core = None, cut(edges.filter("src <> dst").select("src", "dst").distinct())
    n = core.count()
    while n > large:
        core = cyclic_core(core)
        fore, back = _least(core, "src", "dst"), _least(core, "dst", "src")
        both = cut(fore.join(back.withColumnRenamed("least", "b"), "node"))
        met = both.filter("least = b").select("node", "least")
        sizes = met.groupBy("least").agg(F.min("node").alias("component"), F.count("*").alias("n")).filter("n > 1")
        done = cut(met.join(sizes, "least").select("node", "component"))
        out = done if out is None else out.unionByName(done)
        rest = both.filter("least <> b")
        a = core.join(rest.toDF("src", "l", "lb"), "src").join(rest.toDF("dst", "m", "mb"), "dst")
        core = cut(a.filter("l = m and lb = mb").select("src", "dst"))
        n = core.count()
    kind = dict(edges.dtypes)["src"]

    def run(t):
        import pyarrow as pa

        ways: dict = {}
        for a, b in zip(t.column("src").to_pylist(), t.column("dst").to_pylist()):
            ways.setdefault(a, []).append(b)
        found = _components({k: sorted(v) for k, v in ways.items()})
        return pa.table({c: pa.array([f[i] for f in found], t.column("src").type) for i, c in enumerate(("node", "component"))})

    last = core.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(run, f"node {kind}, component {kind}")
    return last if out is None else out.unionByName(last)


def _least(edges: DataFrame, a: str, b: str) -> DataFrame:
    """The node of least hash from which each node is reached along a to b."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    label = cut(nodes.withColumn("least", F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("name"))))
    while True:
        sent = edges.join(label, F.col(a) == F.col("node")).select(F.col(b).alias("node"), "least")
        new = cut(sent.unionByName(label).groupBy("node").agg(F.min("least").alias("least")))
        if new.join(label.withColumnRenamed("least", "o"), "node").filter("least.name <> o.name").isEmpty():
            return new.select("node", F.col("least.name").alias("least"))
        label = new
