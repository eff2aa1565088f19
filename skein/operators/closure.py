"""Transitive operators over edges (src_key, dst_key): impact, paths, components.

All loops run on tables written to the shared folder; only counts come to the
driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.chunked import number_rows
from skein.operators.hierarchy import _loops, _resolve
from skein.plans.graph import Graph, _key
from skein.runtime import materialize, materialize_counting, release

TRIM_ROUNDS = 4  # before chains are contracted; shallow trees are gone by then
KEPT_APART = 8  # tables of rounds that are read one by one before they are written as one


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _compact(parts: list[DataFrame], label: str) -> list[DataFrame]:
    """Tables of rounds, written as one whenever there are KEPT_APART of them; the last stays for the next round."""
    if len(parts) < KEPT_APART:
        return parts
    whole = materialize(_union(parts), label)
    for part in parts[:-1]:
        release(part)
    return [whole]


def impact(graph: Graph, root: str) -> DataFrame:
    """(ord, name, depth): the root and all that depends on it, breadth first.

    Every node comes once, at its least depth; a level is ordered by the place
    of the earliest parent, then by key. An unknown root gives itself alone, as
    written; an empty name raises ValueError.
    """
    root_key = _key(root)
    spark = graph.edges.sparkSession
    known = spark.range(1).select(root_key.alias("node_key"), F.lit(root.strip()).alias("asked"))
    start = known.join(graph.nodes, "node_key", "left").select("node_key", F.coalesce("name", "asked").alias("name"))
    seen = materialize(start.select("node_key", "name", F.lit(0).cast("long").alias("ord"), F.lit(0).alias("depth")), "impact")
    edges = materialize(graph.edges.select(F.col("dst_key").alias("up"), F.col("src_key").alias("node_key")).filter("up <> node_key").distinct(), "reverse")
    levels, frontier, total, depth = [seen], seen, 1, 0
    while True:
        depth += 1
        reached = frontier.select(F.col("node_key").alias("up"), "ord").join(edges, "up").groupBy("node_key").agg(F.min("ord").alias("parent"))
        fresh, n = materialize_counting(reached.join(_union(levels).select("node_key"), "node_key", "left_anti"), "level", n=F.count(F.lit(1)))
        if not n["n"]:
            break
        # A level is numbered over range partitions, not in one window.
        numbered = number_rows(fresh.withColumn("all", F.lit(0)), "all", ["parent", "node_key"], label="level-order")
        frontier = materialize(
            numbered.join(graph.nodes.select("node_key", "name"), "node_key").select("node_key", "name", (F.col("_pos") + F.lit(total)).alias("ord"), F.lit(depth).alias("depth")), "level"
        )
        release(fresh)
        levels = _compact([*levels, frontier], "impact")
        total += n["n"]
    return _union(levels).select("ord", "name", "depth")


def impact_paths(graph: Graph, root: str, max_depth: int | None = None) -> DataFrame:
    """(path): every simple path of dependents from the root; a pair of edges of both kinds counts twice.

    The number of paths can grow exponentially with the graph, as any list of
    them must; max_depth bounds their length.
    """
    spark = graph.edges.sparkSession
    known = spark.range(1).select(_key(root).alias("at"), F.lit(root.strip()).alias("asked"))
    start = known.join(graph.nodes.withColumnRenamed("node_key", "at"), "at", "left").select("at", F.array("at").alias("keys"), F.array(F.coalesce("name", "asked")).alias("path"))
    edges = materialize(graph.edges.join(graph.nodes.select(F.col("node_key").alias("src_key"), "name"), "src_key").select(F.col("dst_key").alias("at"), F.col("src_key").alias("next"), "name"), "path-edges")
    level = materialize(start, "paths")
    out, depth = level, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = level.join(edges, "at").filter(~F.array_contains("keys", F.col("next")))
        step = step.select(F.col("next").alias("at"), F.concat("keys", F.array("next")).alias("keys"), F.concat("path", F.array("name")).alias("path"))
        level, n = materialize_counting(step, "paths", n=F.count(F.lit(1)))
        if not n["n"]:
            break
        out = out.unionByName(level)
    return out.select("path")


def impact_tree(paths: DataFrame) -> DataFrame:
    """(path, parent, name, depth): the nodes of the tree that impact_paths spans; the root's parent is null."""
    return paths.select(
        "path", F.when(F.size("path") > 1, F.element_at("path", -2)).alias("parent"), F.element_at("path", -1).alias("name"), (F.size("path") - 1).alias("depth")
    )


def strong_components(edges: DataFrame) -> DataFrame:
    """(node_key, component) of the nodes that lie on some loop of more than one node.

    component is the least key of the component. Nodes without an edge in or
    out on their side cannot be on a loop and are trimmed. Chains of nodes with
    one edge in and one out are contracted to one edge, by pointers that double
    their reach, so that long loops and long tails take a number of rounds that
    grows with the logarithm of their length; plain loops end there. In what is
    left without chains each node takes on the greatest key that reaches it, and
    the nodes that reach that key inside its colour are its component. A chain
    belongs to the component that holds both its ends.
    """
    left = materialize(edges.select("src_key", "dst_key").filter("src_key <> dst_key").distinct(), "scc-edges")
    found: list[DataFrame] = []
    chains: list[DataFrame] = []
    while True:
        left, n, stable = _trim(left)
        if not n:
            break
        shorter, chain, rings = _contract_chains(left)
        if chain is not None:
            chains.append(chain)
            found.append(rings)
            left = shorter
            continue
        if not stable:
            continue
        colours = _flood(left.select("src_key", "dst_key"), left.select(F.col("src_key").alias("node_key")).unionByName(left.select(F.col("dst_key").alias("node_key"))).distinct())
        inside = _same_colour(left, colours)
        roots = colours.filter("node_key = colour").select("node_key", "colour")
        members = _reach_back(inside, roots)
        found.append(members.select("node_key", F.col("colour").alias("component")))
        gone = members.select("node_key")
        rest = left.join(gone.withColumnRenamed("node_key", "src_key"), "src_key", "left_anti").join(gone.withColumnRenamed("node_key", "dst_key"), "dst_key", "left_anti")
        left = materialize(rest.select("src_key", "dst_key"), "scc-edges")
    if not found:
        return edges.select(F.col("src_key").alias("node_key"), F.col("dst_key").alias("component")).limit(0)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    for chain in reversed(chains):
        out = materialize(_unfold(chain, out), "components")
    least = out.groupBy("component").agg(F.min("node_key").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return out.join(least, "component").select("node_key", F.col("least").alias("component"))


def _contract_chains(edges: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Edges with every chain made one edge; the chains (node_key, enters, leaves); plain loops (node_key, component).

    Nothing but the edges where no node has just one edge in and one out.
    """
    ends = edges.select(F.col("src_key").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst_key").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    inner, n = materialize_counting(ends.groupBy("node").agg(F.sum("o").alias("o"), F.sum("i").alias("i")).filter("o = 1 and i = 1").select("node"), "chain-nodes", n=F.count(F.lit(1)))
    if not n["n"]:
        return edges, None, None
    is_src, is_dst = inner.select(F.col("node").alias("src_key"), F.lit(True).alias("s")), inner.select(F.col("node").alias("dst_key"), F.lit(True).alias("d"))
    marked = materialize(edges.join(is_src, "src_key", "left").join(is_dst, "dst_key", "left").select("src_key", "dst_key", F.coalesce("s", F.lit(False)).alias("s"), F.coalesce("d", F.lit(False)).alias("d")), "marked")
    links = marked.filter("s and d").select(F.col("src_key").alias("node"), F.col("dst_key").alias("anc"), F.lit(None).cast("string").alias("place"))
    resolved, rings, stuck = _resolve(materialize(links, "chain-links"), local=True)
    if stuck is not None:
        rings = rings.unionByName(_loops(materialize(stuck, "stuck")))
    # The last node of a chain names it.
    lasts = marked.filter("s and not d").select(F.col("src_key").alias("last"), F.col("dst_key").alias("leaves"))
    of = resolved.select("node", F.col("anc").alias("last")).unionByName(lasts.select(F.col("last").alias("node"), "last"))
    heads = marked.filter("d and not s").select(F.col("dst_key").alias("node"), F.col("src_key").alias("enters")).join(of, "node").select("last", "enters")
    whole = materialize(heads.join(lasts, "last"), "chain-ends")
    chain = materialize(of.join(whole, "last").select(F.col("node").alias("node_key"), "enters", "leaves"), "chains")
    kept = marked.filter("not s and not d").select("src_key", "dst_key").unionByName(whole.filter("enters <> leaves").select(F.col("enters").alias("src_key"), F.col("leaves").alias("dst_key")))
    return materialize(kept.distinct(), "scc-edges"), chain, materialize(rings.select(F.col("node").alias("node_key"), F.col("loop_key").alias("component")), "rings")


def _unfold(chain: DataFrame, comp: DataFrame) -> DataFrame:
    """``comp`` with the chains whose ends lie in one component, or that return to the node they leave."""
    a = comp.select(F.col("node_key").alias("enters"), F.col("component").alias("ca"))
    b = comp.select(F.col("node_key").alias("leaves"), F.col("component").alias("cb"))
    ended = chain.join(a, "enters", "left").join(b, "leaves", "left")
    inside = ended.filter("ca = cb or enters = leaves").select("node_key", "enters", F.coalesce("ca", "enters").alias("component"), F.col("ca").isNull().alias("fresh"))
    anchors = inside.filter("fresh").select(F.col("enters").alias("node_key"), "component").distinct()
    return comp.select("node_key", "component").unionByName(inside.select("node_key", "component")).unionByName(anchors)


def _trim(edges: DataFrame) -> tuple[DataFrame, int, bool]:
    """Edges whose source is some target and whose target is some source, after some rounds; their number; whether no more would fall away."""
    before = None
    for _ in range(TRIM_ROUNDS):
        kept = edges.join(edges.select(F.col("dst_key").alias("src_key")).distinct(), "src_key", "left_semi").join(edges.select(F.col("src_key").alias("dst_key")).distinct(), "dst_key", "left_semi")
        kept, n = materialize_counting(kept.select("src_key", "dst_key"), "scc-edges", n=F.count(F.lit(1)))
        release(edges)
        edges = kept
        if n["n"] in (before, 0):
            return edges, n["n"], True
        before = n["n"]
    return edges, before, False


def _flood(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_key, colour): the greatest key that reaches each node."""
    state = materialize(nodes.select("node_key", F.col("node_key").alias("colour")), "colours")
    while True:
        sent = state.withColumnRenamed("node_key", "src_key").join(edges, "src_key").groupBy(F.col("dst_key").alias("node_key")).agg(F.max("colour").alias("sent"))
        step = state.join(sent, "node_key", "left").select("node_key", F.greatest("colour", F.coalesce("sent", "colour")).alias("colour"), (F.col("sent") > F.col("colour")).alias("moved"))
        step, n = materialize_counting(step, "colours", moved=F.count_if("moved"))
        release(state)
        state = step.drop("moved")
        if not n["moved"]:
            return state


def _same_colour(edges: DataFrame, colours: DataFrame) -> DataFrame:
    a = colours.select(F.col("node_key").alias("src_key"), F.col("colour").alias("ca"))
    b = colours.select(F.col("node_key").alias("dst_key"), F.col("colour").alias("cb"))
    return materialize(edges.join(a, "src_key").join(b, "dst_key").filter("ca = cb").select("src_key", "dst_key"), "same-colour")


def _reach_back(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """All nodes that reach a root along edges of its colour."""
    done = [materialize(roots, "members")]
    frontier = done[0]
    while True:
        step = edges.join(frontier.withColumnRenamed("node_key", "dst_key"), "dst_key").select(F.col("src_key").alias("node_key"), "colour").distinct()
        step, n = materialize_counting(step.join(_union(done).select("node_key"), "node_key", "left_anti"), "members", n=F.count(F.lit(1)))
        if not n["n"]:
            return _union(done)
        frontier = step
        done = _compact([*done, step], "members")


def cycles(graph: Graph) -> DataFrame:
    """(component, members, is_self_reference, edges): loops and self-references.

    members are the nodes' names in key order; edges are all edges inside the
    component, of both kinds, as structs (source, target, kind) in order.
    """
    comp = strong_components(graph.edges)
    loops = graph.edges.filter("src_key = dst_key").select(F.col("src_key").alias("node_key")).distinct()
    alone = loops.join(comp, "node_key", "left_anti").select("node_key", F.col("node_key").alias("component"))
    all_of = materialize(comp.unionByName(alone), "components")
    members = (
        all_of.join(graph.nodes, "node_key").groupBy("component").agg(F.array_sort(F.collect_list(F.struct("node_key", "name"))).alias("m")).select("component", F.col("m.name").alias("members"))
    )
    a = all_of.select(F.col("node_key").alias("src_key"), F.col("component").alias("ca"))
    b = all_of.select(F.col("node_key").alias("dst_key"), F.col("component").alias("cb"))
    inner = graph.edges.join(a, "src_key").join(b, "dst_key").filter("ca = cb")
    src = graph.nodes.select(F.col("node_key").alias("src_key"), F.col("name").alias("source"))
    dst = graph.nodes.select(F.col("node_key").alias("dst_key"), F.col("name").alias("target"))
    inner = inner.join(src, "src_key").join(dst, "dst_key")
    listed = inner.groupBy(F.col("ca").alias("component")).agg(F.array_sort(F.collect_list(F.struct("src_key", "dst_key", "kind", "source", "target"))).alias("e"))
    listed = listed.select("component", F.transform("e", lambda x: F.struct(x["source"].alias("source"), x["target"].alias("target"), x["kind"].alias("kind"))).alias("edges"))
    return members.join(listed, "component").select("component", "members", (F.size("members") == 1).alias("is_self_reference"), "edges")


def cycle_members(found: DataFrame, graph: Graph) -> DataFrame:
    """(node_key, component) of every member of the cycles."""
    from skein.functions.names import fold

    return found.select("component", F.explode("members").alias("name")).select(fold("name").alias("node_key"), "component")
